"""Hard candidate filters and request validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOP_K = 20


def hard_filter(cands: DataFrame, filters: str = "filters") -> DataFrame:
    """C4: duration <= limit or unknown (a 0/null limit is no limit); remote and adaptive
    must equal 'Yes' when asked for ('Unknown' fails). The domain key has no effect, so a
    request whose only hit is a domain passes everything (C7 is the identity)."""
    f = F.col(filters)
    limit = f.getField("duration_limit")
    d = F.col("duration_minutes")
    dur_ok = (F.coalesce(limit, F.lit(0)) == 0) | d.isNull() | (d <= limit)
    remote_ok = ~F.coalesce(f.getField("remote_testing"), F.lit(False)) | \
        F.coalesce(F.col("remote_support") == "Yes", F.lit(False))
    adaptive_ok = ~F.coalesce(f.getField("adaptive_testing"), F.lit(False)) | \
        F.coalesce(F.col("adaptive_support") == "Yes", F.lit(False))
    return cands.filter(dur_ok & remote_ok & adaptive_ok)


def validate_requests(requests: DataFrame, final_text: str = "final_text") -> DataFrame:
    """Adds ``reject_reason`` (null when valid): no input, or top_k outside 1..20."""
    t = F.col(final_text)
    k = F.col("top_k")
    reason = (F.when(t.isNull() | (F.length(t) == 0), F.lit("no input"))
               .when(k.isNull() | (k < 1) | (k > MAX_TOP_K), F.lit("top_k out of range")))
    return requests.withColumn("reject_reason", reason)
