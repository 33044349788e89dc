"""Category diversity and the duration range filter.

``diversify`` gives the same rows and order as the greedy walk "take up to m per
category in score order, stop at k, then backfill with the skipped rows in order", but
as bounded top-k windows so that a hot query or category never lands in one task:

* tier 0 = rows ranked <= m inside their (query, category), then the first k of those;
* tier 1 = the first k rows of the query that are not tier 0 (a backfilled row always
  sits in the query's overall top k);
* answer = first k by (tier, score order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rankloom.operators.topk import top_k_per_group


def diversify(df: DataFrame, k: int = 10, max_per_category: int = 4, *,
              group: str = "query_id", category: str = "category",
              order: list[Column], key: str = "key", default_category: str | None = None,
              rank_col: str = "rank") -> DataFrame:
    """F2 over (group, key, category, ...) rows; ``order`` is the score order with a key tie-break."""
    if default_category is not None:
        df = df.withColumn(category, F.coalesce(F.col(category), F.lit(default_category)))
    cat_key = F.coalesce(F.col(category), F.lit("\u0000null"))
    d = df.withColumn("_cat", cat_key)
    tier0_all = top_k_per_group(d, [group, "_cat"], order, max_per_category, "_rc").drop("_rc")
    tier0 = top_k_per_group(tier0_all, group, order, k, "_r0").drop("_r0").withColumn("_tier", F.lit(0))
    top = top_k_per_group(d, group, order, k, "_ra").drop("_ra")
    tier1 = (top.join(tier0_all.select(group, key, "_cat"), [group, key, "_cat"], "left_anti")
                .withColumn("_tier", F.lit(1)))
    both = tier0.unionByName(tier1)
    return (top_k_per_group(both, group, [F.col("_tier").asc()] + order, k, rank_col)
            .drop("_tier", "_cat"))


def diversify_few(df: DataFrame, k: int = 10, max_per_category: int = 4, *,
                  group: str = "query_id", category: str = "category", order: list[Column],
                  default_category: str | None = None, rank_col: str = "rank") -> DataFrame:
    """``diversify`` for groups that are already cut to a bounded number of rows (a query's fused
    hits): rows numbered within their category give the tiers, and one more numbering the
    answer, so the input is read once."""
    if default_category is not None:
        df = df.withColumn(category, F.coalesce(F.col(category), F.lit(default_category)))
    in_category = F.row_number().over(W.partitionBy(group, F.col(category)).orderBy(*order))
    tiered = df.withColumn("_tier", (in_category > max_per_category).cast("int"))
    return top_k_per_group(tiered, group, [F.col("_tier").asc()] + order, k, rank_col).drop("_tier")


def duration_filter(df: DataFrame, max_duration: int | None = None, min_duration: int | None = None,
                    duration: str = "duration_minutes") -> DataFrame:
    """Unknown (null) durations always pass; bounds inclusive; a bound of 0 is no bound."""
    if not max_duration and not min_duration:
        return df
    d = F.col(duration)
    ok = F.lit(True)
    if max_duration:
        ok = ok & (d <= F.lit(max_duration))
    if min_duration:
        ok = ok & (d >= F.lit(min_duration))
    return df.filter(d.isNull() | ok)
