"""Constraints parsed out of free query text.

All parsing is regex over the lower-cased text with built-in functions, so the
whole request table is parsed in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values (must equal the reference's for the same results) -----------------
# Duration cascade, tried in this order on the lower-cased query; the first pattern that
# matches wins. The last one is in hours and is multiplied by 60.
DURATION_PATTERNS = [
    r"(\d+)\s*min",
    r"(\d+)\s*minute",
    r"under\s*(\d+)",
    r"less than\s*(\d+)",
    r"within\s*(\d+)",
    r"max.*?(\d+)",
    r"maximum.*?(\d+)",
    r"(\d+)\s*(?:hours?|hrs?)",
]
HOUR_PATTERN_INDEX = 7
REMOTE_PATTERN = r"remote|online|virtual|home|proctor"
ADAPTIVE_PATTERN = r"adaptive|irt|item response|ai-powered"
DOMAIN_KEYWORDS = ["cognitive", "personality", "behavioral", "situational",
                   "technical", "aptitude", "skills", "java", "python", "sql",
                   "sales", "leadership", "management", "english", "verbal",
                   "numerical", "reasoning"]
# ---------------------------------------------------------------------------------------

def _lower(q) -> Column:
    return F.lower(F.col(q) if isinstance(q, str) else q)


def duration_limit(query) -> Column:
    """First matching duration pattern; hours x60; null when none matches.

    An over-long digit run that overflows int gives null (Python would keep the big int).
    """
    q = _lower(query)
    expr = None
    for i, pat in enumerate(DURATION_PATTERNS):
        val = F.regexp_extract(q, pat, 1).try_cast("int")
        if i == HOUR_PATTERN_INDEX:
            val = F.try_multiply(val, F.lit(60))
        expr = (F.when(q.rlike(pat), val) if expr is None else expr.when(q.rlike(pat), val))
    return expr.otherwise(F.lit(None).cast("int"))


def remote_flag(query) -> Column:
    """True when any remote keyword occurs (unanchored), else null (never false)."""
    return F.when(_lower(query).rlike(REMOTE_PATTERN), F.lit(True)).otherwise(F.lit(None).cast("boolean"))


def adaptive_flag(query) -> Column:
    """True when any adaptive keyword occurs ('irt' also hits inside 'virtual')."""
    return F.when(_lower(query).rlike(ADAPTIVE_PATTERN), F.lit(True)).otherwise(F.lit(None).cast("boolean"))


def domain(query) -> Column:
    """First keyword, in list order, contained in the query."""
    q = _lower(query)
    expr = None
    for kw in DOMAIN_KEYWORDS:
        expr = F.when(q.contains(kw), F.lit(kw)) if expr is None else expr.when(q.contains(kw), F.lit(kw))
    return expr.otherwise(F.lit(None).cast("string"))


def parse_filters(query) -> Column:
    """All four constraints as one struct column."""
    return F.struct(duration_limit(query).alias("duration_limit"),
                    remote_flag(query).alias("remote_testing"),
                    adaptive_flag(query).alias("adaptive_testing"),
                    domain(query).alias("test_type"))


def choose_query(query, jd_text, jd_url, page_text) -> Column:
    """A non-empty jd_url overrides (its page text, '' when unmatched); else jd_text
    when non-empty; else query."""
    def c(x):
        return F.col(x) if isinstance(x, str) else x
    url_given = c(jd_url).isNotNull() & (F.length(c(jd_url)) > 0)
    return (F.when(url_given, F.coalesce(c(page_text), F.lit("")))
             .otherwise(F.coalesce(F.nullif(c(jd_text), F.lit("")), c(query))))
