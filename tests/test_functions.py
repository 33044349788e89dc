"""Scalar expressions on hand-written rows (FIXTURES.md section 2)."""

import pytest
from pyspark.sql import functions as F

from rankloom.functions.query_filters import adaptive_flag, choose_query, domain, duration_limit, remote_flag
from rankloom.functions.rerank import parse_reply, rank_score
from rankloom.functions.text import slug_name, tokens, truncate_ellipsis, url_slug


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr("v").alias("r")).first()["r"]


@pytest.mark.parametrize("text,expected", [
    ("within 60 min", 60), ("under 2 hours", 2), ("1 hour long", 60), ("30-40 mins", 40),
    ("about an hour", None), ("max\n45", None), ("less than 20", 20), ("Max duration 45", 45),
    ("5 minor tests", 5), ("no limit here", None), ("", None), ("3 hrs", 180),
])
def test_duration_limit(spark, text, expected):
    assert one(spark, duration_limit, text) == expected


@pytest.mark.parametrize("text,remote,adaptive", [
    ("virtual test", True, True), ("plain test", None, None), ("remote and adaptive", True, True),
    ("Work from HOME", True, None), ("IRT based", None, True),
])
def test_flags(spark, text, remote, adaptive):
    assert one(spark, remote_flag, text) == remote
    assert one(spark, adaptive_flag, text) == adaptive


def test_domain_first_keyword_in_list_order(spark):
    assert one(spark, domain, "javascript and python") == "java"
    assert one(spark, domain, "python and sql") == "python"
    assert one(spark, domain, "nothing") is None


@pytest.mark.parametrize("url,slug", [("https://h/a/B//", "b"), (None, ""), ("https://h/x/Y-z/", "y-z")])
def test_url_slug(spark, url, slug):
    assert one(spark, url_slug, url) == slug


def test_slug_name_variants(spark):
    u = "https://h/view/account-manager-new%28v2%29/"
    assert one(spark, slug_name, u) == "Account Manager(V2)"
    assert one(spark, lambda c: slug_name(c, scraper_variant=False), u) == "Account Manager New%28V2%29"


def test_tokens_unicode_and_underscore(spark):
    assert one(spark, tokens, "Héllo, wörld_2 ÇA-va!") == ["héllo", "wörld_2", "ça", "va"]
    assert one(spark, tokens, "  ") == []


def test_truncate_collapse_tests_original_length(spark):
    text = "word " * 28 + "x" * 10 + "    " * 5      # 160 chars that collapse to about 150
    assert len(text) > 150
    out = one(spark, lambda c: truncate_ellipsis(c, 150, collapse_ws=True), text)
    collapsed = " ".join(text.split())
    assert out == collapsed[:150] + "..."
    short = "a  b"
    assert one(spark, lambda c: truncate_ellipsis(c, 150, collapse_ws=True), short) == "a b"
    assert one(spark, lambda c: truncate_ellipsis(c, 3), "abcd") == "abc..."


@pytest.mark.parametrize("reply,expected", [
    ("Sure: [2, 0, 2, 9]", [2, 0, 2, 9]), ("no list", None), ('[1, "a"]', None), ("[]", []),
    ("[1, null]", None), ("text\n[3,\n1] and [4]", [3, 1]), ("[1.5]", None),
])
def test_parse_reply(spark, reply, expected):
    assert one(spark, parse_reply, reply) == expected


def test_rank_score(spark):
    r = spark.range(3).select(F.round(rank_score(F.col("id")), 6).alias("s")).collect()
    assert [x.s for x in r] == [0.99, 0.98, 0.97]


def test_choose_query(spark):
    df = spark.createDataFrame(
        [("q", "", None, None), ("q", "jd", None, None), ("q", "jd", "u", None), ("q", "jd", "u", "page"),
         (None, None, "", None)],
        "query string, jd_text string, jd_url string, page_text string")
    got = [r.t for r in df.select(choose_query("query", "jd_text", "jd_url", "page_text").alias("t")).collect()]
    assert got == ["q", "jd", "", "page", None]
