"""Batch recommend over a request table.

One lazy plan for all requests: choose text -> retrieve top 40 with diversity ->
parse constraints -> hard filter -> renumber -> external ranking (or cut) -> top_k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rankloom.functions.query_filters import parse_filters
from rankloom.functions.text import truncate_ellipsis
from rankloom.operators.filters import hard_filter
from rankloom.operators.ranking import apply_rankings
from rankloom.plans.requests import resolve_requests
from rankloom.plans.search import TextSearch
from rankloom.session import materialize

RETRIEVE_K = 40
ECHO_CHARS = 200


def recommend(search: TextSearch, requests: DataFrame, catalog: DataFrame, top_k: int | None = 10,
              rankings: DataFrame | None = None) -> DataFrame:
    """requests(query_id, query_text) with non-empty text -> one row per recommendation:
    (query_id, query, rank, key, relevance_score, reranked, catalog columns...). With
    ``top_k`` None each request's own ``top_k`` column is its limit."""
    cands = search.retrieve(requests, catalog, top_k=RETRIEVE_K, apply_diversity=True)
    limit = F.lit(top_k) if top_k is not None else F.col("top_k")
    asked = requests.select("query_id", parse_filters("query_text").alias("filters"), limit.cast("int").alias("_limit"))
    kept = hard_filter(cands.join(asked, "query_id"))
    w = W.partitionBy("query_id").orderBy("rank")
    kept = (kept.withColumn("pos", F.row_number().over(w) - 1)
                .withColumn("score", F.col("relevance_score"))
                .drop("rank", "filters", "relevance_score"))
    ranked = apply_rankings(kept, rankings, F.col("_limit")).drop("_limit")
    echo = requests.select("query_id", truncate_ellipsis("query_text", ECHO_CHARS).alias("query"))
    return (ranked.join(echo, "query_id")
                  .withColumnRenamed("score", "relevance_score"))


def recommend_requests(search: TextSearch, requests: DataFrame, pages: DataFrame, catalog: DataFrame,
                       rankings: DataFrame | None = None) -> DataFrame:
    """The whole request path for requests(request_id, query, jd_text, jd_url, top_k, use_llm):
    choose the text (A11, B19), drop invalid requests (C8), retrieve, filter, apply
    rankings(request_id, reply) to the requests that ask for them, and cut each to its own
    ``top_k``. Rows as ``recommend`` gives them, with request_id. For batches and streams.
    The valid requests are written once: the search and what follows read them several times."""
    valid = resolve_requests(requests, pages).filter(F.col("reject_reason").isNull()).select(
        F.col("request_id").alias("query_id"), F.col("final_text").alias("query_text"), "top_k", "use_llm")
    valid = materialize(valid, "valid_requests")
    replies = None
    if rankings is not None:
        asking = valid.filter(F.col("use_llm")).select("query_id")
        replies = rankings.withColumnRenamed("request_id", "query_id").join(asking, "query_id", "left_semi")
    return recommend(search, valid, catalog, None, replies).withColumnRenamed("query_id", "request_id")


def total_results(recs: DataFrame, requests: DataFrame) -> DataFrame:
    """Recommendations per request, zeros included."""
    n = recs.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_results"))
    return (requests.select("query_id").join(n, "query_id", "left")
                    .select("query_id", F.coalesce("total_results", F.lit(0)).alias("total_results")))
