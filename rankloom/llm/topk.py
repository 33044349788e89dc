"""Exact top-k search: tiled matrix products of queries and shards, partial selection in each
tile, and a tree merge of the per-query lists.

Vectors are hashed into shards of about SHARD rows, queries into tiles of about TILE rows; each
(tile, shard) pair meets once, as one matrix product, and gives at most k rows per query. Both
sizes are fixed, so no task's input grows with the data; rows shipped are
|V| * |Q| / TILE + |Q| * |V| / SHARD, and the |Q| * |V| products that exactness needs run as
BLAS calls. Lists of FAN shards are merged at a time until one list per query is left.

Scores are exact integers: products run in doubles while every sum stays below 2^53, and in
Python integers otherwise (saturating at the limits of a long).

Defined cases: vectors that are null, hold a null or a non-finite component, or have no id
take no part. Vectors of different lengths are not compared with each other. Repeated
candidate rows are candidates each; a repeated query id is one query, with its smallest
vector. Ties go to the smaller id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.topk import top_k_per_group

SHARD, TILE, BLOCK, FAN = 8192, 32_768, 512, 32
EXACT = 1 << 53


def usable(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(key, q): floor(scale * x) of the usable vectors."""
    return vectors.filter(usable(vector) & F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("q"))


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of two integer matrices, as doubles where those are exact."""
    most = lambda m: max(1, int(np.abs(m.astype(object)).max())) if m.size else 1
    if most(queries) * most(rows) * max(1, queries.shape[1]) < EXACT:
        return queries.astype(np.float64) @ rows.astype(np.float64).T
    exact = queries.astype(object) @ rows.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1)


def select(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k highest scores outside ``own``; ties to the left."""
    rows, cols = [], []
    if scores.dtype == object or scores.shape[1] <= k:
        for i in range(len(scores)):
            best = sorted((j for j in range(scores.shape[1]) if not own[i, j]), key=lambda j: (-scores[i, j], j))[:k]
            rows += [i] * len(best)
            cols += best
        return np.array(rows, np.int64), np.array(cols, np.int64)
    s = np.where(own, -np.inf, scores)
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
    above = s > least
    level = s == least
    room = k - above.sum(axis=1, keepdims=True)
    chosen = (above | (level & (np.cumsum(level, axis=1) <= room))) & (s > -np.inf)
    return np.nonzero(chosen)


def tile_top(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    """Each query's k best rows of one shard, vectors of equal length only."""
    rows = rows.sort_values("key", kind="stable")
    lengths = rows["q"].map(len).to_numpy()
    for length, some in queries.groupby(queries["q"].map(len)):
        there = rows[lengths == length]
        if there.empty:
            continue
        matrix = np.array(there["q"].tolist(), np.int64).reshape(len(there), length)
        keys = there["key"].to_numpy()
        for at in range(0, len(some), BLOCK):
            part = some.iloc[at:at + BLOCK]
            ids = part["key"].to_numpy()
            scores = products(np.array(part["q"].tolist(), np.int64).reshape(len(part), length), matrix)
            i, j = select(scores, ids[:, None] == keys[None, :], k)
            yield pd.DataFrame({"query_id": ids[i], "vec_id": keys[j],
                                "score": np.array([int(x) for x in scores[i, j]], np.int64)})


def nearest(queries: DataFrame, vectors: DataFrame, k: int, shard: int = SHARD, tile: int = TILE,
            fan: int = FAN) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every row of ``queries(key, q)`` the k rows
    of ``vectors(key, q)`` with another key and the highest inner products."""
    one = queries.groupBy("key").agg(F.min("q").alias("q"))
    total, asked = vectors.count(), queries.count()
    # both sides may come from one table: fresh columns keep them apart in the cogroup
    vectors = vectors.select((F.col("key") + F.lit(0)).alias("key"), F.col("q").alias("q"))
    # equal rows have equal scores: more than k of them can never all be listed, and they are counted, not
    # moved, before they are dealt by key, vector and copy
    vectors = vectors.groupBy("key", "q").agg(F.count(F.lit(1)).alias("copies")).select(
        "key", "q", F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(k)))).alias("copy"))
    shards = max(1, -(-total // shard))
    tiles = max(1, -(-asked // tile))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = one.withColumn("tile", F.pmod(F.xxhash64("key"), F.lit(tiles)).cast("int")).withColumn("shard", numbers(shards))
    right = vectors.withColumn("shard", F.pmod(F.xxhash64("key", "q", "copy"), F.lit(shards)).cast("int")) \
        .withColumn("tile", numbers(tiles)).drop("copy")
    key = dict(queries.dtypes)["key"]

    def run(group: tuple, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        found = list(tile_top(q, v, k))
        out = pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return out.assign(shard=np.int32(group[1]))

    lists = left.groupBy("tile", "shard").cogroup(right.groupBy("tile", "shard")).applyInPandas(
        run, f"query_id {key}, vec_id {key}, score long, shard int")
    order = [F.desc("score"), F.asc("vec_id")]
    while shards > fan:
        lists = top_k_per_group(lists.withColumn("shard", F.floor(F.col("shard") / fan).cast("int")),
                                ["query_id", "shard"], order, k).drop("rank")
        shards = -(-shards // fan)
    return top_k_per_group(lists, "query_id", order, k).select("query_id", "rank", "vec_id", "score")
