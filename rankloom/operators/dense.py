"""Dense side: encoders, normalisation, exact inner-product top-k.

Two exact similarity plans:

* ``lexical.hashed_scores`` - the built-in hashing encoder's sparse vectors live in the
  document index; only documents sharing a bucket with the query are touched.
* ``exact_top_k`` - dense ``array<float>`` vectors: queries and vectors are cut into tiles
  and blocks of bounded size, and each pair of them meets once in a cogrouped pandas
  function, as a matrix product that emits only per-query top-k lists; no pair rows are
  materialised and no group grows with the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql import Window as W

from rankloom.functions.text import tokens
from rankloom.operators.topk import RANK_DECIMALS, score_order, top_k_per_group

HASH_DIM = 1 << 18          # buckets of the default hashing encoder
BLOCK_ROWS = 8192           # vectors per block of the tiled matrix product
TILE_ROWS = 4096            # queries per tile
SCORES_AT_ONCE = 4 << 20    # scores of a tile and block held at a time


def hash_bucket(term, dim: int = HASH_DIM) -> Column:
    """Bucket = first 8 hex digits of md5(term) as an integer, modulo dim."""
    t = F.col(term) if isinstance(term, str) else term
    return F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint"), F.lit(dim))


def hash_vectors(df: DataFrame, key: str, text: str, dim: int = HASH_DIM,
                 key_alias: str = "key") -> DataFrame:
    """B13 default encoder: (key, bucket, weight) = term counts per bucket, L2-normalised.

    A deterministic stand-in for a semantic model (see K1 ``encode_with`` for a real one).
    """
    counts = (df.select(F.col(key).alias(key_alias), F.explode(tokens(text)).alias("term"))
                .select(key_alias, hash_bucket("term", dim).alias("bucket"))
                .groupBy(key_alias, "bucket").agg(F.count(F.lit(1)).cast("double").alias("c")))
    norm = F.sqrt(F.sum(F.col("c") * F.col("c")).over(W.partitionBy(key_alias)))
    return counts.select(key_alias, "bucket", (F.col("c") / norm).alias("weight"))


def dot(a, b) -> Column:
    """E5 as an expression: sum of pairwise products, in double."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def l2_normalize(v) -> Column:
    """Unit length so that dot = cosine; the zero vector is returned unchanged."""
    v = F.col(v) if isinstance(v, str) else v
    norm = F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(
        F.transform(v, lambda x: x.cast("double")))


def usable(vector: str) -> Column:
    """True for a vector that has components, all of them finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def _top_k_arrays(qids: np.ndarray, qm: np.ndarray, keys: np.ndarray, vm: np.ndarray, k: int,
                  exclude_same_key: bool) -> pd.DataFrame:
    """Per-query top-k of one (queries x vectors) block: rank on the score rounded to
    RANK_DECIMALS, ties to the smaller key (the engine-wide order). Whole-block array
    operations; columns are in key order, so the first of equal scores has the smaller key."""
    order = np.argsort(keys, kind="stable")
    keys, vm = keys[order], vm[order]
    s = qm @ vm.T
    if exclude_same_key:
        s[qids[:, None] == keys[None, :]] = -np.inf
    r = np.round(s, RANK_DECIMALS)
    kk = min(k, r.shape[1])
    least = np.partition(r, r.shape[1] - kk, axis=1)[:, r.shape[1] - kk, None]
    above, level = r > least, r == least
    room = kk - above.sum(axis=1, keepdims=True)
    i, j = np.nonzero((above | (level & (np.cumsum(level, axis=1) <= room))) & np.isfinite(s))
    return pd.DataFrame({"query_id": qids[i], "key": keys[j], "score": s[i, j]})


def top_of_block(qids: np.ndarray, qm: np.ndarray | None, keys: np.ndarray, vm: np.ndarray | None, k: int,
                 exclude_same_key: bool, at_once: int = SCORES_AT_ONCE) -> pd.DataFrame:
    """Per-query top-k of queries against a block of vectors of their length, a bounded matrix of
    scores at a time."""
    if qm is None or vm is None:
        return pd.DataFrame({"query_id": qids[:0], "key": keys[:0], "score": np.zeros(0)})
    step = max(1, at_once // len(keys))
    return pd.concat([_top_k_arrays(qids[a:a + step], qm[a:a + step], keys, vm, k, exclude_same_key)
                      for a in range(0, len(qids), step)], ignore_index=True)


def _matrix(col: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(x, dtype=np.float64) for x in col])


def _block_top_k(k: int, exclude_same_key: bool):
    """One cogroup: a tile of queries against a block of vectors, lengths apart."""
    def fn(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        found = []
        for length, some in q.groupby(q["embedding"].map(len)):
            there = v[v["embedding"].map(len) == length]
            if len(there):
                found.append(top_of_block(some["query_id"].to_numpy(), _matrix(some["embedding"]), there["key"].to_numpy(),
                                          _matrix(there["embedding"]), k, exclude_same_key))
        return pd.concat(found, ignore_index=True) if found else top_of_block(
            q["query_id"].to_numpy(), None, v["key"].to_numpy(), None, k, exclude_same_key)
    return fn


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int, *,
                qid: str = "query_id", q_vec: str = "embedding",
                key: str = "key", v_vec: str = "embedding",
                exclude_same_key: bool = False, block_rows: int = BLOCK_ROWS,
                tile_rows: int = TILE_ROWS) -> DataFrame:
    """D3 + G1: exact inner-product top-k of every query over every vector.

    One plan for any number of queries: queries are hashed into tiles of about
    ``tile_rows``, vectors into blocks of about ``block_rows``, and each (tile, block) meets
    once as a matrix product that gives at most k rows per query. Exactness costs |Q| * |V|
    products; the shuffle holds |V| * |Q| / tile_rows + |Q| * |V| / block_rows rows, so larger
    tiles and blocks (both bounded by a task's memory) move less. No side is collected.

    Vectors that are null, empty, or hold a null or non-finite component, and null keys, take no part;
    vectors of different lengths are not compared. A repeated query key is one query (its smallest
    vector). Repeated vectors are candidates each; equal rows beyond k can never all be listed, so k
    of them are dealt, by key, vector and copy, and a key that repeats is no one task's work.
    """
    # fresh columns: both sides may come from one table
    doubles = lambda c: F.transform(c, lambda x: x.cast("double"))
    q = queries.filter(usable(q_vec) & F.col(qid).isNotNull()).groupBy(F.col(qid).alias("query_id")).agg(
        F.min(doubles(q_vec)).alias("embedding"))
    v = vectors.filter(usable(v_vec) & F.col(key).isNotNull()).groupBy(F.col(key).alias("key"), doubles(v_vec).alias("embedding")).agg(
        F.count(F.lit(1)).alias("copies"))
    v = v.select("key", "embedding", F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(k)))).alias("copy"))
    kinds = (dict(q.dtypes)["query_id"], dict(v.dtypes)["key"])
    nq = max(1, math.ceil(queries.count() / tile_rows))
    nv = max(1, math.ceil(vectors.count() / block_rows))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    qb = q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(nq))).withColumn("vb", numbers(nv))
    vb = v.withColumn("vb", F.pmod(F.xxhash64("key", "embedding", "copy"), F.lit(nv))).withColumn("qb", numbers(nq))
    per_block = (qb.groupBy("qb", "vb").cogroup(vb.select("key", "embedding", "vb", "qb").groupBy("qb", "vb"))
                   .applyInPandas(_block_top_k(k, exclude_same_key),
                                  schema=f"query_id {kinds[0]}, key {kinds[1]}, score double"))
    return top_k_per_group(per_block, "query_id", score_order(), k)


def manifest(vectors: DataFrame, model_name: str, vec: str = "embedding",
             index_type: str = "exact_inner_product") -> DataFrame:
    """One-row index manifest computed from the vector table itself."""
    return vectors.agg(F.lit(model_name).alias("model_name"),
                       F.max(F.size(vec)).cast("int").alias("dimension"),
                       F.count(F.lit(1)).alias("num_assessments"),
                       F.lit(index_type).alias("index_type"))


def encode_with(df: DataFrame, text: str, encoder_factory, dim: int,
                out: str = "embedding") -> DataFrame:
    """K1 encoder hook: ``encoder_factory()`` is called once per Python worker and must
    return ``f(list[str]) -> np.ndarray (n, dim)``; vectors come back L2-normalised."""
    @pandas_udf("array<float>")
    def _enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder_factory()
        for s in batches:
            m = np.asarray(model(s.fillna("").tolist()), dtype=np.float32).reshape(len(s), dim)
            n = np.linalg.norm(m, axis=1, keepdims=True)
            m = np.where(n > 0, m / np.where(n > 0, n, 1), m)
            yield pd.Series(list(m))

    return df.withColumn(out, _enc(F.col(text)))
