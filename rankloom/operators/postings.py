"""BM25 top-k over document-sharded postings with range bounds.

    postings(shard, term, docs, tfs, ranges, range_tf, keys)   bucketed by shard

Documents are dealt to shards of about SHARD_DOCS (or SHARD_TERMS postings) by the hash of their key and numbered within it
in order of their length, RANGE documents of like length to a range. A row holds one term's
postings in one shard: ascending document numbers and term counts, and for every range it occurs
in the largest count, which with the range's smallest length bounds every weight in it, whatever
the average length is. A shard's row with a null term holds its documents' keys and lengths.

A search joins the query terms (broadcast behind a size check) to the postings, so only rows of
query terms leave the scan, and hands each shard to one vectorised function; the table is bucketed
by shard, so nothing is shuffled but each shard's best k rows for each query. There, the lists of terms
in at most SHORT of the documents are added up whole. The ranges' bounds of all longer lists
bound what every document can still gain. The most promising documents are scored first, their
k-th score is the threshold, and of the longer lists, the shorter first, only postings of documents
are scored whose score so far plus the bounds left reaches the threshold. Results equal those of
scoring every document.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.lexical import B, K1, count_terms, floor_idf, idf0_expr, query_terms
from rankloom.operators.topk import RANK_DECIMALS, score_order, top_k_per_group
from rankloom.session import BROADCAST_BYTES, broadcast_below, bucketed_table, ensure_checkpoint_dir, text_bytes, write_bucketed

SHARD_DOCS, SHARD_TERMS = 1 << 12, 1 << 20      # documents and postings of a shard, which one task holds
LEAST_DOCS = 1 << 10        # a small corpus is dealt to the cores down to shards of this size
RANGE = 16
SHORT = 0.08                # of a shard's documents: lists up to this length are added up whole
FIRST = 3                   # times k documents are scored for the first threshold
MARGIN = 10.0 ** -(RANK_DECIMALS - 1)       # a score this close to the k-th may still tie with it
#: A token and its separator take two bytes of text at least, and a query term's row so many.
TERM_BYTES = 64

POSTINGS = "shard int, term string, docs array<int>, tfs array<int>, ranges array<int>, range_tf array<int>, keys array<{key}>"


def inverted(v: pa.Table) -> pa.Table:
    """The rows of one shard from its documents (shard, key, dl, terms, tfs)."""
    v = v.take(pc.sort_indices(v, sort_keys=[("dl", "ascending"), ("key", "ascending")]))
    one = {c: v.column(c).combine_chunks() for c in ("key", "dl", "terms", "tfs")}
    n, sizes = v.num_rows, pc.list_value_length(one["terms"]).to_numpy(zero_copy_only=False)
    words = pc.dictionary_encode(one["terms"].flatten())
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    codes = words.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    codes, docs = codes[order], np.repeat(np.arange(n, dtype=np.int32), sizes)[order]
    tfs = one["tfs"].flatten().to_numpy(zero_copy_only=False).astype(np.int32)[order]
    ends = np.cumsum(np.bincount(codes, minlength=len(words.dictionary)))
    of = docs // RANGE
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(of)), bool), (of[1:] != of[:-1]) | (codes[1:] != codes[:-1]))))
    range_tf = np.maximum.reduceat(tfs, first) if len(first) else tfs
    rows = len(ends) + 1                        # the first has a null term, the documents' keys and lengths
    lists = pa.array(np.concatenate(([0, n], n + ends)), pa.int32())
    whole = np.arange(rows) == 0

    def numbers(head: np.ndarray, values: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(lists, pa.array(np.concatenate((head, values)), pa.int32()))

    in_range = pa.array(np.concatenate(([0, 0], np.searchsorted(first, ends))), pa.int32())
    return pa.table({
        "shard": pa.array(np.full(rows, v.column("shard")[0].as_py()), pa.int32()),
        "term": pa.concat_arrays([pa.nulls(1, words.dictionary.type), words.dictionary]),
        "docs": numbers(np.arange(n), docs), "tfs": numbers(one["dl"].to_numpy(zero_copy_only=False), tfs),
        "ranges": pa.ListArray.from_arrays(in_range, pa.array(of[first], pa.int32()), mask=pa.array(whole)),
        "range_tf": pa.ListArray.from_arrays(in_range, pa.array(range_tf, pa.int32()), mask=pa.array(whole)),
        "keys": pa.ListArray.from_arrays(pa.array(np.append(0, np.full(rows, n)), pa.int32()), one["key"], mask=pa.array(~whole))})


@dataclass
class PostingsIndex:
    postings: DataFrame
    terms: DataFrame
    n: int
    avgdl: float
    shards: int = 1
    gone: DataFrame | None = None           # (key): documents that a newer segment has replaced

    @staticmethod
    def build(corpus: DataFrame, key: str = "key", text: str = "text", path: str | None = None,
              shard_docs: int = SHARD_DOCS, least_docs: int = LEAST_DOCS) -> "PostingsIndex":
        """Write the index of ``corpus`` under ``path`` and read it back. One shuffle brings the counted
        documents to their shard, one the terms to their count."""
        return PostingsIndex.of_counted(count_terms(corpus, key, text).select("key", "dl", "terms", "tfs"), path, shard_docs, least_docs)

    @staticmethod
    def of_counted(counted: DataFrame, path: str | None = None, shard_docs: int = SHARD_DOCS,
                   least_docs: int = LEAST_DOCS) -> "PostingsIndex":
        """The index of documents whose terms are counted: counted(key, dl, terms, tfs)."""
        spark = counted.sparkSession
        path = (path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/rankloom/postings-{uuid.uuid4().hex}").rstrip("/")
        counted.write.mode("overwrite").parquet(f"{path}/counted")
        counted = spark.read.parquet(f"{path}/counted")
        n, held = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms").cast("long")), F.lit(0))).first()
        cores = spark.sparkContext.defaultParallelism
        shards = max(1, -(-n // shard_docs), -(-held // SHARD_TERMS), min(cores, n // least_docs))
        kind = dict(counted.dtypes)["key"]
        placed = counted.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")).repartition(shards, "shard")
        write_bucketed(placed.groupBy("shard").applyInArrow(inverted, POSTINGS.format(key=kind)), f"{path}/postings", "shard", shards)
        whole = counted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
        whole.select("*", F.lit(shards).alias("shards"), F.lit(kind).alias("key_type")).coalesce(1).write.mode("overwrite").json(f"{path}/layout")
        df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        df.write.mode("overwrite").parquet(f"{path}/terms")
        return PostingsIndex.read(spark, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> "PostingsIndex":
        path = path.rstrip("/")
        layout = spark.read.schema("n bigint, avgdl double, shards int, key_type string").json(f"{path}/layout").first()
        postings = bucketed_table(spark, f"{path}/postings", POSTINGS.format(key=layout["key_type"]), "shard", layout["shards"])
        terms = weighted(spark.read.parquet(f"{path}/terms"), layout["n"])
        return PostingsIndex(postings, terms, layout["n"], layout["avgdl"], layout["shards"])


def weighted(terms: DataFrame, n: int) -> DataFrame:
    """terms(term, df) of ``n`` documents with their floored idf."""
    with_idf0 = terms.withColumn("idf0", idf0_expr(F.lit(n)))
    mean = with_idf0.agg(F.coalesce(F.avg("idf0"), F.lit(0.0))).first()[0]
    return floor_idf(with_idf0, mean)


def weight(tf: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
    """The part of a BM25 score that depends on the document."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def kth(scores: np.ndarray, k: int) -> float:
    """The k-th best score, less what may still tie with it; -inf under k scores."""
    return float(np.partition(scores, len(scores) - k)[len(scores) - k]) - MARGIN if len(scores) >= k else -np.inf


@dataclass
class TermList:
    """One term's postings in a shard."""
    docs: np.ndarray
    tfs: np.ndarray
    ranges: np.ndarray
    range_tf: np.ndarray

    def gains(self, docs: np.ndarray, dl: np.ndarray, avgdl: float) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``docs`` (ascending) of those that hold the term, and their weights."""
        if len(docs) < len(self.docs):
            place = np.minimum(np.searchsorted(self.docs, docs), len(self.docs) - 1)
            hit = np.flatnonzero(self.docs[place] == docs)
            place = place[hit]
        else:
            at = np.minimum(np.searchsorted(docs, self.docs), len(docs) - 1)
            place = np.flatnonzero(docs[at] == self.docs)
            hit = at[place]
        return hit, weight(self.tfs[place], dl[docs[hit]], avgdl)


def top_of_shard(lists: list[tuple[float, TermList]], dl: np.ndarray, keys: np.ndarray, avgdl: float,
                 k: int, alive: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(document numbers, scores, postings scored) of the k best documents of one shard for one query, whose
    terms are (query weight, postings); positive scores of documents that are ``alive`` only."""
    n, scores, scored = len(dl), np.zeros(len(dl)), 0
    left, longer = np.zeros(-(-n // RANGE)), []
    for q, t in sorted(lists, key=lambda x: len(x[1].docs)):
        if q <= 0 or len(t.docs) <= n * SHORT:              # a weight under zero bounds nothing
            scores[t.docs] += q * weight(t.tfs, dl[t.docs], avgdl)
            scored += len(t.docs)
        else:
            bound = np.zeros(len(left))
            bound[t.ranges] = q * weight(t.range_tf, dl[t.ranges * RANGE], avgdl)
            left += bound
            longer.append((q, t, bound))
    most = scores + np.repeat(left, RANGE)[:n]
    going, least = np.flatnonzero((most > 0) if alive is None else (most > 0) & alive), -np.inf
    if longer and len(going) > FIRST * k:
        some = np.sort(going[np.argpartition(-most[going], FIRST * k)[:FIRST * k]])
        exact = scores[some]
        for q, t, _ in longer:
            hit, gain = t.gains(some, dl, avgdl)
            exact[hit] += q * gain
            scored += len(hit)
        least = kth(exact, k)
        going = going[most[going] >= least]
    for q, t, bound in longer:
        hit, gain = t.gains(going, dl, avgdl) if len(going) else (np.zeros(0, np.int64), 0.0)
        scores[going[hit]] += q * gain
        scored += len(hit)
        left = left - bound + 1e-12                         # never under what is left
        going = going[scores[going] + left[going // RANGE] >= least]
        least = max(least, kth(scores[going], k))
    going = going[scores[going] > 0]
    best = going[np.lexsort((keys[going], -np.round(scores[going], RANK_DECIMALS)))[:k]]
    return best, scores[best], scored


def search(queries: DataFrame, index: PostingsIndex, k: int, qid: str = "query_id", text: str = "query_text") -> DataFrame:
    """(query_id, key, score, scored, held): each shard's k best documents for each query, with the postings
    scored and held there for the query's terms on its first row; a null key where nothing is found."""
    known = query_terms(queries, qid, text).join(index.terms.select("term", "idf"), "term") \
        .groupBy("term").agg(F.collect_list(F.struct("query_id", (F.col("qtf") * F.col("idf")).alias("weight"))).alias("asked"))
    if text_bytes(queries, text) * (1 + TERM_BYTES // 2) > BROADCAST_BYTES:
        raise ValueError("too many queries for one search: cut them, or use lexical.bm25_top_k, which shuffles")
    # a left join, which keeps the buckets in place; a shard's documents come with it
    rows = index.postings.join(F.broadcast(known), "term", "left").filter(F.col("asked").isNotNull() | F.col("term").isNull())
    if index.gone is not None:
        # of one segment, so no more of them than it has documents; beyond the bound the join shuffles
        lost = index.gone.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(index.shards)).cast("int")).groupBy("shard").agg(
            F.collect_list("key").alias("gone"))
        rows = rows.join(broadcast_below(lost, index.gone.count() * TERM_BYTES), "shard", "left")
    types = {"query_id": known.schema["asked"].dataType.elementType["query_id"].dataType.simpleString(),
             "key": index.postings.schema["keys"].dataType.elementType.simpleString()}
    avgdl = index.avgdl or 1.0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return shard_results(pdf, avgdl, k)

    return rows.groupBy("shard").applyInPandas(
        run, f"query_id {types['query_id']}, key {types['key']}, score double, scored long, held long")


def shard_results(pdf: pd.DataFrame, avgdl: float, k: int) -> pd.DataFrame:
    whole = pdf[pdf["term"].isna()]
    dl, keys = np.asarray(whole["tfs"].iloc[0], np.float64), np.asarray(whole["keys"].iloc[0])
    gone = whole["gone"].iloc[0] if "gone" in whole else None
    alive = None if gone is None else ~np.isin(keys, gone)
    of_query: dict = {}
    for *parts, asked in pdf.loc[pdf["term"].notna(), ["docs", "tfs", "ranges", "range_tf", "asked"]].itertuples(index=False):
        for x in asked:
            of_query.setdefault(x["query_id"], []).append((x["weight"], TermList(*parts)))
    out = []
    for query, lists in of_query.items():
        found, scores, scored = top_of_shard(lists, dl, keys, avgdl, k, alive)
        rows = [(query, keys[d], s, 0, 0) for d, s in zip(found, scores, strict=True)] or [(query, None, None, 0, 0)]
        out.append((*rows[0][:3], scored, sum(len(t.docs) for _, t in lists)))
        out += rows[1:]
    return pd.DataFrame(out, columns=["query_id", "key", "score", "scored", "held"])


def top_k(queries: DataFrame, index: PostingsIndex, k: int, **kw) -> DataFrame:
    """G2 + C5: (query_id, key, score, rank), the k best documents per query, positives only; equal to
    ``lexical.bm25_top_k``."""
    found = search(queries, index, k, **kw).filter(F.col("score") > 0).select("query_id", "key", "score")
    return top_k_per_group(found, "query_id", score_order(), k)


def share_scored(queries: DataFrame, index: PostingsIndex, k: int, **kw) -> DataFrame:
    """(query_id, scored, held): postings scored of those held for each query's terms."""
    return search(queries, index, k, **kw).groupBy("query_id").agg(F.sum("scored").alias("scored"), F.sum("held").alias("held"))
