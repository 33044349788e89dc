"""Document-sharded text index and BM25.

    documents(key, dl, norm, terms, buckets, tfs)   one row per document, bucketed by key
    terms(term, df, idf)                            idf with the Okapi negative-idf floor
    corpus statistics                               n, avgdl, avg_idf

A document's terms are counted inside its row (no shuffle); the row also holds the hashing
encoder's bucket of each term and the vector's norm, so one table serves both searches.

Scoring streams the documents past the broadcast query terms and sums per (query, document).
The table is bucketed by document key, so all of a document's terms are in one task: Spark
finishes the sums there, and only each task's best k rows per query are shuffled. Beyond the
proven broadcast size the join shuffles by term and the sums by (query, document) instead.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rankloom.functions.text import tokens
from rankloom.operators import blocks
from rankloom.operators.dense import HASH_DIM, hash_bucket
from rankloom.operators.topk import score_order, top_k_per_group
from rankloom.session import broadcast_below, bucketed_table, ensure_checkpoint_dir, exists, text_bytes, without_shuffle_files, write_bucketed

# The Okapi BM25 defaults the reference uses.
K1 = 1.5
B = 0.75
EPSILON = 0.25

DOCUMENTS_SCHEMA = "key {key}, dl int, norm double, terms array<string>, buckets array<bigint>, tfs array<int>"
# Text of a bucket: the scans of an index have as many tasks as it has buckets, so their number
# follows the corpus.
BUCKET_BYTES = 128 << 20
# A token and its separator take two bytes of text at least, a query-term row at most the
# term and ROW_BYTES: the bound on the broadcast size that follows from the text's size.
ROW_BYTES = 64


def count_terms(corpus: DataFrame, key: str = "key", text: str = "text", dim: int = HASH_DIM) -> DataFrame:
    """documents(key, dl, norm, terms, buckets, tfs): sorted distinct terms of each row with
    their counts, all within the row. Each step is a projection of its own, so that no array
    is computed twice."""
    ordered = corpus.select(F.col(key).alias("key"), F.sort_array(tokens(F.coalesce(text, F.lit("")))).alias("s"))
    places = F.when(F.size("s") > 0, F.sequence(F.lit(0), F.size("s") - 1)).otherwise(F.array().cast("array<int>"))
    starts = ordered.select("key", F.size("s").alias("dl"), F.array_distinct("s").alias("terms"), F.filter(
        places, lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1))).alias("starts"))
    counted = starts.select("key", "dl", "terms", F.transform("terms", lambda t: hash_bucket(t, dim)).alias("buckets"),
                            F.transform("starts", lambda p, j: F.coalesce(F.get("starts", j + 1), F.col("dl")) - p).alias("tfs"))
    # terms that share a bucket add up before the square
    pairs = F.sort_array(F.zip_with("buckets", "tfs", lambda b, n: F.struct(b.alias("b"), n.cast("double").alias("n"))))
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).cast("bigint").alias("b"), F.lit(0.0).alias("run"))
    norm = F.aggregate(pairs, zero, lambda a, x: F.when(a["b"] == x["b"], F.struct(
        a["sum"].alias("sum"), a["b"].alias("b"), (a["run"] + x["n"]).alias("run"))).otherwise(F.struct(
            (a["sum"] + a["run"] * a["run"]).alias("sum"), x["b"].alias("b"), x["n"].alias("run"))),
        lambda a: F.sqrt(a["sum"] + a["run"] * a["run"]))
    return counted.select("key", "dl", norm.alias("norm"), "terms", "buckets", "tfs")


@dataclass
class LexicalIndex:
    documents: DataFrame
    terms: DataFrame
    stats: DataFrame          # one row: n, avgdl, avg_idf, buckets
    avgdl: float
    blocked: dict = field(default_factory=dict)     # by dim: the documents as ``operators.blocks`` reads them

    @staticmethod
    def build(corpus: DataFrame, key: str = "key", text: str = "text", path: str | None = None,
              buckets: int | None = None, dim: int = HASH_DIM) -> "LexicalIndex":
        """Write the index under ``path`` (default: a folder of the shared checkpoint dir) and
        read it back. Two shuffles: rows to their bucket, and terms to their count."""
        spark = corpus.sparkSession
        path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/rankloom/index-{uuid.uuid4().hex}"
        n_buckets = buckets or max(2 * spark.sparkContext.defaultParallelism, -(-text_bytes(corpus, text) // BUCKET_BYTES))
        # the texts go to their bucket, not the counted terms, which are several times as large
        dealt = corpus.select(F.col(key).alias("key"), F.col(text).alias("text")).repartition(n_buckets, "key")
        counted = count_terms(dealt, "key", "text", dim)
        write_bucketed(counted, f"{path}/documents", "key", n_buckets)
        spark.createDataFrame([(n_buckets, dict(counted.dtypes)["key"])], "buckets int, key_type string") \
             .coalesce(1).write.mode("overwrite").json(f"{path}/layout")
        documents = _read_documents(spark, path)
        whole = documents.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
        counts = documents.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        raw = counts.select("term", "df", idf0_expr(whole.select("n").scalar()).alias("idf0"))
        with without_shuffle_files(spark):
            raw.write.mode("overwrite").parquet(f"{path}/terms")
        mean = spark.read.parquet(f"{path}/terms").agg(F.coalesce(F.avg("idf0"), F.lit(0.0))).scalar()
        whole.select("n", "avgdl", mean.alias("avg_idf")).write.mode("overwrite").parquet(f"{path}/corpus_stats")
        return LexicalIndex.read(spark, path)

    @staticmethod
    def read(spark: SparkSession, path: str, lenient: bool = False) -> "LexicalIndex":
        """A written index. With ``lenient`` a missing part is an empty table (A10): searches
        then find nothing on this side."""
        path = path.rstrip("/")
        if lenient and not all(exists(spark, f"{path}/{part}") for part in ("layout", "documents", "terms", "corpus_stats")):
            documents = spark.createDataFrame([], DOCUMENTS_SCHEMA.format(key="bigint"))
            terms = spark.createDataFrame([], "term string, df bigint, idf0 double, idf double")
            return LexicalIndex(documents, terms, spark.createDataFrame([(0, 0.0, 0.0)], "n bigint, avgdl double, avg_idf double"), 0.0)
        stats = spark.read.parquet(f"{path}/corpus_stats")
        row = stats.first()
        terms = floor_idf(spark.read.parquet(f"{path}/terms"), float(row["avg_idf"]))
        return LexicalIndex(_read_documents(spark, path), terms, stats, float(row["avgdl"]))

    def blocks(self, dim: int) -> DataFrame:
        """The documents as blocks, written at the first search that needs them."""
        if dim not in self.blocked:
            spark = self.documents.sparkSession
            size = self.stats.select("n", "avgdl").first()
            path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rankloom/blocks-{uuid.uuid4().hex}"
            self.blocked[dim] = blocks.written(self.documents, size["n"], size["avgdl"], dim, path)
        return self.blocked[dim]


def _read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The bucketed documents as a table of the session's catalog, which holds the bucketing."""
    layout = spark.read.schema("buckets int, key_type string").json(f"{path}/layout").first()
    return bucketed_table(spark, f"{path}/documents", DOCUMENTS_SCHEMA.format(key=layout["key_type"]), "key", layout["buckets"])


def idf0_expr(n: Column) -> Column:
    return F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def floor_idf(with_idf0: DataFrame, avg_idf: float) -> DataFrame:
    """Negative raw idf is replaced by EPSILON * mean(raw idf) over the whole vocabulary."""
    return with_idf0.withColumn(
        "idf", F.when(F.col("idf0") < 0, F.lit(EPSILON * avg_idf)).otherwise(F.col("idf0")))


def query_terms(queries: DataFrame, qid: str = "query_id", text: str = "query_text") -> DataFrame:
    """(query_id, term, qtf): repeated query tokens count again (qtf multiplies)."""
    return (queries.select(F.col(qid).alias("query_id"), F.explode(tokens(text)).alias("term"))
                   .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))


def query_side(rows: DataFrame, queries: DataFrame, text: str, row_bytes: int = ROW_BYTES // 2) -> DataFrame:
    """``rows`` (at most one for each token of the queries) with a broadcast hint if the
    queries' text proves them small; ``row_bytes`` of a row for each byte of text."""
    return broadcast_below(rows, text_bytes(queries, text) * (1 + row_bytes))


def bm25_scores(queries: DataFrame, index: LexicalIndex, qid: str = "query_id",
                text: str = "query_text") -> DataFrame:
    """(query_id, key, score) for every document sharing a term with the query. Unknown query
    terms match nothing (add 0)."""
    known = query_terms(queries, qid, text).join(index.terms.select("term", "idf"), "term") \
        .select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("qw"))
    each = index.documents.select("key", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("x")) \
        .select("key", "dl", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit(index.avgdl or 1.0))
    weight = F.col("qw") * (F.col("tf") * F.lit(K1 + 1)) / (F.col("tf") + norm)
    return (each.join(query_side(known, queries, text), "term")
                .groupBy("query_id", "key").agg(F.sum(weight).alias("score")))


def hashed_scores(queries: DataFrame, query_vectors: DataFrame, index: LexicalIndex, text: str = "query_text") -> DataFrame:
    """E5 over hashing-encoder vectors: (query_id, key, score) for pairs that share a bucket.
    ``query_vectors(query_id, bucket, weight)`` are those of ``queries``."""
    q = query_vectors.select("query_id", "bucket", F.col("weight").alias("wq"))
    each = index.documents.select("key", "norm", F.explode(F.arrays_zip("buckets", "tfs")).alias("x")) \
        .select("key", "norm", F.col("x.buckets").alias("bucket"), F.col("x.tfs").alias("tf"))
    return (each.join(query_side(q, queries, text), "bucket")
                .groupBy("query_id", "key").agg(F.sum(F.col("wq") * F.col("tf") / F.col("norm")).alias("score")))


def pair_side(queries: DataFrame, index: LexicalIndex, dim: int = HASH_DIM, qid: str = "query_id",
              text: str = "query_text", tiles: int | None = None) -> DataFrame:
    """(query_id, bucket, asked, qw, wq): the queries' terms with both weights; qw is null for a term that no
    document has. A query's bucket counts once for each document's bucket: its weight is on the row of
    one of its terms. Two shuffles, by term and by query (to ``tiles`` partitions)."""
    each = queries.select(F.col(qid).alias("query_id"), F.explode(tokens(text)).alias("term"))
    found = each.join(index.terms.select("term", "idf"), "term", "left")
    found = found.repartition("query_id") if tiles is None else found.repartition(tiles, "query_id")
    rows = found.groupBy("query_id", "term").agg(F.count(F.lit(1)).cast("double").alias("qtf"), F.max("idf").alias("idf")).select(
        "query_id", "term", "qtf", (F.col("qtf") * F.col("idf")).alias("qw"), hash_bucket("term", dim).alias("bucket"))
    shared = W.partitionBy("query_id", "bucket")
    rows = rows.withColumn("c", F.when(F.row_number().over(shared.orderBy("term")) == 1, F.sum("qtf").over(shared)).otherwise(0.0))
    norm = F.sqrt(F.sum(F.col("c") * F.col("c")).over(W.partitionBy("query_id")))
    return rows.select("query_id", "bucket", F.col("term").alias("asked"), "qw", (F.col("c") / norm).alias("wq"))


def pair_scores(queries: DataFrame, index: LexicalIndex, dim: int = HASH_DIM, qid: str = "query_id",
                text: str = "query_text") -> DataFrame:
    """(query_id, key, dense, bm25): the scores of ``hashed_scores`` and ``bm25_scores`` from one pass over
    the documents, for pairs that share a bucket (so all that share a term); bm25 is null without a
    shared term. Every pair is a row: for the best of each query ``best_pairs`` makes none."""
    side = pair_side(queries, index, dim, qid, text)
    each = index.documents.select("key", "dl", "norm", F.explode(F.arrays_zip("terms", "buckets", "tfs")).alias("x")) \
        .select("key", "dl", "norm", F.col("x.terms").alias("term"), F.col("x.buckets").alias("bucket"), F.col("x.tfs").alias("tf"))
    by_length = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit(index.avgdl or 1.0))
    weight = F.col("qw") * (F.col("tf") * F.lit(K1 + 1)) / (F.col("tf") + by_length)
    return (each.join(query_side(side, queries, text, ROW_BYTES), "bucket")
                .groupBy("query_id", "key").agg(F.sum(F.col("wq") * F.col("tf") / F.col("norm")).alias("dense"),
                                                F.sum(F.when(F.col("asked") == F.col("term"), weight)).alias("bm25")))


def best_pairs(queries: DataFrame, index: LexicalIndex, n: int, dim: int = HASH_DIM, qid: str = "query_id",
               text: str = "query_text", lists: tuple[str, ...] = ("dense", "bm25")) -> DataFrame:
    """(query_id, key, list, score): of the pairs of ``pair_scores`` those with the n best positive scores of
    each query and list (0 dense, 1 bm25; the place in ``lists``), at least; in blocks (``operators.blocks``)."""
    asked = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()
    tiles = blocks.tiles(queries.sparkSession, *asked)
    if lists == ("bm25",):
        side = query_terms(queries, qid, text).join(index.terms.select("term", "idf"), "term").select(
            "query_id", hash_bucket("term", dim).alias("bucket"), F.col("term").alias("asked"),
            (F.col("qtf") * F.col("idf")).alias("qw"), F.lit(None).cast("double").alias("wq")).repartition(tiles, "query_id")
    else:
        side = pair_side(queries, index, dim, qid, text, tiles)
    side = side.select("query_id", blocks.code(F.col("asked"), F.col("bucket"), dim).alias("code"), "wq", "qw")
    avgdl = index.avgdl or 1.0
    return blocks.best_documents(side, index.blocks(dim), dict(index.documents.dtypes)["key"], n, tiles, dim, lists,
                                 lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl)))


def bm25_top_k(queries: DataFrame, index: LexicalIndex, k: int, dim: int = HASH_DIM, **kw) -> DataFrame:
    """G2 + C5: the k best documents per query, positives only; rank 1-based."""
    found = best_pairs(queries, index, k, dim, lists=("bm25",), **kw).select("query_id", "key", "score")
    return top_k_per_group(found, "query_id", score_order(), k)
