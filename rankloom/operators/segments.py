"""An index that takes new documents: immutable segments under a versioned list.

    segments/<id>/      a postings index of the documents of one append, never changed
    replaced/<id>/      (segment, key): documents of older segments that an append replaces
    versions/<n>/       the segments and replacements that version n is made of

An append writes its segment, then what it replaces, and last the next version; a version that is
written whole is the current one, so a reader has all of an append or none of it, and two writers of one
version collide instead of losing an append. A running stream that asks for ``current()`` in each
micro-batch works on the newest version from its next batch on, while an older reader's files stay.

Statistics are those of all live documents: n, total length and document frequencies of the segments
are added up when a version is read, less those of the replaced documents (whose counted terms the segments
keep), so scores equal those of one index built of the live documents. ``merge`` puts small segments
together from their counted terms, without the texts.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rankloom.operators import postings
from rankloom.operators.lexical import count_terms
from rankloom.operators.topk import score_order, top_k_per_group
from rankloom.session import exists

VERSION = "segments array<string>, replaced array<string>"
SMALL = 1 << 14             # documents of a segment that ``merge`` takes up


class SegmentedIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        """Number of the current version: the last one that is written whole; 0 before the first."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            return 0
        found = [int(f.getPath().getName()) for f in files.listStatus(path)]
        return max((n for n in found if exists(self.spark, f"{self.path}/versions/{n}/_SUCCESS")), default=0)

    def _parts(self, version: int) -> tuple[list[str], list[str]]:
        if not version:
            return [], []
        row = self.spark.read.schema(VERSION).json(f"{self.path}/versions/{version}").first()
        return list(row["segments"]), list(row["replaced"])

    def _switch(self, version: int, segments: list[str], replaced: list[str]) -> None:
        # an existing version is an error: another writer was first
        self.spark.createDataFrame([(segments, replaced)], VERSION).coalesce(1).write.json(f"{self.path}/versions/{version}")

    def _segment(self, name: str) -> str:
        return f"{self.path}/segments/{name}"

    def _gone(self, replaced: list[str], segments: list[str]) -> DataFrame | None:
        """(segment, key) of the replaced documents of ``segments``."""
        parts = [self.spark.read.parquet(f"{self.path}/replaced/{r}") for r in replaced]
        return reduce(DataFrame.unionByName, parts).filter(F.col("segment").isin(segments)).distinct() if parts else None

    def _counted(self, segments: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self._segment(s)}/counted").withColumn("segment", F.lit(s))
                                              for s in segments])

    def append(self, corpus: DataFrame, key: str = "key", text: str = "text") -> int:
        """Add documents, in place of those that have one of their keys; returns the new version. Of a key
        that repeats in ``corpus`` one row is taken, the smallest text."""
        before = self.version()
        segments, replaced = self._parts(before)
        name = uuid.uuid4().hex
        one = corpus.select(F.col(key).alias("key"), F.col(text).alias("text")).groupBy("key").agg(F.min("text").alias("text"))
        postings.PostingsIndex.of_counted(count_terms(one).select("key", "dl", "terms", "tfs"), self._segment(name))
        if segments:
            new = self.spark.read.parquet(f"{self._segment(name)}/counted").select("key")
            old = self._counted(segments).select("segment", "key").join(new, "key", "left_semi")
            old.select("segment", "key").write.parquet(f"{self.path}/replaced/{name}")
            replaced = [*replaced, name]
        self._switch(before + 1, [*segments, name], replaced)
        return before + 1

    def merge(self, small: int = SMALL) -> int:
        """Put the segments of at most ``small`` live documents together; returns the current version."""
        before = self.version()
        segments, replaced = self._parts(before)
        if not segments:
            return before
        live = self._live(segments, replaced)
        sizes = {r["segment"]: r["count"] for r in live.groupBy("segment").count().collect()}
        taken = [s for s in segments if sizes.get(s, 0) <= small]
        if len(taken) < 2:
            return before
        name = uuid.uuid4().hex
        postings.PostingsIndex.of_counted(live.filter(F.col("segment").isin(taken)).drop("segment"), self._segment(name))
        kept = [s for s in segments if s not in taken]
        self._switch(before + 1, [*kept, name], replaced if kept else [])
        return before + 1

    def _live(self, segments: list[str], replaced: list[str]) -> DataFrame:
        counted, gone = self._counted(segments), self._gone(replaced, segments)
        return counted if gone is None else counted.join(gone, ["segment", "key"], "left_anti")

    def current(self, version: int | None = None) -> "Snapshot":
        """The current version, or an older one whose segments are still there."""
        version = self.version() if version is None else version
        segments, replaced = self._parts(version)
        if not segments:
            return Snapshot(version, [])
        gone = self._gone(replaced, segments)
        dead = None if gone is None else self._counted(segments).join(gone, ["segment", "key"], "left_semi")
        df = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self._segment(s)}/terms") for s in segments])
        if dead is not None:
            df = df.unionByName(dead.select(F.explode("terms").alias("term")).select("term", F.lit(-1).cast("long").alias("df")))
        df = df.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        each = [postings.PostingsIndex.read(self.spark, self._segment(s)) for s in segments]
        n, length = sum(i.n for i in each), sum(i.n * i.avgdl for i in each)
        if dead is not None:
            lost = dead.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
            n, length = n - lost[0], length - lost[1]
        terms = postings.weighted(df, n)
        for name, index in zip(segments, each, strict=True):
            index.terms, index.n, index.avgdl = terms, n, length / max(n, 1)
            index.gone = None if gone is None else gone.filter(F.col("segment") == name).select("key")
        return Snapshot(version, each)


class Snapshot:
    """One version of a segmented index."""

    def __init__(self, version: int, segments: list[postings.PostingsIndex]):
        self.version, self.segments = version, segments

    def top_k(self, queries: DataFrame, k: int, **kw) -> DataFrame:
        """(query_id, key, score, rank) of all segments, as one index of the live documents gives them."""
        if not self.segments:
            none = queries.select(F.col(kw.get("qid", "query_id")).alias("query_id"), F.lit(None).cast("long").alias("key"),
                                  F.lit(0.0).alias("score")).limit(0)
            return none.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score")))
        found = reduce(DataFrame.unionByName, [postings.search(queries, s, k, **kw).select("query_id", "key", "score")
                                               for s in self.segments])
        return top_k_per_group(found.filter(F.col("score") > 0), "query_id", score_order(), k)
