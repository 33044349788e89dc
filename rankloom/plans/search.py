"""Text search over one corpus: the document index with both searches, and the
retrieve pipeline on top (SURVEY L2, G3, G4, C3, F2, B21)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import keyword_text, rich_text
from rankloom.operators import dense, lexical
from rankloom.operators.diversity import diversify_few, duration_filter
from rankloom.operators.fusion import hybrid_top_k, hybrid_top_k_of_lists
from rankloom.operators.topk import score_order, top_k_per_group

DEFAULT_ALPHA = 0.5
RETRIEVE_ALPHA = 0.6
MAX_FUSED = 60
MAX_PER_CATEGORY = 4
DEFAULT_CATEGORY = "General Assessment"


_BUILT: dict = {}


def search_for(corpus_id: str, corpus: DataFrame) -> "TextSearch":
    """The index of one corpus, built once per Spark application and reused by later
    queries (the reference also loads its index once at engine start)."""
    spark = corpus.sparkSession
    k = (spark.sparkContext.applicationId, corpus_id)
    if k not in _BUILT:
        _BUILT[k] = TextSearch.build(corpus)
    return _BUILT[k]


@dataclass
class TextSearch:
    index: lexical.LexicalIndex
    dim: int = dense.HASH_DIM
    encoded: lexical.LexicalIndex | None = None      # index of the encoder's texts, if they differ

    @staticmethod
    def build(corpus: DataFrame, key: str = "key", text: str = "text",
              dim: int = dense.HASH_DIM, path: str | None = None) -> "TextSearch":
        return TextSearch(lexical.LexicalIndex.build(corpus, key, text, path, dim=dim), dim)

    @staticmethod
    def of_catalog(catalog: DataFrame, dim: int = dense.HASH_DIM, path: str | None = None) -> "TextSearch":
        """L2 over catalog rows: the keyword text (B11) for BM25, the rich text (B10) for the
        encoder, absent fields with their defaults (B27)."""
        fields = ("assessment_name", "description", "test_type")
        words = catalog.select("key", keyword_text(*fields).alias("text"))
        rich = catalog.select("key", rich_text(*fields, "duration_minutes", "remote_support", "adaptive_support").alias("text"))
        part = (lambda name: None) if path is None else (lambda name: f"{path.rstrip('/')}/{name}")
        return TextSearch(lexical.LexicalIndex.build(words, path=part("keyword"), dim=dim), dim,
                          lexical.LexicalIndex.build(rich, path=part("rich"), dim=dim))

    def bm25(self, queries: DataFrame) -> DataFrame:
        return lexical.bm25_scores(queries, self.index)

    def dense(self, queries: DataFrame) -> DataFrame:
        qv = dense.hash_vectors(queries, "query_id", "query_text", self.dim, key_alias="query_id")
        return lexical.hashed_scores(queries, qv, self.encoded or self.index)

    def hybrid(self, queries: DataFrame, top_k: int = 30, alpha: float = DEFAULT_ALPHA) -> DataFrame:
        """G3; where both searches read one index, in one pass over it, block by block."""
        if self.encoded is None:
            return hybrid_top_k_of_lists(lexical.best_pairs(queries, self.index, 2 * top_k, self.dim), top_k, alpha)
        return hybrid_top_k(self.dense(queries), self.bm25(queries), top_k, alpha)

    def retrieve(self, queries: DataFrame, catalog: DataFrame, top_k: int = 10,
                 max_duration: int | None = None, apply_diversity: bool = True) -> DataFrame:
        return retrieve(self.hybrid(queries, min(top_k * 4, MAX_FUSED), RETRIEVE_ALPHA),
                        catalog, top_k, max_duration, apply_diversity)


def retrieve(fused_top: DataFrame, catalog: DataFrame, top_k: int = 10,
             max_duration: int | None = None, apply_diversity: bool = True) -> DataFrame:
    """G4 after fusion: hydrate (unknown keys drop) -> C3 -> F2 (m=4) or cut -> round 4.

    The hydrate join runs after the top-n cut (late materialisation), so only
    |queries| x n rows meet the catalog; one lazy plan that reads its input once.
    """
    c = duration_filter(fused_top.drop("rank").join(catalog, "key"), max_duration=max_duration)
    if apply_diversity:
        out = diversify_few(c, top_k, MAX_PER_CATEGORY, category="test_type", order=score_order(),
                            default_category=DEFAULT_CATEGORY)
    else:
        out = top_k_per_group(c, "query_id", score_order(), top_k)
    return out.withColumn("relevance_score", F.round("score", 4))
