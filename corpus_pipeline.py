"""Corpus pipeline: language ID, quality classifier, SimHash near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read
again as the next one's docs. All but the last return the columns of documents, with the rows
that the stage keeps; the last returns the packed pieces. A stage works on all rows that the
one before it kept.

Defined cases are those of the operators. A row with a null id is judged like any other; in the
near-dedup it goes if a row with an id, or another without one, stands for its component.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import langid, packing, quality, simhash
from rankloom.llm.queries import read
from rankloom.llm.shared import Scratch

MIN_LANGUAGE_SCORE = 0.5
MIN_KNOWN_WORDS = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is identified: texts without a letter go, those whose best language has a
    probability under MIN_LANGUAGE_SCORE, and those in no learned language, of whose words (whatever their
    number) the best language knows a share under MIN_KNOWN_WORDS."""
    judged = langid.predict(_tagged(docs), langid.learn(docs), _held(docs), "held_text")
    sure = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return _untagged(judged.filter(sure & (F.col("known") >= MIN_KNOWN_WORDS)), docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, trained on the labels of rows in ``docs``, finds of quality."""
    weights = quality.train(docs, read(spark, sf_dir, "labels"))
    judged = quality.predict(_tagged(docs), weights, _held(docs), "held_text")
    return _untagged(judged.filter(F.col("predicted") == 1), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that with the smallest id."""
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents left."""
    return packing.packed_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language_id), ("quality classifier", quality_classifier),
          ("SimHash near-dedup", near_dedup), ("packing", pack)]

#: No SQL form: trained models and packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a table in the shared folder, deleted once the
    next is written."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage_{k}")
        if k:
            scratch.drop(f"stage_{k - 1}")
    return docs


# Columns of documents travel through a stage under names of their own, so that none clashes
# with what the operator adds.
def _held(docs: DataFrame) -> list[str]:
    return [f"held_{c}" for c in docs.columns]


def _tagged(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(c).alias(f"held_{c}") for c in docs.columns])


def _untagged(judged: DataFrame, docs: DataFrame) -> DataFrame:
    return judged.select(*[F.col(f"held_{c}").alias(c) for c in docs.columns])
