"""File sources and sinks of the catalog, labelled set, vectors, evaluation and
predictions (SURVEY A4-A10, A13, A14).

Parquet is the primary store; JSON and CSV are the interchange formats the reference
reads and writes. Every reader takes an explicit schema (no inference pass over the
data), and every writer is a distributed ``DataFrame.write``: one file per partition,
nothing funnelled through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, FloatType, IntegerType, LongType, StringType, StructField,
                               StructType)

from rankloom.functions.text import truncate_ellipsis, with_default
from rankloom.operators.dense import manifest
from rankloom.session import exists

CATALOG_SCHEMA = StructType([
    StructField("assessment_name", StringType()),
    StructField("url", StringType()),
    StructField("description", StringType()),
    StructField("duration_minutes", IntegerType()),
    StructField("test_type", StringType()),
    StructField("adaptive_support", StringType()),
    StructField("remote_support", StringType()),
])

LABEL_SCHEMA = StructType([StructField("Query", StringType()), StructField("Assessment_url", StringType())])

VECTOR_SCHEMA = StructType([StructField("key", LongType()), StructField("embedding", ArrayType(FloatType()))])

MANIFEST_SCHEMA = StructType([
    StructField("model_name", StringType()), StructField("dimension", IntegerType()),
    StructField("num_assessments", LongType()), StructField("index_type", StringType()),
])


# ---- catalog ------------------------------------------------------------------------

def read_catalog_json(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """A4: a JSON catalog - one whole-file array (``multiline``) or JSON lines. Missing text
    fields get their defaults (B27); a missing duration is null."""
    rows = spark.read.schema(CATALOG_SCHEMA).option("multiLine", multiline).json(path)
    texts = ("assessment_name", "description", "test_type", "adaptive_support", "remote_support")
    return rows.withColumns({c: with_default(c, c) for c in texts})


def write_catalog_json(catalog: DataFrame, path: str) -> None:
    """A5: JSON lines, UTF-8 (the reference writes one pretty array; lines split and
    stream, and ``read_catalog_json(multiline=False)`` reads them back)."""
    catalog.write.mode("overwrite").option("encoding", "UTF-8").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Header, UTF-8, no index column; quotes are doubled and white space at the ends of a
    value is kept, as spreadsheet readers expect."""
    (df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


# ---- labelled set -------------------------------------------------------------------

def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """``Query, Assessment_url`` with a header. Queries hold newlines, so quoted
    multi-line fields are on; ``ord`` keeps the file order for first-seen splits (F4)."""
    df = (spark.read.schema(LABEL_SCHEMA).option("header", True).option("multiLine", True)
          .option("quote", '"').option("escape", '"').csv(path))
    return df.withColumn("ord", F.monotonically_increasing_id())


# ---- vectors ------------------------------------------------------------------------

def write_vectors(vectors: DataFrame, path: str, model_name: str, key: str = "key",
                  vec: str = "embedding", index_type: str = "exact_inner_product") -> None:
    """A8 + A9: the vector table keyed by ``key`` and a one-row manifest computed from it
    (the encoder name actually used, not a literal)."""
    vectors.select(F.col(key).alias("key"), F.col(vec).alias("embedding")) \
           .write.mode("overwrite").parquet(f"{path.rstrip('/')}/vectors")
    manifest(vectors, model_name, vec, index_type).coalesce(1) \
        .write.mode("overwrite").json(f"{path.rstrip('/')}/manifest")


def read_vectors(spark: SparkSession, path: str, lenient: bool = False) -> tuple[DataFrame, DataFrame]:
    """A10: (vectors, manifest). The manifest is required. A missing vector table raises,
    or with ``lenient`` degrades to an empty typed table, so searches return no dense hits
    and fusion still works from the lexical side (D4)."""
    base = path.rstrip("/")
    man = spark.read.schema(MANIFEST_SCHEMA).json(f"{base}/manifest")
    if lenient and not exists(spark, f"{base}/vectors"):
        return spark.createDataFrame([], VECTOR_SCHEMA), man
    return spark.read.schema(VECTOR_SCHEMA).parquet(f"{base}/vectors"), man


QUERY_CHARS = 80


# ---- evaluation and predictions -----------------------------------------------------

def run_stamp(spark: SparkSession) -> str:
    """The ``yyyyMMdd_HHmmss`` stamp of an evaluation file (session time zone)."""
    return spark.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")).first()[0]


def evaluation_report(per_query: DataFrame, summary: DataFrame, k: int = 10) -> DataFrame:
    """The whole report as one JSON object with the per-query list inside it (queries cut
    at 80 characters). The labelled queries of an evaluation are few (F4's first ones), so the
    list is bounded by their number."""
    each = F.struct(truncate_ellipsis("query_text", QUERY_CHARS).alias("query"), F.col("recall").alias(f"recall@{k}"),
                    F.col("precision").alias(f"precision@{k}"), "found", "total_gt")
    rows = per_query.agg(F.transform(F.array_sort(F.collect_list(F.struct("query_id", each.alias("r")))),
                                     lambda x: x["r"])).scalar()
    return summary.select(F.to_json(F.struct(
        F.col("mean_recall").alias(f"mean_recall@{k}"), F.col("mean_precision").alias(f"mean_precision@{k}"),
        "total_found", "total_ground_truth", "num_queries", rows.alias("per_query_results"))).alias("report"))


def write_evaluation(per_query: DataFrame, summary: DataFrame, path: str, k: int = 10) -> str:
    """``<path>/evaluation_results_<stamp>/`` with ``report`` (the JSON object) and
    ``per_query`` (JSON lines, one per labelled query, whole query texts)."""
    out = f"{path.rstrip('/')}/evaluation_results_{run_stamp(summary.sparkSession)}"
    evaluation_report(per_query, summary, k).write.mode("overwrite").text(f"{out}/report")
    per_query.withColumnRenamed("recall", f"recall@{k}").withColumnRenamed("precision", f"precision@{k}") \
             .write.mode("overwrite").json(f"{out}/per_query")
    return out


def write_predictions(predictions: DataFrame, path: str) -> None:
    """``Query, Assessment_url`` CSV with a header, one row per recommendation.

    Spark's CSV writer emits no UTF-8 byte-order mark; the reference's file starts with
    one. Readers that need it can prepend the three bytes when concatenating parts."""
    write_csv(predictions.select("Query", "Assessment_url"), path)
