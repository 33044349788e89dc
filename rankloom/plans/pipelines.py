"""Composite jobs that persist their results.

Each is one Spark job graph over whole tables; outputs are written by the executors
(Parquet first, JSON/CSV for interchange) and read back lazily where a later step
needs them, which also cuts the lineage for the steps after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import dense, lexical
from rankloom.operators import pages as PG
from rankloom.plans.evaluate import evaluate_labelled, prediction_rows
from rankloom.plans.recommend import recommend
from rankloom.plans.search import TextSearch
from rankloom.session import exists
from rankloom.sources import files


def build_index(corpus: DataFrame, path: str, key: str = "key", text: str = "text",
                dim: int = dense.HASH_DIM) -> TextSearch:
    """L2: terms counted within each document, the vocabulary and corpus statistics, written
    under ``path`` with a manifest; returns the search over the written tables."""
    base = path.rstrip("/")
    search = TextSearch.build(corpus, key, text, dim, f"{base}/lexical")
    (search.index.documents.filter("dl > 0")
     .agg(F.lit(f"hashing-md5-{dim}").alias("model_name"), F.lit(dim).cast("int").alias("dimension"),
          F.count(F.lit(1)).alias("num_assessments"), F.lit("sparse_inner_product").alias("index_type"))
     .coalesce(1).write.mode("overwrite").json(f"{base}/manifest"))
    return search


MANIFEST_SCHEMA = "model_name string, dimension int, num_assessments bigint, index_type string"


def load_index(spark: SparkSession, path: str, dim: int | None = None, lenient: bool = False) -> TextSearch:
    """A written index. The encoder and its dimension are those of the manifest, which must be there; an
    encoder that is not this engine's, or a ``dim`` other than the manifest's, raises. With ``lenient`` any
    other part that is missing is empty (A10)."""
    base = path.rstrip("/")
    if not exists(spark, f"{base}/manifest"):
        raise FileNotFoundError(f"no manifest under {base}")
    found = spark.read.schema(MANIFEST_SCHEMA).json(f"{base}/manifest").first()
    if found is None or found["model_name"] != f"hashing-md5-{found['dimension']}":
        raise ValueError(f"the index under {base} was written for another encoder: {found and found['model_name']}")
    if dim not in (None, found["dimension"]):
        raise ValueError(f"the index under {base} has {found['dimension']} dimensions, not {dim}")
    return TextSearch(lexical.LexicalIndex.read(spark, f"{base}/lexical", lenient), found["dimension"])


def build_catalog(pages: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """L6 + L1: extract one record per crawled page, add placeholders for discovered urls
    without a page, keep the first row per url, write Parquet / JSON / CSV.
    Returns (catalog read back from Parquet, one-row profile)."""
    base = path.rstrip("/")
    records = PG.page_records(pages)
    urls = PG.discovered_urls(PG.page_links(pages))
    PG.merge_catalog(records, urls).write.mode("overwrite").parquet(f"{base}/catalog")
    catalog = pages.sparkSession.read.parquet(f"{base}/catalog")
    by_url = catalog.select(*PG.CATALOG_COLS).orderBy("url")      # G9
    files.write_catalog_json(by_url, f"{base}/catalog_json")
    files.write_csv(by_url, f"{base}/catalog_csv")
    return catalog, PG.catalog_profile(catalog)


def evaluate_to(search: TextSearch, labelled: DataFrame, catalog: DataFrame, path: str, k: int = 10,
                rankings: DataFrame | None = None) -> str:
    """L4: evaluate labelled(Query, Assessment_url, ord) and write the A13 report; returns its
    directory."""
    per_query, summ = evaluate_labelled(search, labelled, catalog, k, rankings=rankings)
    return files.write_evaluation(per_query, summ, path, k)


def predict_to(search: TextSearch, requests: DataFrame, catalog: DataFrame, path: str,
               n_train: int = 10, k: int = 10) -> None:
    """Recommendations for the test split written as the A14 prediction CSV."""
    recs = recommend(search, requests, catalog, k)
    files.write_predictions(prediction_rows(recs, requests, n_train), path)
