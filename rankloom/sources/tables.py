"""Input tables and the catalog/query views derived from them.

Every view is a lazy projection over the given Parquet tables, so its size grows
with theirs. Only the columns a view needs are selected, so scans prune columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import html as H
from rankloom.functions.rerank import POOL_SIZE
from rankloom.operators.topk import number_within
from rankloom.session import data_version, materialize, spread

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

DOC_URL_PREFIX = "https://docs.example.com/doc/"
PART_URL_PREFIX = "https://catalog.example.com/view/"


def load(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Read one table; ``columns`` prunes before the (optional) spread so only needed
    columns are shuffled when a tiny scan is spread over the cores."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if columns is not None:
        df = df.select(*columns)
    return spread(df)


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """queries(query_id, query_text) from the benchmark passages."""
    return load(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def document_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus(key, text) from documents."""
    return load(spark, sf_dir, "documents", ["doc_id", "text"]).select(F.col("doc_id").alias("key"), "text")


def document_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as catalog rows: category = source; duration and flags extracted from
    the text with the page-record rules (B6, B7). Like the index, the catalog is built
    (regexes over every whole document) and written once per application and input
    directory; searches join their top-n rows with the written table."""
    memo = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), "document_catalog", data_version(spark, sf_dir, "documents"))
    if memo not in _INDEX_TABLES:
        _INDEX_TABLES[memo] = materialize(_document_catalog(spark, sf_dir), "document_catalog")
    return _INDEX_TABLES[memo]


def _document_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    return d.select(
        F.col("doc_id").alias("key"),
        F.concat(F.lit(DOC_URL_PREFIX), F.col("doc_id").cast("string")).alias("url"),
        F.col("source").alias("test_type"),
        H.text_duration(F.col("text")).alias("duration_minutes"),
        H.adaptive_support(F.col("text")).alias("adaptive_support"),
        H.remote_support(F.col("text")).alias("remote_support"))


def part_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog stand-in over `part` (schema of SURVEY 1.2 plus the integer key).

    duration: p_size, unknown (null) above 45; adaptive tri-state from p_size;
    remote 'No' only for size 1.
    """
    p = load(spark, sf_dir, "part")
    size = F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("key"),
        F.col("p_name").alias("assessment_name"),
        F.concat(F.lit(PART_URL_PREFIX), F.replace(F.col("p_name"), F.lit(" "), F.lit("-")),
                 F.lit("-"), F.col("p_partkey").cast("string"), F.lit("/")).alias("url"),
        F.concat(F.col("p_name"), F.lit(" from "), F.col("p_brand"), F.lit(", a "),
                 F.lower(F.col("p_type")), F.lit(" item of size "), size.cast("string")).alias("description"),
        F.when(size > 45, F.lit(None)).otherwise(size).cast("int").alias("duration_minutes"),
        F.col("p_type").alias("test_type"),
        F.when(F.pmod(size, F.lit(3)) == 0, "Yes").when(F.pmod(size, F.lit(3)) == 1, "No")
         .otherwise("Unknown").alias("adaptive_support"),
        F.when(size == 1, "No").otherwise("Yes").alias("remote_support"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price"))


def order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """requests(query_id, query_text): one free-text request per order, built from its
    columns so that every duration / flag / domain rule gets exercised."""
    o = load(spark, sf_dir, "orders")
    dur = (F.pmod(F.col("o_totalprice").cast("bigint"), F.lit(90)) + 10).cast("string")
    topic = F.element_at(F.array(*[F.lit(x) for x in
                                   ["java developer", "sales lead", "verbal reasoning",
                                    "leadership", "python and sql", "customer service"]]),
                         (F.pmod(F.col("o_custkey"), F.lit(6)) + 1).cast("int"))
    limit = F.element_at(F.array(
        F.concat(F.lit("within "), dur, F.lit(" min")),
        F.concat(F.lit("under "), dur),
        F.concat(dur, F.lit(" minutes")),
        F.concat(F.lit("max\n"), dur),
        F.concat((F.pmod(F.col("o_custkey"), F.lit(3)) + 1).cast("string"), F.lit(" hours")),
        F.lit("about an hour")), (F.pmod(F.col("o_orderkey"), F.lit(6)) + 1).cast("int"))
    flag = (F.when(F.pmod(F.col("o_custkey"), F.lit(4)) == 0, F.lit(""))
             .when(F.col("o_orderstatus") == "O", F.lit("remote"))
             .when(F.col("o_orderstatus") == "F", F.lit("adaptive"))
             .otherwise(F.lit("virtual")))
    text = F.concat_ws(" ", F.lower(F.substring(F.col("o_orderpriority"), 3, 100)), topic,
                       F.lit("test"), limit, flag)
    return o.select(F.col("o_orderkey").alias("query_id"), text.alias("query_text"))


_NUMBERED: dict = {}
_INDEX_TABLES: dict = {}


def order_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidates(query_id, key, score, pos): each order's line items as its ranked list
    (score = extended price; pos 0-based with a full tie-break). Positions come from
    ``number_within``, so one order with a huge share of the line items is still split.
    The numbered table is written once per application and input directory."""
    memo = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), "order_candidates", data_version(spark, sf_dir, "lineitem"))
    if memo not in _NUMBERED:
        _NUMBERED[memo] = _order_candidates(spark, sf_dir)
    return _NUMBERED[memo]


def _order_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    order = [F.desc("l_extendedprice"), F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey")]
    n = number_within(li, ["l_orderkey"], order, "_rn")
    return materialize(n.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("key"),
                                F.col("l_extendedprice").alias("score"),
                                (F.col("_rn") - 1).cast("int").alias("pos")), "order_candidates")


def conversation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``requests_of`` the conversations table."""
    return requests_of(load(spark, sf_dir, "conversations"), load(spark, sf_dir, "pages"))


def requests_of(turns: DataFrame, pages: DataFrame) -> DataFrame:
    """requests(request_id, query, jd_text, jd_url, top_k, use_llm) from conversation turns:
    user turns ask with ``query``, assistant turns paste ``jd_text``, system turns point at a
    page url (the page whose id equals the conversation id, or an unknown url)."""
    urls = pages.groupBy("page_id").agg(F.min("url").alias("_page_url"))       # a repeated page doubles no request
    c = turns.join(urls, F.col("conv_id") == F.col("page_id"), "left")
    role = F.col("role")
    missing = F.concat(F.lit("https://missing.example.com/"), F.col("conv_id").cast("string"))
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        F.when(role == "user", F.col("text")).alias("query"),
        F.when(role == "assistant", F.col("text")).alias("jd_text"),
        F.when(role == "system", F.coalesce(F.col("_page_url"), missing)).alias("jd_url"),
        (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(22)) + 1).cast("int").alias("top_k"),
        (role == "assistant").alias("use_llm"))


def request_replies(requests: DataFrame) -> DataFrame:
    """rankings(request_id, reply): what an external ranker would send for each request that
    asks for one - pool indices from the request's limit, with a repeat and one out of the pool."""
    k = F.col("top_k").cast("string")
    return requests.filter("use_llm").select("request_id", F.concat(
        F.lit("Best: ["), k, F.lit(", 0, "), k, F.lit(", 99, 3]")).alias("reply"))


def labelled_set(queries: DataFrame, truth: DataFrame) -> DataFrame:
    """labelled(Query, Assessment_url, ord) from passages and the documents that hold them, with
    the url forms a hand-made set has: some in capitals, some with a trailing slash."""
    url = F.concat(F.lit(DOC_URL_PREFIX), F.col("key").cast("string"))
    form = (F.when(F.pmod("key", F.lit(3)) == 0, F.concat(url, F.lit("/")))
             .when(F.pmod("key", F.lit(3)) == 1, F.upper(url)).otherwise(url))
    return truth.join(queries, "query_id").select(F.col("query_text").alias("Query"), form.alias("Assessment_url"),
                                                  F.struct("query_id", "key").alias("ord"))


def brand_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """requests(query_id, query_text): one catalog search per brand, by its first part's name."""
    return (load(spark, sf_dir, "part").groupBy("p_brand").agg(F.min(F.struct("p_partkey", "p_name", "p_type")).alias("p"))
            .select(F.col("p.p_partkey").alias("query_id"),
                    F.concat_ws(" ", F.col("p.p_name"), F.col("p_brand"), F.col("p.p_type")).alias("query_text")))


def order_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rankings(query_id, reply): the reply an external ranker would send for each order's
    pool (its first 20 candidates, so every list is bounded) - pool indices by descending part key, with a repeated and an out-of-pool
    index; open orders get prose without a list, some get a mixed list."""
    cand = order_candidates(spark, sf_dir).filter(F.col("pos") < POOL_SIZE)
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), "o_orderstatus", "o_custkey")
    idx = (cand.groupBy("query_id")
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("key")).alias("k"), "pos"))),
                                             lambda s: s["pos"].cast("string")), ", ").alias("lst"),
                    F.min("pos").alias("p0")))
    j = idx.join(o, "query_id")
    reply = (F.when(F.col("o_orderstatus") == "P", F.lit("I could not rank these candidates."))
              .when(F.pmod(F.col("o_custkey"), F.lit(5)) == 0, F.concat(F.lit('[1, "a", '), F.col("lst"), F.lit("]")))
              .otherwise(F.concat(F.lit("Sure:\n["), F.col("lst"), F.lit(", "), F.col("p0").cast("string"),
                                  F.lit(", 99]"))))
    return j.select("query_id", reply.alias("reply"))
