"""Labelled evaluation and prediction export over whole query tables.

Ground truth without labels: a document is relevant to a passage when it contains the
passage verbatim. Candidates are the documents that hold the passage's rarest *interior*
token (tokens 2..n-1 are whole tokens inside any verbatim copy), and are then verified
with ``instr`` - an equi-join on a selective term instead of comparing every pair. Passages
with fewer than three tokens have no interior token; each text is searched for all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rankloom.functions.text import tokens, truncate_ellipsis, url_slug
from rankloom.operators.lexical import LexicalIndex
from rankloom.operators.metrics import ordered_split, per_query_metrics, recall_band, summary
from rankloom.plans.recommend import recommend
from rankloom.plans.search import TextSearch
from rankloom.session import broadcast_below, materialize, text_bytes

PREDICTION_QUERY_CHARS = 150
GRAM = 3                    # characters a short passage is looked up by
PAIR_BYTES = 64         # of a (query, document) pair in a broadcast


def containment_truth(queries: DataFrame, corpus: DataFrame, index: LexicalIndex) -> DataFrame:
    """truth(query_id, key): documents containing the (non-empty) query text verbatim."""
    qt = queries.filter(F.length("query_text") > 0).select("query_id", "query_text", tokens("query_text").alias("toks"))
    ex = qt.select("query_id", F.size("toks").alias("n"), F.posexplode("toks").alias("p", "term"))
    interior = ex.filter((F.col("n") >= 3) & (F.col("p") >= 1) & (F.col("p") <= F.col("n") - 2))
    rare = (interior.join(index.terms.select("term", "df"), "term").groupBy("query_id")
                    .agg(F.min_by(F.struct("term", "df"), F.struct("df", "term")).alias("r"))
                    .select("query_id", "r.term", "r.df"))
    # one rare term per passage streams past the documents; its pairs number its frequency
    size = text_bytes(queries, "query_text")
    holds = (index.documents.select("key", F.explode("terms").alias("term"))
                  .join(broadcast_below(rare.select("query_id", "term"), size * PAIR_BYTES), "term").select("query_id", "key"))
    pairs = rare.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    cand = broadcast_below(holds, pairs * PAIR_BYTES)      # keys only: texts join after the corpus
    texts = broadcast_below(qt.select("query_id", "query_text"), size + PAIR_BYTES * size)
    long = (corpus.select("key", "text").join(cand, "key").join(texts, "query_id")
                  .filter(F.instr(F.col("text"), F.col("query_text")) > 0).select("query_id", "key"))
    # passages without an inside token: by their first characters, which a document that holds them has
    short = qt.filter((F.size("toks") < 3) & (F.length("query_text") > 0)).select("query_id", "query_text", F.substring("query_text", 1, GRAM).alias("gram"))
    sizes = [r[0] for r in short.select(F.length("gram")).distinct().collect()]          # GRAM of them at most
    if not sizes:
        return long.distinct()
    at = lambda n: F.transform(F.sequence(F.lit(1), F.length("text") - n + 1), lambda i: F.substring(F.col("text"), i, F.lit(n)))
    grams = F.concat(*[F.when(F.length("text") >= n, F.array_distinct(at(n))).otherwise(
        F.array().cast("array<string>")) for n in sizes])
    side = broadcast_below(short, size * (1 + PAIR_BYTES))
    met = corpus.filter(F.col("text").isNotNull()).select("key", F.explode(grams).alias("gram")).join(side, "gram").drop("gram")
    found = corpus.select("key", "text").join(met, "key").filter(F.instr(F.col("text"), F.col("query_text")) > 0)
    return long.unionByName(found.select("query_id", "key")).distinct()


def train_queries(labelled: DataFrame, n_train: int = 10) -> DataFrame:
    """F4 for an evaluation: (query_id, query_text) of the first ``n_train`` distinct queries of
    labelled(Query, Assessment_url, ord), numbered in first-seen order."""
    first = labelled.groupBy("Query").agg(F.min("ord").alias("ord")).orderBy("ord").limit(n_train)
    return first.select(F.row_number().over(W.orderBy("ord")).cast("long").alias("query_id"), F.col("Query").alias("query_text"))


def evaluate_labelled(search: TextSearch, labelled: DataFrame, catalog: DataFrame, k: int = 10, n_train: int = 10,
                      rankings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """L4: (per-query rows with query_text, one-row summary with its band). The first queries of
    the labelled set are recommended (with replies where rankings(query_id, reply) has some), the
    labels are found by query text (D8), and urls count as equal by slug (D7, H4): a trailing
    slash or letter case does not matter."""
    queries = train_queries(labelled, n_train)
    truth = labelled.join(F.broadcast(queries), F.col("Query") == F.col("query_text")) \
                    .select("query_id", url_slug("Assessment_url").alias("item"))
    recs = recommend(search, queries, catalog, k, rankings)
    preds = recs.select("query_id", "rank", url_slug("url").alias("item"))
    per_query = per_query_metrics(preds, truth, k).join(F.broadcast(queries), "query_id")
    done = summary(per_query)
    return per_query, done.select("*", recall_band().alias("band"))


def evaluate(recs: DataFrame, truth: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(per-query metrics, one-row summary) for recommendations recs(query_id, rank, key).

    The truth table is read twice (label counts and hits); it is written once to the
    shared checkpoint folder so its joins with whole document texts run once."""
    truth = materialize(truth.select("query_id", "key"), "truth")
    pq = per_query_metrics(recs.select("query_id", "rank", F.col("key").alias("item")),
                           truth.select("query_id", F.col("key").alias("item")), k)
    return pq, summary(pq)


def prediction_rows(recs: DataFrame, queries: DataFrame, n_train: int = 10,
                    keep_order: bool = False) -> DataFrame:
    """A14 rows for the test split: (Query, Assessment_url). Query is whitespace-collapsed
    and cut at 150 chars, with '...' when the original text is longer (kept quirk).
    ``keep_order`` also returns query_id and rank, the order of the rows in the file."""
    split = ordered_split(queries, "query_text", ["query_id"], n_train).filter(F.col("split") == "test")
    test = queries.join(split.select("query_text"), "query_text", "left_semi")
    extra = ["query_id", "rank"] if keep_order else []
    return (recs.join(test.select("query_id", "query_text"), "query_id")
                .select(*extra, truncate_ellipsis("query_text", PREDICTION_QUERY_CHARS, collapse_ws=True).alias("Query"),
                        F.col("url").alias("Assessment_url")))


def prediction_preview(recs: DataFrame, queries: DataFrame, n_train: int = 10, n: int = 5) -> DataFrame:
    """The first ``n`` prediction rows in file order (query, then rank); a top-n
    (TakeOrderedAndProject), not a sort of the whole table."""
    rows = prediction_rows(recs, queries, n_train, keep_order=True)
    return rows.orderBy("query_id", "rank").limit(n).select("Query", "Assessment_url")
