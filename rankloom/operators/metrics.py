"""Evaluation: hits by slug, recall@k, precision@k, summary, ordered split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_query_metrics(preds: DataFrame, truth: DataFrame, k: int = 10, item: str = "item") -> DataFrame:
    """E7 + E8 + D7 per labelled query.

    preds(query_id, rank, item), truth(query_id, item) - one truth row per label row
    (repeats allowed). Set semantics on items; recall = hits / distinct truth items
    (0 when none); precision = hits / k (fixed denominator). Queries without
    predictions count as 0 (E9). Output: query_id, recall, precision, found, total_gt.
    """
    p = preds.filter(F.col("rank") <= k).select("query_id", F.col(item).alias("item")).distinct()
    t = truth.select("query_id", F.col(item).alias("item"))
    gt = t.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_gt"),
                                   F.count_distinct("item").alias("gt_distinct"))
    hits = (p.join(t.distinct(), ["query_id", "item"], "left_semi")
             .groupBy("query_id").agg(F.count(F.lit(1)).alias("found")))
    r = gt.join(hits, "query_id", "left").withColumn("found", F.coalesce(F.col("found"), F.lit(0)))
    recall = F.when(F.col("gt_distinct") == 0, F.lit(0.0)).otherwise(F.col("found") / F.col("gt_distinct"))
    return r.select("query_id", recall.alias("recall"), (F.col("found") / F.lit(k)).alias("precision"),
                    F.col("found").cast("long").alias("found"), F.col("total_gt").cast("long").alias("total_gt"))


def summary(per_query: DataFrame) -> DataFrame:
    """Macro means, total found, total truth rows (not distinct), query count."""
    return per_query.agg(F.avg("recall").alias("mean_recall"), F.avg("precision").alias("mean_precision"),
                         F.sum("found").alias("total_found"), F.sum("total_gt").alias("total_ground_truth"),
                         F.count(F.lit(1)).alias("num_queries"))


# The mean recall from which an evaluation counts as a success, or as good.
SUCCESS_RECALL, GOOD_RECALL = 0.6, 0.5


def recall_band(mean_recall: str = "mean_recall") -> Column:
    """Success, good or warning."""
    r = F.col(mean_recall)
    return F.when(r >= SUCCESS_RECALL, "success").when(r >= GOOD_RECALL, "good").otherwise("warning")


def ordered_split(df: DataFrame, query: str, order_cols: list[str], n_train: int = 10) -> DataFrame:
    """distinct queries in first-seen order; the first ``n_train`` are 'train', the rest
    'test'; with ``n_train`` or fewer distinct queries every query is 'test'.

    Only a global top-``n_train`` is ordered (TakeOrderedAndProject); the distinct query
    set is never sorted in one task.
    """
    first = df.groupBy(query).agg(F.min(F.struct(*order_cols)).alias("_first"))
    head = first.orderBy("_first").limit(n_train).select(query, F.lit(True).alias("_head"))
    n_distinct = first.select(F.count(F.lit(1))).scalar()
    out = first.join(F.broadcast(head), query, "left")
    split = F.when((n_distinct > n_train) & F.coalesce(F.col("_head"), F.lit(False)), F.lit("train")) \
             .otherwise(F.lit("test"))
    return out.select(query, *[F.col("_first").getField(c).alias(c) for c in order_cols], split.alias("split"))
