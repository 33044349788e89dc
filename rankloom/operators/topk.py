"""Per-group top-k, planned as WindowGroupLimit (partial before the shuffle, final after)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

# Scores are ranked on this many decimals so that two engines summing in a different
# order still agree on ties; the key (ascending) breaks remaining ties.
RANK_DECIMALS = 9


def score_order(score: str = "score", key: str = "key") -> list[Column]:
    return [F.round(F.col(score), RANK_DECIMALS).desc(), F.col(key).asc()]


def top_k_per_group(df: DataFrame, group: str | list[str], order: list[Column], k: int,
                    rank_col: str = "rank") -> DataFrame:
    """Rows with ``row_number() <= k`` per group; ``rank_col`` is 1-based.

    ``row_number <= k`` lets Catalyst insert a partial WindowGroupLimit before the
    exchange, so a hot group ships at most k rows per map partition.
    """
    groups = [group] if isinstance(group, str) else list(group)
    w = W.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows, sorted by group, with ``_at`` (1, 2, ... in each group), ``_head`` (of the task's first
    group) and ``_last`` (the task's last row)."""
    held, before, at, head = None, None, 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column("_g").to_numpy()
        starts = np.concatenate(([before is None or g[0] != before], g[1:] != g[:-1]))
        first = np.maximum.accumulate(np.where(starts, np.arange(len(g)), -1))
        numbers = np.arange(len(g)) - first + np.where(first < 0, at, 1)
        changed = np.cumsum(starts) > (1 if before is None else 0)
        heads = ~changed if head else np.zeros(len(g), bool)
        before, at, head = g[-1], numbers[-1], bool(heads[-1])
        if held is not None:
            yield held
        held = pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64()), pa.array(heads), pa.array(np.zeros(len(g), bool))],
                                          [*batch.schema.names, "_at", "_head", "_last"])
    if held is not None:
        last = np.arange(held.num_rows) == held.num_rows - 1
        yield pa.RecordBatch.from_arrays([*held.columns[:-1], pa.array(last)], held.schema.names)


def number_within(df: DataFrame, group: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    """``row_number() over (partition by group order by order)`` for unbounded groups.

    A window partitioned by a hot key sorts that key's rows in one task. Here the rows
    are range-partitioned by (group, order) instead - a sampled global sort that splits a
    hot group over many tasks - and numbered within each task as they stream by. Only a task's
    first group can have rows in tasks before it; its offset is the sum of the last numbers of those
    tasks that end with this group. That table has at most a row for each task and is broadcast, so
    the rows are shuffled once, by the sort.
    ``order`` must be total (ties broken) for the numbering to be deterministic.

    The numbered rows are written once to the shared checkpoint folder and the offsets are taken
    from that table: the sort runs once, and a lost executor does not re-run it.
    """
    from rankloom.session import materialize

    tagged = df.orderBy(*[F.col(g) for g in group], *order).withColumn("_pid", F.spark_partition_id()) \
               .withColumn("_g", F.xxhash64(*group))
    schema = T.StructType([*tagged.schema.fields, T.StructField("_at", T.LongType()), T.StructField("_head", T.BooleanType()),
                           T.StructField("_last", T.BooleanType())])
    s = materialize(tagged.mapInArrow(_numbered, schema), "numbered")
    heads = s.filter(F.col("_head") & (F.col("_at") == 1)).select("_pid", "_g")
    ends = s.filter("_last").select(F.col("_pid").alias("_before"), F.col("_g").alias("_eg"), F.col("_at").alias("_n"))
    offsets = heads.join(F.broadcast(ends), (F.col("_g") == F.col("_eg")) & (F.col("_before") < F.col("_pid"))) \
                   .groupBy("_pid").agg(F.sum("_n").alias("_off"))
    out = s.join(F.broadcast(offsets), "_pid", "left")
    return (out.withColumn(name, F.col("_at") + F.when(F.col("_head"), F.coalesce("_off", F.lit(0))).otherwise(F.lit(0)))
               .drop("_pid", "_g", "_at", "_head", "_last", "_off"))
