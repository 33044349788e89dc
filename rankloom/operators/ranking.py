"""Externally supplied rankings: context/prompt tables out, replies in.

Candidates are ``(query_id, key, pos, score, ...)`` with ``pos`` 0-based and dense.
"""

from __future__ import annotations

import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rankloom.functions.rerank import POOL_SIZE, context_line, parse_reply, prompt_text, rank_score
from rankloom.session import ensure_checkpoint_dir, exists

ASKED_AT_ONCE, PATIENCE = 8, 30.0       # prompts a task has out at a time, and seconds it waits for them
WAVE, WAVES = 10_000, 64                # prompts whose replies are written as one table, and the most such tables
HANDED_ON = 256                         # replies a task hands on together


def prompt_context(cands: DataFrame, name: str = "assessment_name", test_type: str = "test_type",
                   description: str = "description") -> DataFrame:
    """B23 per query: one line per pool candidate (pos < 20) in pos order.

    The collected list is bounded by the pool size, never by the data."""
    pool = cands.filter(F.col("pos") < POOL_SIZE)
    lines = pool.select("query_id", F.struct("pos", context_line("pos", name, test_type, description)
                                                    .alias("line")).alias("pl"))
    return (lines.groupBy("query_id")
                 .agg(F.array_join(F.transform(F.array_sort(F.collect_list("pl")), lambda s: s["line"]),
                                   "").alias("context")))


def prompts(queries: DataFrame, context: DataFrame, top_k: int = 10) -> DataFrame:
    """One prompt per query that has candidates."""
    return (queries.join(context, "query_id")
                   .select("query_id", prompt_text("query_text", "context", top_k).alias("prompt")))


def accepted_indices(rankings: DataFrame, cands: DataFrame) -> DataFrame:
    """F6 + C6: (query_id, pos, new_pos) - valid pool indices, first occurrence only,
    numbered in reply order (0-based)."""
    parsed = rankings.select("query_id", parse_reply("reply").alias("idx")).filter(F.col("idx").isNotNull())
    ex = parsed.select("query_id", F.posexplode("idx").alias("ipos", "pos"))
    pool = cands.filter(F.col("pos") < POOL_SIZE).select("query_id", "pos").distinct()
    valid = ex.join(pool, ["query_id", "pos"])                      # drops out-of-pool indices
    first = valid.groupBy("query_id", "pos").agg(F.min("ipos").alias("ipos"))
    w = W.partitionBy("query_id").orderBy("ipos")
    return first.select("query_id", "pos", (F.row_number().over(w) - 1).alias("new_pos"))


def apply_rankings(cands: DataFrame, rankings: DataFrame | None, top_k: int | Column = 10) -> DataFrame:
    """D6 + B22 + G6: ranked pool items first (score 0.99 - 0.01*j), then every other
    candidate in its old order with its old score; cut to top_k (a number, or a column of
    the candidates for a limit of each request's own). A missing or malformed
    reply leaves the order unchanged. Output adds ``rank`` (1-based) and ``reranked``."""
    if rankings is None:
        out = cands.withColumn("new_pos", F.lit(None).cast("long"))
    else:
        out = cands.join(accepted_indices(rankings, cands), ["query_id", "pos"], "left")
    out = (out.withColumn("reranked", F.col("new_pos").isNotNull())
              .withColumn("score", F.when(F.col("reranked"), rank_score("new_pos")).otherwise(F.col("score"))))
    w = W.partitionBy("query_id").orderBy(F.col("new_pos").asc_nulls_last(), F.col("pos").asc())
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k).drop("new_pos")


class Askers:
    """``n`` threads that ask a client. A prompt that is late keeps its thread, so the others of its group are
    let go with it and the next group has new ones; as long as replies come in time, none is started again."""

    def __init__(self, client: Callable[[str], str], n: int):
        self.client, self.todo = client, queue.SimpleQueue()
        for _ in range(n):
            threading.Thread(target=self.work, daemon=True).start()

    def work(self) -> None:
        while (job := self.todo.get()) is not None:
            prompt, i, out, done = job
            try:
                reply = self.client(prompt)
            except Exception:  # noqa: BLE001 - whatever a client raises leaves that request's order as it is
                reply = None
            out[i] = reply if isinstance(reply, str) else None
            done.put(i)

    def ask(self, prompts: list[str], patience: float) -> tuple[list[str | None], bool]:
        """The replies, None for a prompt that has none, and whether all were in time."""
        out: list[str | None] = [None] * len(prompts)
        done: queue.SimpleQueue = queue.SimpleQueue()
        for i, prompt in enumerate(prompts):
            self.todo.put((prompt, i, out, done))
        until = time.monotonic() + patience
        for _ in prompts:
            try:
                done.get(timeout=max(0.0, until - time.monotonic()))
            except queue.Empty:
                return list(out), False         # a late reply changes nothing any more
        return list(out), True

    def close(self, n: int) -> None:
        for _ in range(n):
            self.todo.put(None)


def replies_within(client: Callable[[str], str], prompts: list[str], patience: float,
                   at_once: int | None = None) -> list[str | None]:
    """The client's replies; None for a prompt it fails on, answers with no text, or has not answered in time.
    ``at_once`` prompts (all by default) are out together and have ``patience`` seconds."""
    n = at_once or max(1, len(prompts))
    out: list[str | None] = []
    askers = None
    for a in range(0, len(prompts), n):
        askers = askers or Askers(client, n)
        found, in_time = askers.ask(prompts[a:a + n], patience)
        out += found
        if not in_time:
            askers.close(n)
            askers = None
    if askers:
        askers.close(n)
    return out


def call_ranker(prompts: DataFrame, client_factory: Callable[[], Callable[[str], str]], path: str | None = None,
                at_once: int = ASKED_AT_ONCE, patience: float = PATIENCE, wave: int = WAVE) -> DataFrame:
    """K2: rankings(query_id, reply) of prompts(query_id, prompt) from a client that is called with whole prompts.

    ``client_factory()`` is called once for each task and gives ``f(prompt) -> reply``; a task has at most
    ``at_once`` prompts out at a time and waits ``patience`` seconds for them. A prompt without a reply (failed,
    late, no text) has a null reply, which leaves its candidates' order as it is, and does not touch the others.

    Equal prompts are asked once. Replies are written under ``path`` by prompt hash, in waves of about ``wave``
    prompts, or a WAVES-th of all if that is more: a job that is run again with the same path asks only for
    prompts without a reply, and a task that is lost repeats its part of one wave, not those written. The prompts
    are computed once and lie in a folder for each wave, so every wave reads its own only."""
    spark = prompts.sparkSession
    path = (path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/rankloom/replies-{uuid.uuid4().hex}").rstrip("/")
    schema, job = "prompt_hash string, reply string", uuid.uuid4().hex
    prompts.select("query_id", "prompt", F.sha2(F.coalesce("prompt", F.lit("")), 256).alias("prompt_hash")) \
           .write.parquet(f"{path}-prompts-{job}")
    keyed = spark.read.parquet(f"{path}-prompts-{job}")
    written = lambda: spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/none")
    answered = written().filter("reply IS NOT NULL").select("prompt_hash")
    missing = keyed.filter("prompt IS NOT NULL").join(answered, "prompt_hash", "left_anti")
    waves = max(1, min(WAVES, -(-missing.count() // wave)))
    asked = missing.groupBy("prompt_hash").agg(F.first("prompt").alias("prompt"))
    turn = F.pmod(F.xxhash64("prompt_hash"), F.lit(waves)).cast("int")
    asked.select("prompt_hash", "prompt", turn.alias("wave")).write.partitionBy("wave").parquet(f"{path}-todo-{job}")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory()
        for pdf in batches:
            for a in range(0, len(pdf), HANDED_ON):
                part = pdf.iloc[a:a + HANDED_ON]
                yield pd.DataFrame({"prompt_hash": part["prompt_hash"],
                                    "reply": replies_within(client, part["prompt"].tolist(), patience, at_once)})

    todo = "prompt_hash string, prompt string"
    for n in range(waves):
        if exists(spark, f"{path}-todo-{job}/wave={n}"):
            spark.read.schema(todo).parquet(f"{path}-todo-{job}/wave={n}").mapInPandas(ask, schema).write.parquet(f"{path}/{job}-{n}")
    best = written().groupBy("prompt_hash").agg(F.max("reply").alias("reply"))      # null only if every asking failed
    return keyed.select("query_id", "prompt_hash").join(best, "prompt_hash", "left").select("query_id", "reply")
