"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation,
from a user turn to an assistant turn. Each source turn is given a legal role (RELABEL if it is
another known role, UNKNOWN if its role is none), and either starts a new turn, merges into the
turn before it (MERGE), or starts a new turn after an empty one that is inserted (INSERT); a
conversation that does not end with the assistant gets empty turns (INSERT each). Dynamic
programming over the automaton's states finds the repair with the lowest total cost; the
repaired turns are then rendered.

A source turn's choices depend on the state before it only, so a run of turns is a min-plus
matrix over the four states. Conversations are cut into chunks of CHUNK turns; the matrices of a
conversation's chunks are combined FAN at a time up to one matrix, whose best path fixes the
states at the chunks' borders on the way back. So no task holds more than CHUNK turns or FAN
matrices of one conversation, whatever its length. The result has one row for each source turn
with its part of the rendering; a conversation's text is their concatenation in order of
``position``.

A text may hold the markers themselves. A rendered text has one more backslash inside every
``<|im_start|>`` and ``<|im_end|>`` (``<|\\im_end|>``; those with backslashes get one more), so only the
rendering's own markers begin and end turns; ``unescaped`` takes it out again.

Order is by turn (null last), then role and text. Defined cases: exact repeats of a row are turns
of their own, one after another. Null conversation ids form one conversation. A null text is
empty, a null or unfamiliar role unknown. Costs tie in favour of new turns, then merges, then insertions, and the earlier
state. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.shared import Scratch
from rankloom.operators.topk import number_within

CHUNK, FAN = 1024, 1024
MERGE, RELABEL, UNKNOWN, INSERT = 2, 5, 1, 4
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = [None, "system", "user", "assistant"]
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER,
           "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT}
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
NEVER = 1 << 40
OPEN, CLOSE, JOIN = "<|im_start|>{}\n", "<|im_end|>\n", "\n\n"
_MARKER = re.compile(r"<\|(\\*im_(?:start|end)\|>)")
_ESCAPED = re.compile(r"<\|\\(\\*im_(?:start|end)\|>)")


def escaped(text: str) -> str:
    return _MARKER.sub(r"<|\\\1", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<|\1", text)


def _options(state: int, role: int) -> Iterator[tuple[int, int, tuple[str, int]]]:
    """(cost, next state, (action, inserted role)) of a source turn of ``role`` (0: unknown)."""
    label = lambda to: 0 if to == role else RELABEL if role else UNKNOWN
    for to in NEXT[state]:
        yield label(to), to, ("new", 0)
    if state != START:
        yield MERGE + label(state), state, ("merge", 0)
    for between in NEXT[state]:
        for to in NEXT[between]:
            yield INSERT + label(to), to, ("insert", between)


def _tables() -> tuple[np.ndarray, list]:
    cost = np.full((4, 4, 4), NEVER, np.int64)
    action: list = [[[None] * 4 for _ in range(4)] for _ in range(4)]
    for role in range(4):
        for state in range(4):
            for c, to, what in _options(state, role):
                if c < cost[role, state, to]:
                    cost[role, state, to], action[role][state][to] = c, what
    return cost, action


COST, ACTION = _tables()
#: Empty turns that lead from a final state to the end.
ENDING = {START: (USER, ASSISTANT), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
END_COST = np.array([INSERT * len(ENDING[s]) for s in range(4)])


def path(steps: list[np.ndarray], entry: int, exit_: int | None) -> tuple[list[int], int]:
    """(state after each step, cost) of the cheapest path through min-plus matrices from
    ``entry`` to ``exit_`` (None: to the end of the conversation)."""
    best = np.full(4, NEVER, np.int64)
    best[entry] = 0
    back = []
    for m in steps:
        total = best[:, None] + m
        back.append(total.argmin(axis=0))
        best = total.min(axis=0)
    ends = best + END_COST if exit_ is None else best
    state = int(ends.argmin()) if exit_ is None else exit_
    cost, states = int(ends[state]), []
    for came in reversed(back):
        states.append(state)
        state = int(came[state])
    return states[::-1], cost


def combined(steps: list[np.ndarray]) -> np.ndarray:
    """The min-plus product of the steps."""
    out = steps[0]
    for m in steps[1:]:
        out = np.minimum((out[:, :, None] + m[None, :, :]).min(axis=1), NEVER)
    return out


def repair(roles: list[int], entry: int = START, exit_: int | None = None) -> tuple[list[tuple[int, str, int]], int]:
    """((new role, action, inserted role before it) of each turn, cost)."""
    states, cost = path([COST[r] for r in roles], entry, exit_)
    before = [entry, *states[:-1]]
    return [(to, *ACTION[r][s][to]) for r, s, to in zip(roles, before, states, strict=True)], cost


def rendering(done: list[tuple[int, str, int]], texts: list[str], entry: int, ends: bool) -> list[str]:
    """The part of each source turn in the conversation's rendering."""
    parts, state = [], entry
    for (to, action, between), text in zip(done, texts, strict=True):
        shut, text = CLOSE if state != START else "", escaped(text)
        if action == "merge":
            parts.append(JOIN + text)
        else:
            empty = OPEN.format(ROLES[between]) + CLOSE if between else ""
            parts.append(shut + empty + OPEN.format(ROLES[to]) + text)
        state = to
    if ends and parts:
        parts[-1] += CLOSE + "".join(OPEN.format(ROLES[r]) + CLOSE for r in ENDING[state])
    return parts


def role_number(role: str = "role"):
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(F.col(role)))), F.lit(0))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, turn, position (from 1), role, repaired_role, action (new, merge or insert),
    inserted (role of the empty turn inserted before, else null), relabelled, cost of this turn's
    repair, and rendered, for every row of ``turns(conv_id, turn, role, text)``."""
    scratch = Scratch(turns.sparkSession, "chat")
    kinds = turns.select("conv_id", "turn").schema
    rows = turns.select(F.struct("conv_id").alias("conv"), "turn", F.col("role").cast("string").alias("role"),
                        F.col("text").cast("string").alias("text"))
    rows = number_within(rows, ["conv"], [F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")], "position")
    rows = rows.select("*", role_number().alias("r"), F.floor((F.col("position") - 1) / CHUNK).alias("chunk"))
    last = rows.groupBy("conv").agg(F.max("chunk").alias("last"))
    borders = _borders(rows.select("conv", "chunk", "position", "r"), last.filter("last > 0"), scratch)
    of_chunk = (rows.groupBy("conv", "chunk").agg(F.count(F.lit(1)).alias("n")).join(last, "conv")
                    .join(borders, ["conv", "chunk"], "left")
                    .select("conv", "chunk", (F.col("chunk") == F.col("last")).alias("ends"),
                            F.coalesce("entry", F.lit(START)).alias("entry"), "exit"))
    placed = rows.join(scratch.write(of_chunk, "chunks"), ["conv", "chunk"]).select(
        F.col("conv.conv_id").alias("conv_id"), "chunk", "position", "turn", "role", "text", "r", "ends", "entry", "exit")
    schema = T.StructType([kinds["conv_id"], kinds["turn"], *(T.StructField(n, t) for n, t in (
        ("position", T.LongType()), ("role", T.StringType()), ("repaired_role", T.StringType()),
        ("action", T.StringType()), ("inserted", T.StringType()), ("relabelled", T.BooleanType()),
        ("cost", T.LongType()), ("rendered", T.StringType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None

        def each() -> Iterator[tuple]:
            nonlocal types
            for b in batches:
                types = types or [b.schema.field(n).type for n in ("conv_id", "turn")]
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [*types, pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema.names)

        out: list[tuple] = []
        for (conv, _), group in groupby(each(), key=lambda x: (x[0], x[1])):
            group = list(group)                         # at most CHUNK turns
            *_, ends, entry, exit_ = group[0]
            texts = [x[5] or "" for x in group]
            done, _cost = repair([x[6] for x in group], entry, exit_)
            before = [entry, *(d[0] for d in done[:-1])]
            for x, s, (to, action, between), part in zip(group, before, done, rendering(done, texts, entry, ends), strict=True):
                out.append((conv, x[3], x[2], x[4], ROLES[to], action, ROLES[between], x[6] != to,
                            int(COST[x[6], s, to]), part))
            if ends:
                extra = int(END_COST[done[-1][0]])
                out[-1] = (*out[-1][:8], out[-1][8] + extra, out[-1][9])
            if len(out) >= CHUNK:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    return (placed.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "position")
                  .mapInArrow(run, schema))


def _borders(rows: DataFrame, long: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, chunk, entry, exit) of every chunk of the conversations ``long``: matrices are
    combined up to one a conversation, then the best path comes down the same levels. Null exit:
    the end of the conversation."""
    conv = rows.schema["conv"].dataType.simpleString()
    matrices = f"conv {conv}, chunk long, m array<long>"

    def of_turns(pdf: pd.DataFrame) -> pd.DataFrame:
        steps = [COST[r] for r in pdf.sort_values("position")["r"]]
        return pdf.head(1)[["conv", "chunk"]].assign(m=[combined(steps).ravel()])

    def of_matrices(pdf: pd.DataFrame) -> pd.DataFrame:
        steps = [np.asarray(m).reshape(4, 4) for m in pdf.sort_values("chunk")["m"]]
        return pdf.head(1)[["conv"]].assign(chunk=pdf["parent"].iloc[:1], m=[combined(steps).ravel()])

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        exit_ = pdf["exit"].iloc[0]
        exit_ = None if pd.isna(exit_) else int(exit_)
        entry = int(pdf["entry"].iloc[0])
        states, _ = path([np.asarray(m).reshape(4, 4) for m in pdf["m"]], entry, exit_)
        exits = [*states[:-1], exit_]
        return pdf[["conv", "chunk"]].assign(entry=[entry, *states[:-1]], exit=pd.array(exits, dtype="Int64"))

    level = rows.join(long.select("conv"), "conv").groupBy("conv", "chunk").applyInPandas(of_turns, matrices)
    levels = [scratch.write(level, "level_0")]
    top = levels[0].agg(F.max("chunk")).first()[0]
    while top is not None and top >= 1:
        up = levels[-1].withColumn("parent", F.floor(F.col("chunk") / FAN))
        levels.append(scratch.write(up.groupBy("conv", "parent").applyInPandas(of_matrices, matrices), f"level_{len(levels)}"))
        top //= FAN
    known = levels[-1].select("conv", "chunk", F.lit(START).cast("long").alias("entry"), F.lit(None).cast("long").alias("exit"))
    for level in reversed(levels[:-1]):
        given = known.withColumnRenamed("chunk", "parent")
        members = level.withColumn("parent", F.floor(F.col("chunk") / FAN)).join(given, ["conv", "parent"])
        known = members.groupBy("conv", "parent").applyInPandas(down, f"conv {conv}, chunk long, entry long, exit long")
    return known
