"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

The probability of a token is that of its class given the words before it, times that of its
place in the class given the same words. Both are softmaxes over sums of weight rows: a row is
picked by the hash of one feature (the last word, the last two, the word before the last, the
latter two kinds being n-gram and skip features) modulo a fixed table size, for places together
with the class. The SINGLES most frequent units are classes of their own, so half of all tokens
need one softmax only; the others share classes of WIDTH units of like frequency.

Units are the most frequent words, the end of a text, and TAILS tail units, one of which every
other word belongs to (by its last two bytes). A word within a tail unit has the probability
(c + 1) / (n + v + 1) of its count c, the unit's tokens n and words v, which leaves one share for
all words never seen: the probabilities of all tokens add up to one.

What is gathered from the corpus: the counts of all words of the training rows (a grouped count
with partial sums), and gradients over every training row. Training goes in ROUNDS rounds; each
training row belongs to one of them by the hash of its id. In a round every task sums the
gradient over its rows, the sums of all tasks are added up by blocks of weight rows after a
shuffle, and the weights move along the gradient, scaled by what the rows were expected to give.
The model has a fixed size (``ROWS`` x ``CLASSES``, ``PLACES`` x ``WIDTH`` floats) and is
broadcast; so is the head, at most HEAD words of at most KEY_BYTES bytes with their counts. The
counts of all other words reach the texts by a join; a word outside the head is too rare for a
hot key. Words longer than KEY_BYTES count under their SHA-256.

Tokens after the same words have the same probabilities: those are made once for each distinct
context of a window of WINDOW tokens, for the gradient as for the scores.

A text is cut into words twice, for the counts and for its numbers; the numbered texts are a
table in the shared folder, which the rounds and the scoring read.

Defined cases: a null or empty text has one token, its end. Rows with a null ``doc_id`` are
scored, not learned from, and not held out. Repeated rows count and are scored each. Without
any training row every token is unseen and both scores are 0. Sums of gradients depend on the
order of tasks in their last bits only. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.langid import fold
from rankloom.llm.shared import Scratch, as_bytes, slices, sums_between

FOLDS, HELD_OUT = 7, 2
HEAD = 1 << 18
KEY_BYTES = 64
SINGLES, CLASSES, WIDTH, TAILS = 32, 64, 64, 16
ROWS, PLACES = 1 << 14, 1 << 15          # at most 1 << 16: row numbers are sorted as 16-bit integers
ROUNDS, STEP, DAMP = 5, 0.8, 2.0
WINDOW = 1 << 19                         # tokens whose equal contexts are handled as one
BLOCK = 1 << 14                          # contexts handled at once
TASK = 1 << 22                           # tokens that one gradient is summed over, while there are cores
CHUNK = 256                              # weight rows summed as one value
HELD_KEYS = 300_000                      # distinct words a task counts before it hands them on
NUMBERS = 1 << 20                        # bytes of numbered texts handled at once
END = b" "                               # no word holds a space
BINS = 16                                # of a count, for each factor of two
_MIX = np.uint64(0x9E3779B97F4A7C15)


def keyed(word: bytes) -> bytes:
    """What a word counts under."""
    return word if len(word) <= KEY_BYTES else END + hashlib.sha256(word).hexdigest().encode()


def tail_of(key: bytes) -> int:
    return zlib.crc32(key[-2:]) % TAILS


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n): occurrences of every key in ``texts(text)``, and of END, one a row."""
    def run(batches):
        counts: Counter = Counter()
        for s in slices(batches):
            for text in as_bytes(s.column("text")):
                counts.update(text.lower().split())     # bytes: only A-Z and ASCII white space
            counts[END] += s.num_rows
            if len(counts) > HELD_KEYS:
                yield _counted(counts)
                counts = Counter()
        if counts:
            yield _counted(counts)

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(map(keyed, counts)), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                      ["word", "n"])


@dataclass
class Vocabulary:
    """Head words and their counts, units, and each tail unit's tokens and words."""
    head: dict[bytes, int]
    count: np.ndarray             # of the head's words
    unit: np.ndarray              # of the head's words
    tail_unit: np.ndarray
    tail_share: np.ndarray        # log10 of n + v + 1 of a unit; 0 for a unit that is a word
    frequency: np.ndarray         # of the units, falling
    tokens: int
    words: int

    @property
    def end(self) -> int:
        return int(self.unit[self.head[END]])

    def class_of(self) -> np.ndarray:
        u = np.arange(len(self.frequency))
        return np.where(u < SINGLES, u, SINGLES + (u - SINGLES) // WIDTH)

    def place_of(self) -> np.ndarray:
        """A unit's place in its class; -1 where it is the class."""
        u = np.arange(len(self.frequency))
        return np.where(u < SINGLES, -1, (u - SINGLES) % WIDTH)


def vocabulary(counts: DataFrame) -> tuple[Vocabulary | None, DataFrame]:
    """The vocabulary of ``counts(word, n)`` and the rows outside its head. The head is cut at
    a step of the counts' scale, so at most HEAD words are collected and no order over all of
    them is needed; END is in it in any case."""
    step = F.when(F.col("word") == END, F.lit(1 << 20)).otherwise(F.floor(F.log2("n") * BINS).cast("int"))
    binned = counts.withColumn("step", step).withColumn("tail", F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(TAILS)))
    sizes = binned.groupBy("step", "tail").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).collect()
    if not sizes:
        return None, counts
    cut, held = 1 << 20, 0
    for at in sorted({r["step"] for r in sizes}, reverse=True):
        held += sum(r["v"] for r in sizes if r["step"] == at)
        if held > HEAD + 1:
            break
        cut = at
    head = sorted(((bytes(r["word"]), r["n"]) for r in binned.filter(F.col("step") >= cut).select("word", "n").collect()),
                  key=lambda x: (-x[1], x[0]))
    tail_n, tail_v = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
    for r in sizes:
        tail_n[r["tail"]] += r["n"]
        tail_v[r["tail"]] += r["v"]
    tokens, words = int(tail_n.sum()), int(tail_v.sum())
    most = SINGLES + (CLASSES - SINGLES) * WIDTH - TAILS - 1
    own = [w for w, _ in head if w != END][:most]
    n_of = dict(head)
    for w in [*own, END]:                       # words that are units are no part of a tail
        tail_n[tail_of(w)] -= n_of[w]
        tail_v[tail_of(w)] -= 1
    units = sorted([(-int(n) - 1, b"", k) for k, n in enumerate(tail_n)] + [(-n_of[w], w, -1) for w in [*own, END]])
    place = {(w, k): i for i, (_, w, k) in enumerate(units)}
    tail_unit = np.array([place[b"", k] for k in range(TAILS)])
    share = np.zeros(len(units))
    share[tail_unit] = np.log10(tail_n + tail_v + 1.0)
    unit = np.array([place[w, -1] if (w, -1) in place else tail_unit[tail_of(w)] for w, _ in head])
    found = Vocabulary({w: i for i, (w, _) in enumerate(head)}, np.array([n for _, n in head], np.int64), unit, tail_unit, share,
                       np.array([-n for n, *_ in units], np.float64), tokens, words)
    return found, binned.filter(F.col("step") < cut).select("word", "n")


def numbered(docs: DataFrame, words: Vocabulary, folds: int, held_out: int) -> DataFrame:
    """One row for each of ``docs``: doc_id, row, round (null: not learned from), units (16-bit
    numbers, the end's last), known and log_count (of the head's words), tail_log (of the tail
    words among them, less all tail tokens' unit shares), and rare, rare_n: the words outside
    the head and how often they occur."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    learned = fold("doc_id", folds) != held_out
    turn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("maxent")), F.lit(ROUNDS)).cast("int")
    # a column of the user's own may have any name: only these go on
    source = docs.select("doc_id", F.col("text").alias("__text"), F.monotonically_increasing_id().alias("row"),
                         F.when(learned, turn).alias("round"))
    schema = source.select("doc_id", "row", "round", F.lit(b"").alias("units"), *[F.lit(0).cast(t).alias(c) for c, t in (
        ("known", "long"), ("log_count", "double"), ("tail_log", "double"))],
        F.array().cast("array<binary>").alias("rare"), F.array().cast("array<int>").alias("rare_n")).schema

    def run(batches):
        v = shared.value
        get, end = v.head.get, v.head[END]
        log_count = np.log10(v.count + 1.0)
        in_tail = v.tail_share[v.unit] > 0
        for s in slices(batches, "__text"):
            texts = [t.lower().split() for t in as_bytes(s.column("__text"))]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            flat = list(chain.from_iterable(texts))
            ids = np.fromiter(map(get, flat, repeat(-1)), np.int64, len(flat))
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            # long words and words outside the head, one by one
            rare = [Counter() for _ in texts]
            unit = v.unit[ids].astype(np.int16)
            others = np.flatnonzero(ids < 0)
            of = np.searchsorted(bounds, others, "right") - 1
            for i, doc in zip(others.tolist(), of.tolist(), strict=True):
                key = keyed(flat[i])
                at = get(key, -1)
                if at < 0:
                    rare[doc][key] += 1
                    unit[i] = v.tail_unit[tail_of(key)]
                else:
                    ids[i], unit[i] = at, v.unit[at]
            seen = ids >= 0
            ends = np.full(len(texts), log_count[end])
            known = sums_between(seen.astype(np.float64), bounds) + 1
            logs = sums_between(np.where(seen, log_count[ids], 0.0), bounds) + ends
            tails = sums_between(np.where(seen & in_tail[ids], log_count[ids], 0.0) - v.tail_share[unit], bounds)
            yield pa.RecordBatch.from_arrays(
                [s.column("doc_id"), s.column("row"), s.column("round"),
                 pa.array([unit[a:b].tobytes() + np.int16(v.end).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)],
                          pa.binary()),
                 pa.array(known.astype(np.int64)), pa.array(logs), pa.array(tails),
                 pa.array([list(r) for r in rare], pa.list_(pa.binary())),
                 pa.array([list(r.values()) for r in rare], pa.list_(pa.int32()))], schema.names)

    return source.mapInArrow(run, schema)


def mixed(*parts) -> np.ndarray:
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for x in parts:
            h = (h ^ np.asarray(x).astype(np.uint64)) * _MIX
            h = h ^ (h >> np.uint64(29))
    return h


def class_rows(before: list[np.ndarray]) -> list[np.ndarray]:
    """Weight rows of the class features: the last word, the last two, the one before the last."""
    one, two = before
    return [(h & np.uint64(ROWS - 1)).astype(np.uint16) for h in (mixed(1, one), mixed(2, one, two), mixed(3, two))]


def place_rows(before: list[np.ndarray], classes: np.ndarray) -> list[np.ndarray]:
    one, two = before
    return [(h & np.uint64(PLACES - 1)).astype(np.uint16) for h in (mixed(1, one, classes), mixed(3, two, classes))]


def logits(rows: list[np.ndarray], weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    z = weights[rows[0]]
    for r in rows[1:]:
        z += weights[r]
    z += bias
    return z


def softmax(rows: list[np.ndarray], weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities, and the logarithm of what they were divided by."""
    z = logits(rows, weights, bias)
    most = z.max(axis=1, keepdims=True)
    z -= most
    np.exp(z, out=z)
    total = z.sum(axis=1, keepdims=True)
    z /= total
    return z, (most.astype(np.float64) + np.log(total.astype(np.float64)))[:, 0]


def distinct(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``keys`` below ``size``, and each key's place among them."""
    seen = np.zeros(size, bool)
    seen[keys] = True
    found = np.flatnonzero(seen)
    number = np.empty(size, np.int32)
    number[found] = np.arange(len(found), dtype=np.int32)
    return found, number[keys]


@dataclass
class Contexts:
    """Tokens whose probabilities one table of weights gives: the rows of each distinct context (and its class, for
    places), each token's context and target."""
    rows: list[np.ndarray]
    kinds: np.ndarray | None
    of: np.ndarray
    target: np.ndarray

    def blocks(self) -> Iterator[tuple[slice, list[np.ndarray], np.ndarray | slice]]:
        for a in range(0, len(self.rows[0]), BLOCK):
            s = slice(a, a + BLOCK)
            yield s, [r[s] for r in self.rows], slice(None) if self.kinds is None else self.kinds[s]

    def log(self, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Natural logarithm of each token's probability."""
        totals = np.empty(len(self.rows[0]))
        for s, rows, kinds in self.blocks():
            totals[s] = softmax(rows, weights, bias[kinds])[1]
        own = bias[self.target] if self.kinds is None else bias[self.kinds[self.of], self.target]
        z = own.astype(np.float64)
        for r in self.rows:
            z += weights[r[self.of], self.target]
        return z - totals[self.of]


@dataclass
class Model:
    """Biases from the units' frequencies, and the trained weight rows."""
    class_of: np.ndarray
    place_of: np.ndarray
    class_bias: np.ndarray
    place_bias: np.ndarray
    class_weights: np.ndarray
    place_weights: np.ndarray

    @staticmethod
    def start(words: Vocabulary) -> "Model":
        kind, place, f = words.class_of(), words.place_of(), words.frequency
        total = np.bincount(kind, f, CLASSES)
        class_bias = np.where(total > 0, np.log(np.maximum(total, 1) / total.sum()), -1e30)
        place_bias = np.full((CLASSES, WIDTH), -1e30)
        shared = place >= 0
        place_bias[kind[shared], place[shared]] = np.log(f[shared] / total[kind[shared]])
        return Model(kind, place, class_bias.astype(np.float32), place_bias.astype(np.float32),
                     np.zeros((ROWS, CLASSES), np.float32), np.zeros((PLACES, WIDTH), np.float32))

    def expected(self) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the classes, and of the places over all classes, before training."""
        share = np.exp(self.class_bias)
        places = (np.exp(np.maximum(self.place_bias, -60)) * share[:, None])[SINGLES:].sum(axis=0)
        return share, places / max(places.sum(), 1e-30)

    def parts(self, units: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, Contexts, np.ndarray, Contexts]]:
        """For each window of the texts units[bounds[i]:bounds[i + 1]]: its start, the classes of its tokens, the
        tokens that have a place in their class, and those places."""
        none = len(self.class_of)
        begins = np.repeat(bounds[:-1], np.diff(bounds))
        for a in range(0, len(units), WINDOW):
            b = min(a + WINDOW, len(units))
            at = np.arange(a, b)
            one, two = (np.where(at - d >= begins[a:b], units[np.maximum(at - d, 0)], none) for d in (1, 2))
            y = units[a:b]
            kind = self.class_of[y]
            before, of = distinct(one * (none + 1) + two, (none + 1) ** 2)
            before = list(np.divmod(before, none + 1))
            inner = np.flatnonzero(self.place_of[y] >= 0)
            pairs, pair = np.unique(of[inner].astype(np.int64) * CLASSES + kind[inner], return_inverse=True)
            at, kinds = np.divmod(pairs, CLASSES)
            yield (a, Contexts(class_rows(before), None, of, kind), inner,
                   Contexts(place_rows([x[at] for x in before], kinds), kinds, pair, self.place_of[y[inner]]))

    def log10(self, units: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log probability of every token's unit."""
        out = np.zeros(len(units))
        for a, classes, inner, places in self.parts(units, bounds):
            p = classes.log(self.class_weights, self.class_bias)
            p[inner] += places.log(self.place_weights, self.place_bias)
            out[a:a + len(p)] = np.maximum(p / math.log(10), -300.0)
        return out

    def add_gradient(self, units: np.ndarray, bounds: np.ndarray, sums: "Gradient") -> None:
        for _, classes, _, places in self.parts(units, bounds):
            sums.classes.add(classes, self.class_weights, self.class_bias)
            sums.places.add(places, self.place_weights, self.place_bias)


class RowSums:
    """Sums of (observed - expected) for each weight row, and how often the row was used."""

    def __init__(self, rows: int, width: int):
        self.g, self.n = np.zeros((rows, width), np.float32), np.zeros(rows, np.int64)

    def add(self, some: Contexts, weights: np.ndarray, bias: np.ndarray) -> None:
        """What was observed is counted by token; what was expected is the same for all tokens of a context."""
        times = np.bincount(some.of, minlength=len(some.rows[0]))
        width = self.g.shape[1]
        for r in some.rows:
            self.g += np.bincount(r[some.of].astype(np.int64) * width + some.target, minlength=self.g.size).reshape(self.g.shape)
            self.n += np.bincount(r, times, len(self.n)).astype(np.int64)
        for at, rows, kinds in some.blocks():
            p = softmax(rows, weights, bias[kinds])[0]
            p *= times[at, None]
            for r in rows:
                order = np.argsort(r, kind="stable")
                s = r[order]
                first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
                self.g[s[first]] -= np.add.reduceat(p[order], first, axis=0)

    def chunks(self) -> Iterator[tuple[int, bytes, bytes]]:
        for at in range(0, len(self.n), CHUNK):
            if self.n[at:at + CHUNK].any():
                yield at, self.g[at:at + CHUNK].tobytes(), self.n[at:at + CHUNK].tobytes()

    def take(self, at: int, g: bytes, n: bytes) -> None:
        self.g[at:at + CHUNK] += np.frombuffer(g, np.float32).reshape(CHUNK, -1)
        self.n[at:at + CHUNK] += np.frombuffer(n, np.int64)

    def step(self, share: np.ndarray) -> np.ndarray:
        """The move of the weights: at most STEP for each."""
        return STEP * self.g / (self.n[:, None] * share + np.abs(self.g) + DAMP)


class Gradient:
    def __init__(self):
        self.classes, self.places = RowSums(ROWS, CLASSES), RowSums(PLACES, WIDTH)


def _texts(batches, column: str):
    for s in slices(batches, column, NUMBERS):
        values = [np.frombuffer(x, np.int16) for x in s.column(column).to_pylist()]
        yield s, np.concatenate(values).astype(np.int64), np.concatenate(([0], np.cumsum([len(x) for x in values])))


def train(texts: DataFrame, model: Model, tokens: int) -> Model:
    """The model after ROUNDS rounds over ``texts(round, units)``, which hold so many tokens."""
    sc = texts.sparkSession.sparkContext
    tasks = max(1, min(-(-tokens // (ROUNDS * TASK)), 4 * sc.defaultParallelism))
    share, places = model.expected()
    schema = "part int, at int, g binary, n binary"
    for turn in range(ROUNDS):
        shared = sc.broadcast(model)

        def gradient(batches, shared=shared):
            m, sums, rows = shared.value, Gradient(), 0
            for _, units, bounds in _texts(batches, "units"):
                m.add_gradient(units, bounds, sums)
                rows += len(units)
            found = [(k, *c) for k, part in enumerate((sums.classes, sums.places)) for c in part.chunks()] if rows else []
            for i in range(0, len(found), 32):
                yield pa.RecordBatch.from_pylist([dict(zip(("part", "at", "g", "n"), x, strict=True)) for x in found[i:i + 32]],
                                                 schema=_CHUNKS)

        # a gradient for every TASK tokens, not for every split, and a few for each core at most
        mine = texts.filter(F.col("round") == turn).select("units").coalesce(tasks)
        sums = Gradient()
        for r in mine.mapInArrow(gradient, schema).repartition("part", "at").mapInArrow(added, schema).collect():
            (sums.classes, sums.places)[r["part"]].take(r["at"], r["g"], r["n"])
        model = Model(model.class_of, model.place_of, model.class_bias, model.place_bias,
                      model.class_weights + sums.classes.step(share).astype(np.float32),
                      model.place_weights + sums.places.step(places).astype(np.float32))
        shared.destroy()
    return model


_CHUNKS = pa.schema([("part", pa.int32()), ("at", pa.int32()), ("g", pa.binary()), ("n", pa.binary())])


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of all tasks, equal places added up."""
    sums: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for part, at, g, n in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "g", "n")), strict=True):
            if (part, at) not in sums:
                sums[part, at] = np.zeros(len(g) // 4), np.zeros(len(n) // 8, np.int64)
            sums[part, at][0][:] += np.frombuffer(g, np.float32)
            sums[part, at][1][:] += np.frombuffer(n, np.int64)
    for (part, at), (g, n) in sums.items():
        yield pa.RecordBatch.from_pylist([{"part": part, "at": at, "g": g.astype(np.float32).tobytes(), "n": n.tobytes()}],
                                         schema=_CHUNKS)


def score(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of
    ``docs``; learned from the rows whose fold is not ``held_out``."""
    held = F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out")
    scratch = Scratch(docs.sparkSession, "maxent")
    learned = docs.filter(fold("doc_id", folds) != held_out).select(F.col("text"))
    counts = scratch.write(count_words(learned), "counts")
    words, outside = vocabulary(counts)
    if words is None:
        tokens = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")) + 1
        zero = [F.lit(0).cast(t).alias(c) for c, t in (
            ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double"))]
        return docs.select("doc_id", held, tokens.cast("long").alias("n_tokens"), *zero)
    texts = scratch.write(numbered(docs, words, folds, held_out), "texts")
    model = docs.sparkSession.sparkContext.broadcast(train(texts.select("round", "units"), Model.start(words), words.tokens))

    def run(batches):
        m = model.value
        for s, units, bounds in _texts(batches, "units"):
            yield pa.RecordBatch.from_arrays(
                [s.column(c) for c in ("doc_id", "row", "known", "log_count", "tail_log")]
                + [pa.array(np.diff(bounds)), pa.array(sums_between(m.log10(units, bounds), bounds))], scored.names)

    source = texts.select("doc_id", "row", "known", "log_count", "tail_log", "units")
    scored = source.select("doc_id", "row", "known", "log_count", "tail_log", F.lit(0).cast("long").alias("n_tokens"),
                           F.lit(0.0).alias("unit_log")).schema
    each = texts.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")) \
        .select("row", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("times"))
    rare = each.join(outside, "word").groupBy("row").agg(
        F.sum("times").alias("times"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("logs"))
    logs, times = F.coalesce("logs", F.lit(0.0)), F.coalesce("times", F.lit(0))
    per_token = math.log10(words.tokens + words.words + 1)
    return source.mapInArrow(run, scored).join(rare, "row", "left").select(
        "doc_id", held, "n_tokens", (F.col("known") + times).alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("log_count") + logs - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        (F.col("unit_log") + F.col("tail_log") + logs).alias("score"))
