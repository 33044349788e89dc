"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

A word is a vector of letter counts (letters folded into DIMENSIONS kinds). One inserted,
deleted or replaced letter changes the squared distance of two such vectors by at most two, so
pairs at most two apart are all that can be near. Squared distances of two blocks of words are one
NumPy product: |x|^2 + |y|^2 - 2 x.y, exact in floats. The pairs kept are verified by their edits.

Words are blocked by length, and within a length by how many of their letters belong to each of
two classes of letters. One edit changes length and class counts by at most one, so a block meets
itself and the seven blocks that follow it by one edit, of the same or the next length; no other pair
can be near. A block is dealt by hash into tiles of about TILE words; each pair of tiles is one
row of a table, made by equi-joins on blocks and tiles, and one product. No pair of words leaves a
product unless it is at most two apart.

Counting: every task counts words and hands on partial counts; those that the deletion rule changes
are found once for each distinct word of a document. The forms' roots are found by pointer
doubling, a join a round; a form has at least RATIO times its word's occurrences, so the rounds grow
with the logarithm of the logarithm of the corpus. Tables are written to the shared folder.

Defined cases: a null or empty text has no words. A null ``doc_id`` is read as empty text in the
deletion rule. Repeated rows count each. A word without near words has no form and is its own
root. Of near words with equal counts the first in code-point order is the form. Other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.shared import Scratch, slices

MIN_LETTERS, MIN_COUNT, RATIO, DELETED = 6, 5, 5, 199
TILE = 1024
DIMENSIONS = 32
HELD_WORDS = 300_000        # distinct words a task counts before it hands them on
PAIRS = 100_000             # verified at once
#: Latin-1 bytes: ASCII letters lower-cased, letters from U+00C0 as they are, all else a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: The kind of a letter, and whether it is of the first or second class (frequent vowels and consonants).
_KIND = np.array([b - 97 if 97 <= b <= 122 else 26 + b % 6 for b in range(256)])
_FIRST, _SECOND = b"aeo", b"nrst"


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased runs of a text, as Latin-1."""
    return (text or "").encode("latin-1", "replace").translate(_LETTERS).split()


def shortened(word: bytes, h: int) -> bytes:
    at = h % len(word)
    return word[:at] + word[at + 1:]


def count_words(docs: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(word, n): occurrences of the words of at least ``min_letters`` after the deletion rule."""
    source = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), F.col("text").alias("__text"))

    def run(batches):
        counts: Counter = Counter()
        other: dict[bytes, bytes] = {}          # UTF-8 of the words with other than ASCII letters
        for s in slices(batches, "__text"):
            for doc_id, text in zip(s.column("__id").to_pylist(), s.column("__text").to_pylist(), strict=True):
                words = [w for w in words_of(text) if len(w) >= min_letters]
                counts.update(words)
                start = zlib.crc32(f"{doc_id}:".encode())
                for w in set(words):
                    if w.isascii():
                        h = zlib.crc32(w, start)
                    else:
                        h = zlib.crc32(other.get(w) or other.setdefault(w, w.decode("latin-1").encode()), start)
                    if h % DELETED == 0:
                        n = words.count(w)
                        counts[w] -= n
                        counts[shortened(w, h)] += n
            if len(counts) > HELD_WORDS:
                yield _counted(counts, min_letters)
                counts = Counter()
            if len(other) > HELD_WORDS:
                other = {}
        yield _counted(counts, min_letters)

    return source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(counts: Counter, min_letters: int) -> pa.RecordBatch:
    kept = {w: n for w, n in counts.items() if n and len(w) >= min_letters}
    return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in kept], pa.string()),
                                       pa.array(list(kept.values()), pa.int64())], ["word", "n"])


#: What one edit adds to (length, first, second): nothing, a replaced letter, or an inserted one.
STEPS = [(0, 0, 0), (0, 1, 0), (0, 0, 1), (0, 1, -1), (1, 0, 0), (1, 1, 0), (1, 0, 1)]


def tiles(words: DataFrame, scratch: Scratch, tile: int = TILE) -> DataFrame:
    """(length, first, second, tile, words): the words of every tile of every block, packed."""
    among = lambda letters: F.length("word") - F.length(F.translate("word", letters.decode(), ""))
    placed = words.select("word", F.length("word").alias("length"), among(_FIRST).alias("first"), among(_SECOND).alias("second"))
    block = ["length", "first", "second"]
    sizes = placed.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    dealt = placed.join(sizes, block).withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    return scratch.write(dealt.groupBy(*block, "tile").agg(
        F.first("tiles").alias("tiles"), F.array_sort(F.collect_list("word")).alias("words")), "tiles")


def candidates(packed: DataFrame) -> DataFrame:
    """(words, others, same): every pair of tiles whose words can be one edit apart, once."""
    block = ["length", "first", "second"]
    steps = F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"d{i}") for i, x in enumerate(s)]) for s in STEPS])).alias("s")
    left = packed.select(*block, "tile", "words", steps).select(
        *[(F.col(c) + F.col(f"s.d{i}")).alias(c) for i, c in enumerate(block)], F.col("tile").alias("own"), "words",
        (F.abs("s.d0") + F.abs("s.d1") + F.abs("s.d2") == 0).alias("same"))
    sizes = packed.groupBy(*block).agg(F.first("tiles").alias("tiles"))
    met = left.join(sizes, block).select(*block, "own", "words", "same", F.explode(
        F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile")).filter(~F.col("same") | (F.col("own") <= F.col("tile")))
    right = packed.select(*block, "tile", F.col("words").alias("others"))
    return met.join(right, [*block, "tile"]).select("words", "others", (F.col("same") & (F.col("own") == F.col("tile"))).alias("same"))


def counts_matrix(words: list[bytes]) -> np.ndarray:
    out = np.zeros((len(words), DIMENSIONS), np.float32)
    flat = np.frombuffer(b"".join(words), np.uint8)
    np.add.at(out, (np.repeat(np.arange(len(words)), [len(w) for w in words]), _KIND[flat]), 1)
    return out


def one_edit(a: np.ndarray, b: np.ndarray, shorter: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """True for rows of letters ``a`` and ``b`` (zero-padded, of lengths ``shorter`` and ``longer``, at
    most one more) that differ by exactly one replaced or inserted letter."""
    width = a.shape[1]
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    replaced = (shorter == longer) & (differ.sum(axis=1) == 1)
    # after the first difference the rest of the shorter must follow one place later in the longer
    later = np.arange(width - 1)[None, :] >= first[:, None]
    inserted = (longer == shorter + 1) & ~((a[:, :-1] != b[:, 1:]) & later).any(axis=1)
    return replaced | inserted


def near_in(words: list[str], others: list[str], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of words and others exactly one edit apart; ``others`` are as long, or one
    letter longer. With ``same`` both are one list, and each pair is found once."""
    x, y = [w.encode("latin-1") for w in words], [w.encode("latin-1") for w in others]
    mx, my = counts_matrix(x), counts_matrix(y)
    distance = (mx * mx).sum(axis=1)[:, None] + (my * my).sum(axis=1)[None, :] - 2 * (mx @ my.T)
    i, j = np.nonzero(distance <= 2)
    if same:
        i, j = i[i < j], j[i < j]
    shorter, longer = len(x[0]), len(y[0])
    pad = lambda ws: np.frombuffer(b"".join(w.ljust(longer + 1, b"\0") for w in ws), np.uint8).reshape(len(ws), -1)
    a, b = pad(x), pad(y)
    true = [one_edit(a[i[k:k + PAIRS]], b[j[k:k + PAIRS]], np.int64(shorter), np.int64(longer)) for k in range(0, len(i), PAIRS)]
    kept = np.concatenate(true) if true else np.zeros(0, bool)
    return i[kept], j[kept]


def near_pairs(words: DataFrame, scratch: Scratch, tile: int = TILE) -> DataFrame:
    """(a, b): every two of ``words(word)`` that are one edit apart, once."""
    def run(batches):
        for batch in batches:
            for words, others, same in zip(*(batch.column(c) for c in ("words", "others", "same")), strict=True):
                x, y = words.as_py(), others.as_py()
                i, j = near_in(x, y, same.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for k in i], pa.string()), pa.array([y[k] for k in j], pa.string())],
                                                 ["a", "b"])

    met = candidates(tiles(words, scratch, tile))
    return met.repartition(F.xxhash64(F.get("words", F.lit(0)), F.get("others", F.lit(0)))).mapInArrow(run, "a string, b string")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of every row of ``forms(word, form)``: the last word that forms lead to."""
    at, turn = scratch.write(forms.select("word", F.col("form").alias("root")), "roots_0"), 0
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        turn += 1
        at = scratch.write(moved, f"roots_{turn}")
        scratch.drop(f"roots_{turn - 1}")
        if at.filter("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: int = RATIO,
             tile: int = TILE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs``."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.write(count_words(docs, min_letters).filter(F.col("n") >= min_count), "words")
    pairs = scratch.write(near_pairs(words, scratch, tile), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("bn")), "b")
    best = counted.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("bn")).alias("n"), F.col("b").alias("word"))).alias("x"))
    near = scratch.write(words.join(best.withColumnRenamed("a", "word"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("x.n") >= ratio * F.col("n"), F.struct(F.col("x.word").alias("word"), (-F.col("x.n")).alias("n"))).alias("form")), "near")
    scratch.drop("pairs")
    led = roots(near.filter("form IS NOT NULL").select("word", F.col("form.word").alias("form")), scratch)
    return near.join(led, "word", "left").select(
        "word", F.col("form.word").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("form.n").alias("form_n"))
