"""Language identification by word-first backoff.

A word that some language's vocabulary knows is scored by its log frequency in each
language. An unseen word falls back to its character n-grams, longest first: the first
length with any known n-gram decides, and the word's score is the mean over those n-grams.
Words are maximal runs of letters and their combining marks, lower-cased; digits, numerals and
signs end a word. N-grams see the word between ``^`` and ``$``.

Learning counts words over a bounded, hash-chosen sample of labelled rows
(``docs_per_lang`` rows of each language, whole texts); the model keeps the ``max_words``
most frequent words and ``max_grams`` n-grams of each length per language. Its table has a column
for each language, so with many languages their vocabularies shrink alike until the table takes
MODEL_BYTES at most: what is collected and broadcast has that bound whatever the number of
languages, which itself must leave LEAST_KINDS entries to each. Prediction reads whole texts in one
pass over the scan, without a shuffle, a bounded number of words at a time.

Defined cases: a null text or one without a letter gives ``und`` with score 0; so does every
row when nothing could be learned (no labelled rows). A text with letters but no known word
or n-gram gets every language with equal probability: the first by name, score 1/languages.
Ties go to the first language by name. Rows with a null ``doc_id`` are predicted but never
learned from. Repeated rows are predicted each. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rankloom.llm.shared import CACHE_ENTRIES, RaggedCache, Scratch, as_bytes, slices, sums_between

FOLDS = 5
DOCS_PER_LANG = 1500
MAX_WORDS = 20_000
MAX_GRAMS = 10_000
LENGTHS = (5, 4, 3, 2, 1)
SMOOTHING = 0.5
PRIOR = 5.0                 # words that count as half known besides a text's own
UNKNOWN = "und"
SLICE_BYTES = 1 << 20       # text scored at once
NUMBERS = 4 << 20           # numbers held for the words scored at once, and for those remembered
MODEL_BYTES, LEAST_KINDS = 256 << 20, 60
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def fold(doc_id: str | Column = "doc_id", folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null for a null id)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(folds))


def hashed_share(share: Column, salt: str, doc_id: str = "doc_id") -> Column:
    """True for about ``share`` of the ids, chosen by hash: the same rows on every run."""
    return F.pmod(F.xxhash64(F.col(doc_id), F.lit(salt)), F.lit(1 << 30)) < share * (1 << 30)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    if n == 1:
        return list(word)
    padded = f"^{word}$"
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


@dataclass
class LanguageModel:
    """``table``: for each known word and n-gram, the log of each language's share of its relative
    frequency; ``words`` and ``grams`` give their rows."""
    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    table: np.ndarray

    def knows(self) -> np.ndarray:
        """1 where a language knows a row's word: its share is over half of what no knowledge gives."""
        least = -np.log(2 * max(1, len(self.langs)))
        return (self.table >= least).astype(np.float32)

    def rows_of(self, word: str) -> list[int]:
        """The word's row, or those of its longest known n-grams; empty if nothing is known."""
        known = self.words.get(word)
        if known is not None:
            return [known]
        get = self.grams.get
        for n in LENGTHS:
            found = [i for g in grams_of(word, n) if (i := get(f"{n}{g}")) is not None]
            if found:
                return found
        return []

    def word_score(self, word: str) -> np.ndarray:
        rows = self.rows_of(word)
        return self.table[rows].mean(axis=0) if rows else np.zeros(len(self.langs), np.float32)


def learn(docs: DataFrame, folds: int = FOLDS, docs_per_lang: int = DOCS_PER_LANG,
          max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> LanguageModel:
    """Counts over the sampled rows whose fold is not 0; the model is collected, its size
    bounded by the two vocabulary parameters for each language."""
    labelled = docs.filter(F.col("lang").isNotNull() & (fold("doc_id", folds) != 0))
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageModel([], {}, {}, np.zeros((0, 0), np.float32))
    langs = sorted(sizes)
    kinds = max_words + len(LENGTHS) * max_grams
    fit = min(1.0, MODEL_BYTES / (4 * len(langs) ** 2 * kinds))
    if fit * kinds < LEAST_KINDS:
        raise ValueError(f"{len(langs)} languages leave under {LEAST_KINDS} words and n-grams to each in a model of {MODEL_BYTES} bytes")
    max_words, max_grams = int(max_words * fit), int(max_grams * fit)
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, docs_per_lang / sizes[lang]))])
    sample = labelled.filter(hashed_share(share[F.col("lang")], "langid")).select("lang", "text")

    def count_words(batches):
        for s in slices(batches):
            counts: Counter = Counter()
            for lang, text in zip(s.column("lang").to_pylist(), s.column("text").to_pylist(), strict=True):
                for w in words_of(text or ""):
                    counts[lang, w] += 1
            yield _counted(counts)

    words = (sample.mapInArrow(count_words, "lang string, gram string, n long")
                   .groupBy("lang", "gram").agg(F.sum("n").alias("n")))

    def count_grams(batches):
        for s in slices(batches, None):
            counts: Counter = Counter()
            for lang, word, n in zip(*(s.column(c).to_pylist() for c in ("lang", "gram", "n")), strict=True):
                counts[lang, f"0{word}"] += n
                for size in LENGTHS:
                    for g in grams_of(word, size):
                        counts[lang, f"{size}{g}"] += n
            yield _counted(counts)

    scratch = Scratch(docs.sparkSession, "langid")        # written: its totals and its best are two jobs
    grams = scratch.write(words.mapInArrow(count_grams, "lang string, gram string, n long")
                               .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
                               .withColumn("size", F.substring("gram", 1, 1)), "grams")
    totals = grams.groupBy("lang", "size").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    best = (grams.withColumn("rank", F.row_number().over(
                W.partitionBy("lang", "size").orderBy(F.desc("n"), "gram")))
            .filter(F.col("rank") <= F.when(F.col("size") == "0", max_words).otherwise(max_grams)))
    total = {(r["lang"], r["size"]): (r["total"], r["kinds"]) for r in totals.collect()}
    counts: dict[str, dict[str, int]] = {}
    for lang, gram, n in best.select("lang", "gram", "n").toLocalIterator():
        counts.setdefault(gram, {})[lang] = n
    scratch.drop("grams")
    found, at = list(counts), {x: i for i, x in enumerate(langs)}
    # what an unseen kind of a size has in each language; a seen one differs by its count only
    of = {size: np.array([total.get((x, size), (0, 0)) for x in langs], np.float64) for size in "0" + "".join(map(str, LENGTHS))}
    rest = {size: np.log(t[:, 0] + SMOOTHING * (t[:, 1] + 1)) for size, t in of.items()}
    logs = np.empty((len(found), len(langs)), np.float32)
    for i, g in enumerate(found):
        row = np.log(SMOOTHING) - rest[g[0]]
        for lang, n in counts[g].items():
            row[at[lang]] = np.log(n + SMOOTHING) - rest[g[0]][at[lang]]
        logs[i] = row - np.logaddexp.reduce(row)
    words_ = {g[1:]: i for i, g in enumerate(found) if g[0] == "0"}
    grams_ = {g: i for i, g in enumerate(found) if g[0] != "0"}
    return LanguageModel(langs, words_, grams_, logs)


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()),
         pa.array(list(counts.values()), pa.int64())], ["lang", "gram", "n"])


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` plus lang_pred, score and known of the whole ``text`` column; known is
    the share of the text's words that the predicted language's vocabulary holds, with PRIOR more words of which
    half are known: a long text needs real words, a text of a few words is not judged by them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    read = text if text in keep else "__text"           # a kept text goes to the tasks once
    source = docs.select(*[F.col(c) for c in keep], *([] if text in keep else [F.col(text).alias(read)]))
    schema = source.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("known")).schema

    def run(batches):
        m = shared.value
        n_langs, knows = len(m.langs), m.knows()
        width = 2 * n_langs + 2

        def resolve(chunks):
            # rows of all words of all chunks, each with its share of its word's mean, and of known words
            rows, shares, bounds, letters, whole, ends, sizes = [], [], [0], [], [], [0], []
            for chunk in chunks:
                text = chunk.decode("utf-8", "replace")
                words = words_of(text)
                for word in words:
                    if word in m.words:
                        whole.append(m.words[word])
                    found = m.rows_of(word)
                    rows += found
                    shares += [1 / max(1, len(found))] * len(found)
                bounds.append(len(rows))
                ends.append(len(whole))
                sizes.append(len(words))
                letters.append(bool(words) or any(map(str.isalpha, text)))
            values = np.zeros((len(chunks), width), np.float32)
            values[:, -2], values[:, -1] = letters, sizes
            if rows:
                values[:, :n_langs] = sums_between(m.table[rows] * np.array(shares)[:, None], np.array(bounds))
            if whole:
                values[:, n_langs:-2] = sums_between(knows[whole], np.array(ends))
            return np.full(len(chunks), width), values.ravel()

        # a chunk of text holds a row of ``width`` numbers: many languages mean fewer chunks at a time
        cache = RaggedCache(resolve, np.float32, min(CACHE_ENTRIES, NUMBERS // width))
        piece = max(1, NUMBERS // width)
        for s in slices(batches, read, max(1024, min(SLICE_BYTES, 6 * piece))):
            texts = [t.split() for t in as_bytes(s.column(read))]
            parts = [t[i:i + piece] for t in texts for i in range(0, max(1, len(t)), piece)]
            held, many = [], max(1, len(parts)) if len(parts) == len(texts) else 1      # a long text goes piece by piece
            for i in range(0, len(parts), many):
                flat, bounds = cache.rows(parts[i:i + many])
                held.append(sums_between(flat.reshape(-1, width), bounds // width))
            owner = np.repeat(np.arange(len(texts)), [len(range(0, max(1, len(t)), piece)) for t in texts])
            sums = np.zeros((len(texts), width))
            np.add.at(sums, owner, np.concatenate(held))
            scores, letters = sums[:, :n_langs], sums[:, -2] > 0.5
            known = np.zeros(len(sums))
            if n_langs:
                best = scores.argmax(axis=1)
                known = (sums[np.arange(len(sums)), n_langs + best] + PRIOR / 2) / (sums[:, -1] + PRIOR)
                sure = 1.0 / np.exp(np.minimum(scores - scores.max(axis=1, keepdims=True), 0)).sum(axis=1)
            else:
                best, sure, letters = np.zeros(len(sums), int), np.zeros(len(sums)), letters & False
            yield pa.RecordBatch.from_arrays(
                [*[s.column(c) for c in keep],
                 pa.array([m.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], pa.string()),
                 pa.array(np.where(letters, sure, 0.0), pa.float64()), pa.array(np.where(letters, known, 0.0), pa.float64())],
                [*keep, "lang_pred", "score", "known"])

    return source.mapInArrow(run, schema)


def identify(docs: DataFrame, folds: int = FOLDS, **learning) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``."""
    held = F.coalesce(fold("doc_id", folds) == 0, F.lit(False))
    return predict(docs.select("doc_id", "text"), learn(docs, folds, **learning), ["doc_id"]).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score")
