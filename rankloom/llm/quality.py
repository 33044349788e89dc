"""Quality classifier: logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader (FTRL-proximal) updates.

Tokens are runs of word characters and runs of other characters of the whole text, case
kept. Features are token unigrams and bigrams hashed into ``buckets`` slots (a token next to
itself is one bigram for all tokens: a repeat); a feature's value is its share of the text's
features times ``SCALE``. A score is the sparse dot product
of these values with the weights, plus the bias, through the logistic function.

Training takes at most ``docs_per_label`` labelled rows of each label, chosen by hash, whole
texts; the updates run over them in hash order in one task, whose input this parameter
bounds. The weights (``buckets`` floats) are broadcast. Scoring is one pass over the scan.

Defined cases: null and empty texts have no features and get the bias's score. Labels that
are null count as missing; a document labelled more than once has its lowest label. Without
both labels in the training rows there is nothing to learn and every score is 0.5. Rows with
a null ``doc_id`` are scored but never learned from. Repeated rows are scored each.
Other columns of the input are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.langid import fold, hashed_share
from rankloom.llm.shared import RaggedCache, as_bytes, slices, sums_between

FOLDS, HELD_OUT = 3, 1
DOCS_PER_LABEL = 2500
BUCKETS = 1 << 18
SCALE = 10.0
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.1, 4
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class Features:
    """Hashed unigrams and bigrams of whole texts, a slice of documents at a time."""

    def __init__(self, buckets: int):
        self.mask = np.uint64(buckets - 1)
        self.repeat = xxhash.xxh64_intdigest("\0repeat") & (buckets - 1)
        self.cache = RaggedCache(self._resolve, np.uint64)

    @staticmethod
    def _resolve(chunks):
        tokens = [_TOKEN.findall(c.decode("utf-8", "replace")) for c in chunks]
        flat = [xxhash.xxh64_intdigest(t) for ts in tokens for t in ts]
        return [len(ts) for ts in tokens], np.array(flat, np.uint64)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(unigram slots, their document bounds, bigram slots, their document bounds)."""
        h, bounds = self.cache.rows([t.split() for t in texts])
        uni = (h & self.mask).astype(np.int64)
        mixed = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] ^ (h[1:] >> np.uint64(29)))
        bi = ((mixed ^ (mixed >> np.uint64(32))) & self.mask).astype(np.int64)
        bi[h[:-1] == h[1:]] = self.repeat
        # a pair across two documents is no bigram
        inside = np.ones(len(bi), bool)
        cuts = bounds[1:-1]
        inside[cuts[(cuts > 0) & (cuts < len(h))] - 1] = False
        kept = np.concatenate(([0], np.cumsum(inside)))
        return uni, bounds, bi[inside], kept[np.minimum(np.maximum(bounds, 0), len(bi))] if len(h) else bounds


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT,
          docs_per_label: int = DOCS_PER_LABEL, buckets: int = BUCKETS) -> np.ndarray:
    """Weights (``buckets`` floats, then the bias)."""
    known = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
                   .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
                   .filter(fold("doc_id", folds) != held_out))
    sizes = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    if not {0, 1} <= set(sizes):
        return np.zeros(buckets + 1, np.float32)
    share = F.create_map(*[F.lit(x) for q in (0, 1) for x in (q, min(1.0, docs_per_label / sizes[q]))])
    sample = (known.filter(F.col("quality").isin(0, 1))
                   .filter(hashed_share(share[F.col("quality")], "quality"))
                   .limit(4 * docs_per_label))
    # a repeated id is one row, that of the smallest text hash: the fit's input is bounded by the labels
    rows = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality")
                .agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("row")).select("doc_id", "row.text", "quality"))

    def extract(batches):
        features = Features(buckets)
        for s in slices(batches):
            uni, ub, bi, bb = features.of(as_bytes(s.column("text")))
            slots, values = [], []
            for i in range(s.num_rows):
                idx, n = np.unique(np.concatenate((uni[ub[i]:ub[i + 1]], bi[bb[i]:bb[i + 1]])), return_counts=True)
                slots.append(idx.astype("<i4").tobytes())
                values.append((SCALE * n / max(1, n.sum())).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [s.column("doc_id"), s.column("quality"), pa.array(slots, pa.binary()), pa.array(values, pa.binary())],
                ["doc_id", "quality", "slots", "x"])

    kind = dict(docs.dtypes)["doc_id"]
    featured = rows.mapInArrow(extract, f"doc_id {kind}, quality int, slots binary, x binary")

    def fit(pdf):
        order = sorted(range(len(pdf)), key=lambda i: (xxhash.xxh64_intdigest(str(pdf["doc_id"][i])), pdf["slots"][i]))
        data = [(np.frombuffer(pdf["slots"][i], "<i4"), np.frombuffer(pdf["x"][i], "<f4"), int(pdf["quality"][i]))
                for i in order]
        return pdf.head(1)[[]].assign(w=[ftrl(data, buckets).astype("<f4").tobytes()])

    first = featured.withColumn("job", F.lit(0)).groupBy("job").applyInPandas(fit, "w binary").first()
    return np.frombuffer(first["w"], "<f4") if first else np.zeros(buckets + 1, np.float32)


def ftrl(data: list[tuple[np.ndarray, np.ndarray, int]], buckets: int, epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal: per-slot step sizes from summed squared gradients, an L1 threshold that
    keeps rare slots at zero. Slot ``buckets`` is the bias (no L1). Classes weigh the same."""
    z, n = np.zeros(buckets + 1), np.zeros(buckets + 1)
    l1 = np.full(buckets + 1, L1)
    l1[buckets] = 0.0

    def weights(at):
        s = z[at]
        return np.where(np.abs(s) <= l1[at], 0.0, -(s - np.sign(s) * l1[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    positives = sum(y for *_, y in data)
    weight = (len(data) / max(1, 2 * (len(data) - positives)), len(data) / max(1, 2 * positives))
    for _ in range(epochs):
        for slots, x, y in data:
            at = np.append(slots, buckets)
            v = np.append(x, 1.0)
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ v, -30, 30)))
            g = weight[y] * (p - y) * v
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(buckets + 1))


def predict(docs: DataFrame, weights: np.ndarray, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` plus score and predicted for the whole ``text`` column."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    read = text if text in keep else "__text"           # a kept text goes to the tasks once
    source = docs.select(*[F.col(c) for c in keep], *([] if text in keep else [F.col(text).alias(read)]))
    schema = source.select(*keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def run(batches):
        w = shared.value
        features = Features(len(w) - 1)
        for s in slices(batches, read):
            uni, ub, bi, bb = features.of(as_bytes(s.column(read)))
            total = sums_between(w[uni], ub) + sums_between(w[bi], bb)
            size = np.diff(ub) + np.diff(bb)
            score = 1.0 / (1.0 + np.exp(-np.clip(SCALE * total / np.maximum(size, 1) + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*[s.column(c) for c in keep], pa.array(score, pa.float64()),
                 pa.array((score >= 0.5).astype(np.int32), pa.int32())], [*keep, "score", "predicted"])

    return source.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, **training) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    held = F.coalesce(fold("doc_id", folds) == held_out, F.lit(False))
    weights = train(docs, labels, folds, held_out, **training)
    return predict(docs.select("doc_id", "text"), weights, ["doc_id"]).select(
        "doc_id", held.alias("held_out"), "score", "predicted")
