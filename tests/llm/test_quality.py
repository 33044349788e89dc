import numpy as np
import pytest

from rankloom.llm import quality


@pytest.fixture(scope="module")
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_features_hold_unigrams_and_bigrams_of_each_document_only():
    f = quality.Features(1 << 18)
    uni, ub, bi, bb = f.of([b"a b", b"", b"c", b"a b c"])
    assert np.diff(ub).tolist() == [2, 0, 1, 3] and np.diff(bb).tolist() == [1, 0, 0, 2]
    assert bi[0] == bi[1]                                 # "a b" in both
    assert uni[0] == uni[3] and uni[2] == uni[5]


def test_a_repeat_is_one_feature_for_all_tokens():
    f = quality.Features(1 << 18)
    *_, bi, _ = f.of([b"x x", b"yy yy"])
    assert bi[0] == bi[1] == f.repeat


def test_slices_do_not_change_the_features():
    texts = [f"w{i % 7} ## w{i % 3}, x{i}".encode() for i in range(50)]
    whole = quality.Features(1 << 18).of(texts)
    f = quality.Features(1 << 18)
    f.cache.limit = 3                                     # starts afresh each time
    parts = [f.of(texts[i:i + 5]) for i in range(0, 50, 5)]
    assert np.concatenate([p[0] for p in parts]).tolist() == whole[0].tolist()
    assert np.concatenate([p[2] for p in parts]).tolist() == whole[2].tolist()


def test_ftrl_separates_and_leaves_rare_slots_at_zero():
    data = [(np.array([0, 2]), np.array([5.0, 5.0]), 1), (np.array([1, 2]), np.array([5.0, 5.0]), 0)] * 20
    data.append((np.array([3]), np.array([0.001]), 1))
    w = quality.ftrl(data, 4)
    assert w[0] > 0.1 and w[1] < -0.1 and w[3] == 0


def test_defined_cases(docs_of, labels):
    rows = [(i, ("good words here " if i % 2 else "bad### junk### ") * 20, "en", "s") for i in range(40)]
    rows += [(100, None, None, None), (101, "", None, None), (None, "good words here", None, None),
             (102, "good words here " * 20000, None, None), (1, rows[1][1], "en", "s")]
    marks = [(i, i % 2, 0) for i in range(40)] + [(3, 1, 0), (7, None, None), (None, 1, 0)]
    got = quality.classify(docs_of(rows), labels(marks)).collect()
    assert len(got) == len(rows)
    assert all(r.predicted == (r.doc_id % 2) for r in got if r.doc_id is not None and r.doc_id < 40)
    empty = [r for r in got if r.doc_id in (100, 101)]
    assert empty[0].score == empty[1].score and 0 <= empty[0].score <= 1
    assert all(r.predicted == int(r.score >= 0.5) for r in got)


def test_without_labels_or_rows(docs_of, labels):
    assert [r.score for r in quality.classify(docs_of([(1, "a", None, None)]), labels([])).collect()] == [0.5]
    assert quality.classify(docs_of([]), labels([(1, 1, 0)])).collect() == []


def test_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classify(docs, marks).join(marks, "doc_id").filter("held_out").toPandas()
    assert (got.quality == got.predicted).mean() > 0.97
    assert got[got.quality == 1].predicted.mean() > 0.98


def plain_features(text, buckets):
    """Hashed unigrams and bigrams of one text with their values, in plain Python."""
    import re

    import xxhash
    hashes = [xxhash.xxh64_intdigest(t) for w in (text or "").encode().split() for t in re.findall(r"\w+|[^\w\s]+", w.decode())]
    slots = [h & (buckets - 1) for h in hashes]
    for a, b in zip(hashes, hashes[1:]):
        mixed = (a * 0x9E3779B97F4A7C15 + (b ^ (b >> 29))) % 2 ** 64
        slots.append((xxhash.xxh64_intdigest("\0repeat") if a == b else mixed ^ (mixed >> 32)) & (buckets - 1))
    return {s: quality.SCALE * slots.count(s) / len(slots) for s in set(slots)}


def plain_scores(rows, marks, buckets):
    """Training in hash order and scores of all rows, one slot at a time."""
    import math
    import zlib

    import xxhash
    labels = {}
    for doc_id, q, _ in marks:
        if doc_id is not None and q is not None:
            labels[doc_id] = min(q, labels.get(doc_id, q))
    train = [(i, plain_features(t, buckets), labels[i]) for i, t, *_ in rows if i in labels and zlib.crc32(str(i).encode()) % 3 != 1]
    train.sort(key=lambda x: xxhash.xxh64_intdigest(str(x[0])))
    z, n = [0.0] * (buckets + 1), [0.0] * (buckets + 1)

    def weight(s):
        l1 = quality.L1 if s < buckets else 0.0
        if abs(z[s]) <= l1:
            return 0.0
        return -(z[s] - math.copysign(l1, z[s])) / ((quality.BETA + math.sqrt(n[s])) / quality.ALPHA + quality.L2)

    positive = sum(y for *_, y in train)
    cost = {0: len(train) / (2 * (len(train) - positive)), 1: len(train) / (2 * positive)}
    for _ in range(quality.EPOCHS):
        for _, x, y in train:
            x = x | {buckets: 1.0}
            w = {s: weight(s) for s in x}
            p = 1 / (1 + math.exp(-sum(w[s] * v for s, v in x.items())))
            for s, v in x.items():
                g = cost[y] * (p - y) * v
                sigma = (math.sqrt(n[s] + g * g) - math.sqrt(n[s])) / quality.ALPHA
                z[s] += g - sigma * w[s]
                n[s] += g * g
    return {i: 1 / (1 + math.exp(-sum(weight(s) * v for s, v in plain_features(t, buckets).items()) - weight(buckets))) for i, t, *_ in rows}


def test_scores_equal_a_plain_computation(docs_of, labels):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)] + ["good,", "bad###", "x-y", "é"]
    rows = [(i, " ".join(rng.choice(words[i % 2 * 12:i % 2 * 12 + 22], int(rng.integers(1, 25)))), "en", "s") for i in range(60)]
    rows += [(200, None, None, None), (201, " ", None, None), (202, "w1 w1 w1", None, None)]
    marks = [(i, i % 2, 0) for i in range(50)] + [(4, 1, 0), (9, None, None)]
    want = plain_scores(rows, marks, 64)
    got = {r.doc_id: r.score for r in quality.classify(docs_of(rows), labels(marks), buckets=64).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-4 for i in want)


def test_a_repeated_id_is_one_training_row(docs_of, labels):
    rows = [(i, ("good words here " if i % 2 else "bad### junk### ") * 20, "en", "s") for i in range(40)]
    marks = labels([(i, i % 2, 0) for i in range(40)])
    once = quality.train(docs_of(rows), marks)
    assert np.array_equal(once, quality.train(docs_of(rows + [rows[3]] * 200), marks))
