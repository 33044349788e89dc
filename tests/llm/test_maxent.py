import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import maxent as M


def tokens(text):
    out, word = [], b""
    for b in (text or "").encode():
        if b == 0x20 or 0x09 <= b <= 0x0D:
            out, word = out + [word] if word else out, b""
        else:
            word += bytes([b + 32 if 65 <= b <= 90 else b])
    return (out + [word] if word else out) + ["end"]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def base(rows):
    counts = collections.Counter()
    for doc_id, text, *_ in rows:
        if doc_id is not None and not held(doc_id):
            counts.update(tokens(text))
    n, v = sum(counts.values()), len(counts)
    return [(i, held(i), len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n,
             sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens(t))) for i, t, *_ in rows]


def check_base(got, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    want = sorted(base(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9)


ROWS = [(i, t, "en", "s") for i, t in enumerate([None, "", "The cat sat", "the cat\tsat on the mat", "THE dog sat", "é É the\x0bcat",
        "x" * 500 + " the " + "x" * 500, "the cat sat " * 3000, "a\x1cb c", "cat cat", "the", "mat on mat", "\x00 dog"] * 3)]
ROWS += [(None, "the unseen cat", None, None), (5, "the cat", None, None), (5, "the cat", None, None)]


@pytest.fixture
def narrow(monkeypatch):
    """A head and units that some words are outside of; sizes are read in the driver and tasks."""
    monkeypatch.setattr(M, "HEAD", 6)


def test_base_scores_and_counts_equal_a_plain_computation(docs_of):
    check_base(M.score(docs_of(ROWS)).collect(), ROWS)


def test_words_outside_the_head_come_by_the_join(docs_of, narrow):
    got = M.score(docs_of(ROWS)).collect()
    check_base(got, ROWS)
    assert all(r.score < 0 for r in got)


def test_nothing_to_learn_from(docs_of):
    got = M.score(docs_of([(None, "a b", None, None), (None, None, None, None)])).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [
        (None, False, 1, 0, 0, 0.0, 0.0), (None, False, 3, 0, 0, 0.0, 0.0)]
    assert M.score(docs_of([])).collect() == []


def small_model():
    counts = collections.Counter({b"w%d" % i: 3000 - i for i in range(2500)}) | {M.END: 700}
    rows = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame([(bytearray(w), n) for w, n in small_model()], "word binary, n long")
    words, outside = M.vocabulary(df)
    m = M.Model.start(words)
    rng = np.random.default_rng(5)
    m.class_weights[:] = rng.normal(size=m.class_weights.shape)
    m.place_weights[:] = rng.normal(size=m.place_weights.shape)
    return words, outside, m


def test_vocabulary_splits_all_tokens(model):
    words, outside, _ = model
    assert words.tokens == sum(n for _, n in small_model()) and words.words == 2501
    assert outside.count() == 0 and len(words.frequency) == M.SINGLES + (M.CLASSES - M.SINGLES) * M.WIDTH
    units = collections.Counter(words.unit.tolist())
    tails = set(words.tail_unit.tolist())
    assert all(n == 1 for u, n in units.items() if u not in tails)
    for k, u in enumerate(words.tail_unit):
        mine = [n for w, n in small_model() if words.unit[words.head[w]] == u]
        assert words.tail_share[u] == pytest.approx(math.log10(sum(mine) + len(mine) + 1))
        assert all(M.tail_of(w) == k for w, _ in small_model() if words.unit[words.head[w]] == u)


def test_probabilities_after_any_words_add_up_to_one(model):
    words, _, m = model
    n = len(words.frequency)
    for before in ([], [3], [3, 900], [2000, 40], [7, 7]):
        flat = np.array([x for u in range(n) for x in [*before, u]])
        bounds = np.arange(0, len(flat) + 1, len(before) + 1)
        last = m.log10(flat, bounds)[len(before)::len(before) + 1]
        assert (10 ** last).sum() == pytest.approx(1, abs=1e-4)


def plain(m, units):
    """The log probability of one text's units, in plain Python."""
    total, none = 0.0, len(m.class_of)
    mixed = lambda *parts: int(M.mixed(*[np.uint64(p) for p in parts]))
    for i, u in enumerate(units):
        one, two = (units[i - d] if i >= d else none for d in (1, 2))
        kind, place = int(m.class_of[u]), int(m.place_of[u])
        z = m.class_bias.astype(float).copy()
        for h in (mixed(1, one), mixed(2, one, two), mixed(3, two)):
            z += m.class_weights[h % M.ROWS]
        total += (z[kind] - np.log(np.exp(z).sum())) / np.log(10)
        if place >= 0:
            z = m.place_bias[kind].astype(float).copy()
            for h in (mixed(1, one, kind), mixed(3, two, kind)):
                z += m.place_weights[h % M.PLACES]
            total += (z[place] - np.log(np.exp(z).sum())) / np.log(10)
    return total


def test_scores_equal_a_plain_computation(model):
    m = model[2]
    texts = [[5], [40, 41, 2000, 3, 3, 3, 700], [1, 2, 3, 900, 901, 902] * 9]
    flat, bounds = np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = M.sums_between(m.log10(flat, bounds), bounds)
    assert got.tolist() == pytest.approx([plain(m, t) for t in texts], rel=1e-5)


def test_blocks_change_nothing(model, monkeypatch):
    m = model[2]
    flat = np.random.default_rng(1).integers(0, 2080, 5000)
    bounds = np.array([0, 1, 1800, 1801, 5000])
    whole = m.log10(flat, bounds)
    monkeypatch.setattr(M, "BLOCK", 7)
    assert np.allclose(m.log10(flat, bounds), whole, atol=1e-5)


def test_the_gradient_is_that_of_the_log_probability(model):
    m = model[2]
    flat, bounds = np.array([4, 900, 4, 901, 33]), np.array([0, 5])
    sums = M.Gradient()
    m.add_gradient(flat, bounds, sums)
    for part, weights in ((sums.classes, m.class_weights), (sums.places, m.place_weights)):
        row, col = np.unravel_index(np.abs(part.g).argmax(), part.g.shape)
        kept, step = weights[row, col], 0.01
        weights[row, col] = kept + step
        up = m.log10(flat, bounds).sum()
        weights[row, col] = kept - step
        down = m.log10(flat, bounds).sum()
        weights[row, col] = kept
        assert part.g[row, col] == pytest.approx((up - down) / (2 * step) * math.log(10), rel=0.02)


def test_equal_contexts_are_one(model, monkeypatch):
    m, made = model[2], []
    softmax = M.softmax
    monkeypatch.setattr(M, "softmax", lambda rows, *x: made.append(len(rows[0])) or softmax(rows, *x))
    flat = np.tile([7, 900, 1500, 40], 500)
    bounds = np.arange(0, len(flat) + 1, 4)
    log = m.log10(flat, bounds)
    assert sum(made) == 4 + 3 and np.allclose(log, np.tile(log[:4], 500), atol=1e-6)       # 7 is a class of its own
    one, all_of = M.Gradient(), M.Gradient()
    m.add_gradient(flat[:4], bounds[:2], one)
    m.add_gradient(flat, bounds, all_of)
    assert sum(made) == 3 * 7
    for a, b in ((one.classes, all_of.classes), (one.places, all_of.places)):
        assert (a.n * 500 == b.n).all() and np.allclose(a.g * 500, b.g, atol=1e-2)


def test_windows_change_nothing(model, monkeypatch):
    m = model[2]
    flat = np.random.default_rng(2).integers(0, 2080, 3000)
    bounds = np.array([0, 1, 1, 1800, 3000])
    whole, sums = m.log10(flat, bounds), M.Gradient()
    m.add_gradient(flat, bounds, sums)
    monkeypatch.setattr(M, "WINDOW", 7)
    some = M.Gradient()
    m.add_gradient(flat[:60], np.array([0, 1, 60]), some)
    assert np.allclose(m.log10(flat, bounds), whole, atol=1e-5) and some.classes.n.sum() == 3 * 60
    assert np.abs(sums.classes.g.sum(axis=1)).max() < 1e-2


def test_training_beats_the_base_on_held_out_rows(table):
    got = M.score(table("documents")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.97 * got[1]
