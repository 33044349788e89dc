import collections
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=3, top=200):
    counts = collections.defaultdict(collections.Counter)
    docs = collections.defaultdict(collections.Counter)
    groups = collections.defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = collections.Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def p(c, kept=kept):
            total = sum(c[x] for x in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        share = {s: p(counts[lang, s]) for s in sources}
        q = p(whole)
        price = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(sum(price(share[s][t], share[o][t]) for t in kept), o) for o in sources if o != s]
            raised = [(price(share[s][t], q[t]), t) for t in kept if counts[lang, s][t] and share[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", raised, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=5, max_size=5), min_size=2, max_size=4))
def test_walks_of_shared_trees_equal_sums_over_all_leaves(counts):
    counts = np.array(counts)
    trees = D.cons(D.filled(counts))
    totals = counts.sum(axis=1).tolist()
    for i in range(len(counts)):
        for j in range(len(counts)):
            p, q = (D.shares(counts[x], totals[x], 5) for x in (i, j))
            assert D.divergence(trees, i, j, (totals[i], 5), (totals[j], 5)) == (D.price(p, q).sum(), D.price(q, p).sum())


def test_equal_subtrees_are_one_node():
    trees = D.cons(np.array([[1, 2, 1, 2, 0, 0, 0, 0], [0, 0, 0, 0, 1, 2, 1, 2]]))
    assert [len(trees[0])] + [x.shape[1] for x in trees[1:-1]] == [3, 2, 2, 2]


def test_shares_of_large_counts_are_exact():
    big = np.array([5, 10 ** 15], np.int64)
    assert D.shares(big, 10 ** 15 + 5, 2).tolist() == [1 + 10 ** 9 * (c + 1) // (10 ** 15 + 7) for c in big.tolist()]


ROWS = [(1, "Alpha beta beta", "en", "a"), (2, "alpha BETA gamma", "en", "b"), (3, "alpha, gamma; delta9delta", "en", "c"),
        (4, "gamma gamma gamma delta", "en", "a"), (5, None, "en", "empty"), (6, "ééé été ÉTÉ été", "fr", "a"),
        (7, "été", "fr", None), (8, "été alpha", "fr", "b"), (9, "only here", "de", "a"), (10, "", "de", "b"),
        (None, "beta été", None, "a"), (None, "beta", None, None), (None, "beta", "", ""), (4, "gamma gamma gamma delta", "en", "a")]


def test_equal_to_brute_force_with_odd_rows(docs_of):
    assert result(D.audit(docs_of(ROWS))) == brute(ROWS)


def test_blocks_tiles_and_limits_change_nothing(docs_of):
    rows = [(i, " ".join(f"w{chr(97 + (i * j) % 7)}{chr(97 + j % 5)}" for j in range(1, 30)), "en", f"s{i % 9}") for i in range(40)]
    expected = brute(rows + ROWS, top=5)
    assert result(D.audit(docs_of(rows + ROWS), top=5)) == expected
    assert result(D.audit(docs_of(rows + ROWS), top=5, block=4, sources=2)) == expected


def test_long_texts_and_empty_tables(docs_of):
    rows = [(i, "long text here " * 50000 + "x" * 5000, "en", f"s{i % 2}") for i in range(3)]
    assert result(D.audit(docs_of(rows))) == brute(rows)
    assert result(D.audit(docs_of([]))) == []
    assert result(D.audit(docs_of([(1, None, None, None)]))) == []


def test_equal_to_brute_force_on_documents(table):
    rows = [tuple(r) for r in table("documents").select("doc_id", "text", "lang", "source").collect()]
    assert result(D.audit(table("documents"))) == brute(rows)
