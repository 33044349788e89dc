import collections
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import spelling as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, letters=6, least=5, ratio=5):
    counts = collections.Counter()
    for doc_id, text, *_ in rows:
        for run in RUN.findall(text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= letters and c >= least}
    out = {}
    for w in n:
        found = sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x))
        form = found[0] if found and n[found[0]] >= ratio * n[w] else None
        out[w] = [form, w, n[w], len(found), n[form] if form else None]
    for w, r in out.items():
        while out[r[1]][0]:
            r[1] = out[r[1]][0]
    return {w: tuple(r) for w, r in out.items()}


def result(df):
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


words = st.text(alphabet="abéz", min_size=3, max_size=6)


@settings(max_examples=200, deadline=None)
@given(st.lists(words, min_size=1, max_size=25, unique=True), st.integers(3, 6))
def test_products_find_exactly_the_words_one_edit_apart(found, length):
    same = sorted(w for w in found if len(w) == length)
    longer = sorted(w for w in found if len(w) == length + 1)
    for a, b, one in ((same, same, True), (same, longer, False)):
        if a and b:
            i, j = S.near_in(a, b, one)
            got = sorted((a[x], b[y]) for x, y in zip(i, j, strict=True))
            assert got == sorted((x, y) for x in a for y in b if near(x, y) and (x < y or not one))


def test_every_edit_leads_to_a_block_that_is_met():
    steps = {*S.STEPS, *((-a, -b, -c) for a, b, c in S.STEPS)}
    kinds = [(1, 0), (0, 1), (0, 0)]
    for p, q in kinds:
        assert (1, p, q) in steps and (-1, -p, -q) in steps
        assert all((0, x - p, y - q) in steps for x, y in kinds)


@pytest.mark.parametrize("tile", [1024, 3])
def test_equal_to_brute_force_on_a_vocabulary_of_variants(docs_of, tile):
    base = ["anderson", "andersen", "andersons", "straßen", "éclairs", "eclairs", "clairs", "banana", "bananas", "bananan"]
    rows = [(i, f"{w} {w.upper()}, {w.title()}-{w}\t" * (1 + 7 * (i % 5) ** 2), "en", "s") for i, w in enumerate(base * 3)]
    rows += [(None, "banana " * 40, None, None), (50, None, "en", "s"), (51, "", None, None), (52, "12 _ ×÷ x漢字yabcdef " * 6, None, None)]
    rows += [rows[0]] * 3
    got = result(S.variants(docs_of(rows), tile=tile))
    assert got == brute(rows)
    assert any(r[0] for r in got.values())


def test_a_chain_of_forms_leads_to_its_last_word(docs_of):
    # four words, each one edit from the next and at least five times rarer
    chain = [("aaaaaa", 5), ("aaaaab", 40), ("aaaabb", 300), ("aaabbb", 2000), ("aabbbb", 12000)]
    rows = [(i, f"{w} " * n, None, None) for i, (w, n) in enumerate(chain)]
    got = result(S.variants(docs_of(rows)))
    assert got == brute(rows)
    assert {got[w][1] for w, _ in chain} == {"aabbbb"}


def test_ties_go_to_the_first_word(docs_of):
    rows = [(1, "kitten " * 5, None, None), (2, "mitten " * 30, None, None), (3, "bitten " * 30, None, None)]
    got = result(S.variants(docs_of(rows)))
    assert got == brute(rows) and got["kitten"][0] == "bitten" and got["kitten"][3] == 2


def test_long_texts_and_empty_tables(docs_of):
    rows = [(1, "wordlike " * 60000, None, None), (2, "q" * 5000 + " " + "wordlikes " * 9, None, None)]
    got = result(S.variants(docs_of(rows)))
    assert got == brute(rows)
    assert S.variants(docs_of([])).collect() == []
    assert S.variants(docs_of([(1, None, None, None)])).collect() == []


def test_equal_to_brute_force_on_documents(table):
    docs = table("documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = result(S.variants(docs, min_count=2, ratio=2))
    assert got == brute(rows, least=2, ratio=2)
    assert sum(r[3] for r in got.values()) > 100
