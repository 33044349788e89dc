import random
import re

import xxhash

from rankloom.llm import simhash
from rankloom.llm.components import smallest_reachable
from rankloom.llm.shared import Scratch


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    """(doc_id, fingerprint) rows -> smallest doc_id reachable, by all pairs."""
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(pairs):
        if doc is not None:
            r = find(i)
            least[r] = min(least.get(r, doc), doc)
    return [least.get(find(i)) for i in range(len(pairs))]


def check(got, rows):
    prints = [(d, brute_fingerprint(t)) for d, t, *_ in rows]
    want = sorted(((d, f"{fp:016x}", c) for (d, fp), c in zip(prints, brute_components(prints), strict=True)), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == want


def test_fingerprint_of_many_shapes():
    for t in ["", " \t\n", "one", "Two words", "ÀÉ Straße x\x0by\x1fz", "a b c " * 50000, "x y z 　 w"]:
        assert simhash.fingerprint(t.encode()) == brute_fingerprint(t)


def test_defined_cases(docs_of):
    long = "some words in a very long text " * 20000
    rows = [(5, None, "en", "s"), (4, "", None, None), (9, "...", None, None), (2, "a b", None, None), (3, "A  b", None, None),
            (7, long, None, None), (8, long, None, None), (None, "a b", None, None), (3, "A  b", None, None)]
    check(simhash.near_duplicates(docs_of(rows)).collect(), rows)
    assert simhash.near_duplicates(docs_of([])).collect() == []


def test_matches_brute_force_on_given_rows(table):
    rows = [(r.doc_id, r.text) for r in table("documents").select("doc_id", "text").collect()]
    check(simhash.near_duplicates(table("documents")).collect(), rows)


def test_links_join_fingerprints_as_all_pairs_do(spark):
    rng = random.Random(4)
    near = [rng.getrandbits(64) for _ in range(40)]
    near += [n ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for n in near for _ in range(4)]
    near += [n ^ (1 << rng.randrange(64)) for n in near[:100]] + [0, 1, 3, 7, (1 << 64) - 1, 1 << 63]
    signed = sorted({n - (1 << 64) if n >> 63 else n for n in near})
    fps = spark.createDataFrame([(n,) for n in signed], "fp long")
    roots = {r.node: r.root for r in smallest_reachable(simhash.links(fps, 2), Scratch(spark, "test")).collect()}
    want = brute_components([(n, n & (1 << 64) - 1) for n in signed])
    assert [roots.get(n, n) for n in signed] == want


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 400)] + [(5000, 5000), (None, 3), (1000, 1001)]
    edges = spark.createDataFrame(path + star, "a long, b long")
    got = {r.node: r.root for r in smallest_reachable(edges, Scratch(spark, "test")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(400))
    assert 5000 not in got


def test_keep_one_row_of_each_component(docs_of):
    rows = [(1, "a b c", "en", "s"), (2, "a b c", "en", "s"), (1, "a b c", "en", "s"), (3, "q w e r t y", None, None),
            (None, "a b c", None, None)]
    docs = docs_of(rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_repeated_and_null_ids_lose_no_text_of_their_own(docs_of):
    first, other = "a b c d e f", "totally other words than those of the first text"
    rows = [(1, first, "en", "s"), (1, other, "en", "s"), (None, first, "en", "s"), (None, first, None, None),
            (None, "a third text with words of its very own here", "en", "s"), (None, None, None, None), (None, "", None, None)]
    kept = sorted((str(r.doc_id), r.text or "") for r in simhash.keep_one(docs_of(rows)).collect())
    assert kept == sorted([("1", first), ("1", other), ("None", rows[4][1]), ("None", "")])
