import random

import pytest

from rankloom.llm import urls

RULES = [("com", "/", False), ("example.com", "/en/", True), ("www.example.com", "/en/", False), ("net", "/es/", True),
         ("net", "/fr/", True)]
SCHEMA = "host string, path string, block boolean"


def brute(url, rules):
    host, path = urls.split_url(url)
    fits = [(len(h + p), len(h), h + p, b) for h, p, b in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fits)[2], max(f[3] for f in fits if f[2] == max(fits)[2])) if fits else (None, False)


@pytest.mark.parametrize("url,want", [
    ("HTTP://WWW.Example.COM:80/A/b?q#f", ("www.example.com:80", "/A/b")), ("x://h", ("h", "")), ("//h/p", ("", "")),
    (None, ("", "")), ("a://b?c/d", ("b", "")), ("a://b#c?d/e", ("b", "")), ("a:///p", ("", "/p")), ("a://É.com/", ("É.com", "/")),
    ("a://b/c://d/e?f", ("b", "/c://d/e"))])
def test_host_and_path(url, want):
    assert urls.split_url(url) == want


def test_the_longest_fitting_rule_of_random_lists():
    rng = random.Random(8)
    parts = ["a", "b", "com", "net"]
    for _ in range(50):
        rules = [(".".join(rng.choice(parts) for _ in range(rng.randint(1, 3))), rng.choice(["", "/", "/x", "/x/", "/é"]),
                  rng.random() < 0.5) for _ in range(15)]
        found = [f"s://{'.'.join(rng.choice(parts) for _ in range(rng.randint(1, 4)))}{rng.choice(['', '/', '/x', '/xy', '/x/é', '/éa'])}"
                 for _ in range(40)]
        split = [urls.split_url(u) for u in found]
        listed = urls.DigestList(urls.DigestList.build(rules))
        got = listed.judge([h for h, _ in split], [p for _, p in split])
        for u, g in zip(found, got, strict=True):
            assert (g or (None, False)) == brute(u, rules)


def test_a_digest_collision_is_no_hit(monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda key: 7)
    listed = urls.DigestList(urls.DigestList.build([("a", "/", True), ("b", "/", False)]))
    assert listed.judge(["a", "b", "c"], ["/", "/", "/"]) == [("a/", True), ("b/", False), None]


def test_defined_cases(spark):
    rules = spark.createDataFrame([*RULES, ("net", "/es/", False), (None, "/", True), ("org", None, None), ("org", "x", False)], SCHEMA)
    rows = [(1, None), (2, "nothing"), (3, "http://a.org"), (None, "http://x.net/es/1"), (4, "http://x.net/es"),
            (5, "http://www.example.com/en/" + "p" * 100_000), (5, "http://example.com/en/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'own' as host", "1 as rule", "2 as verdict")
    got = [(r.page_id, r.rule, r.verdict) for r in urls.judge(pages, rules).collect()]
    assert got == [(1, None, "allow"), (2, None, "allow"), (3, "org", "block"), (None, "net/es/", "block"), (4, None, "allow"),
                   (5, "www.example.com/en/", "allow"), (5, "example.com/en/", "block")]
    assert urls.judge(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in urls.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_a_list_over_the_bound_is_refused(spark):
    with pytest.raises(ValueError, match="max_bytes"):
        urls.checked_list(spark.createDataFrame(RULES, SCHEMA), max_bytes=10)


def test_hosts_of_very_many_labels_take_little_memory():
    import tracemalloc
    listed = urls.DigestList(urls.DigestList.build([("com", "/", False), ("b.com", "/", True), ("x.y.z.com", "", True)]))
    host = "a." * 50_000 + "b.com"
    tracemalloc.start()
    got = listed.judge([host, "com", "y.z.com", "w.x.y.z.com", ""], ["/p", "/", "/", "", "/"])
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()
    assert got == [("b.com/", True), ("com/", False), ("com/", False), ("x.y.z.com", True), None]
