"""The crawl in rounds against the page-by-page loop, and a ranker that is called."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from rankloom.operators import crawl
from rankloom.operators.ranking import apply_rankings, call_ranker, replies_within


def loop(pages, marker, empties=3):
    """The crawl of every type, page by page."""
    types = {}
    for page_id, type_, hrefs in sorted(pages):
        types.setdefault(type_, []).append((page_id, hrefs))
    reads, first = [], {}
    for type_, listing in types.items():
        run = 0
        for n, (page_id, hrefs) in enumerate(listing, 1):
            links = {f"http://h{h}" for h in hrefs if marker in h}
            reads.append((type_, n, page_id, len(links)))
            for url in links:
                first[url] = min(first.get(url, (n, type_)), (n, type_))
            run = 0 if links else run + 1
            if run == empties:
                break
    return sorted(reads), sorted((u, t, n) for u, (n, t) in first.items())


@pytest.mark.parametrize("window", [1, 2, 8])
def test_rounds_read_what_the_loop_reads(spark, window):
    rng = random.Random(window)
    pages = [(i, rng.choice("aaab"), [f"/{rng.choice('xt')}{rng.randint(0, 30)}" for _ in range(rng.choice([0, 1, 1, 3]))]) for i in range(120)]
    pages += [(200 + i, "c", []) for i in range(40)] + [(300 + i, "d", [f"/t{i}"]) for i in range(40)]
    rows = [(i, f"http://h/{t}/p{i}", "".join(f"<a href='{h}'>x</a>" for h in hs) or None) for i, t, hs in pages]
    df = spark.createDataFrame(rows + [(999, "http://h", "<a href='/t0'>"), (998, None, None)], "page_id long, url string, html string")
    reads, found = crawl.crawl(df, "t", window=window)
    want = loop(pages, "t")
    assert sorted((r.type, r.page, r.page_id, r.n_links) for r in reads.collect()) == want[0]
    assert sorted((r.url, r.type, r.page) for r in found.collect()) == want[1]
    rounds = dict(reads.groupBy("round").agg(F.max("page")).collect())
    assert all(page <= window * (2 ** (n + 1) - 1) for n, page in rounds.items())


def test_no_pages(spark):
    reads, found = crawl.crawl(spark.createDataFrame([], "page_id long, url string, html string"), "t")
    assert reads.collect() == [] and found.collect() == []


def test_a_client_that_fails_is_late_or_partly_wrong():
    never = threading.Event()

    def client(prompt):
        if prompt == "late":
            never.wait(20)
        if prompt == "fails":
            raise RuntimeError("no")
        return 7 if prompt == "wrong" else f"[{prompt}]"

    started = time.monotonic()
    assert replies_within(client, ["1", "late", "fails", "wrong", "2"], 1.0) == ["[1]", None, None, None, "[2]"]
    assert time.monotonic() - started < 5


def counting_client(folder, failing=()):
    def factory():
        def client(prompt):
            with open(f"{folder}/asked", "a") as f:
                f.write(prompt + "\n")
            if prompt in failing:
                raise RuntimeError(prompt)
            return {"p1": "[1, 0]", "p2": "nothing to choose", "p3": "[9, 0, \"x\"]"}.get(prompt, "[0]")
        return client
    return factory


def test_replies_are_kept_and_asked_for_once(spark, tmp_path):
    prompts = spark.createDataFrame([(1, "p1"), (2, "p2"), (3, "p3"), (4, "p4"), (5, "p1"), (6, None)], "query_id long, prompt string")
    out = call_ranker(prompts, counting_client(tmp_path, ("p4",)), f"{tmp_path}/replies", wave=2)
    got = {r.query_id: r.reply for r in out.collect()}
    assert got == {1: "[1, 0]", 2: "nothing to choose", 3: '[9, 0, "x"]', 4: None, 5: "[1, 0]", 6: None}
    assert sorted((tmp_path / "asked").read_text().split()) == ["p1", "p2", "p3", "p4"]
    again = call_ranker(prompts, counting_client(tmp_path), f"{tmp_path}/replies")
    assert {r.query_id: r.reply for r in again.collect()} == got | {4: "[0]"}
    assert sorted((tmp_path / "asked").read_text().split()) == ["p1", "p2", "p3", "p4", "p4"]
    # an order changes only where a reply can be read
    cands = spark.createDataFrame([(q, 10 * q + k, k, 1.0 - k / 10) for q in range(1, 7) for k in range(3)],
                                  "query_id long, key long, pos int, score double")
    ranked = {}
    for r in apply_rankings(cands, out, 3).orderBy("query_id", "rank").collect():
        ranked.setdefault(r.query_id, []).append(r.key - 10 * r.query_id)
    assert ranked == {1: [1, 0, 2], 5: [1, 0, 2], **{q: [0, 1, 2] for q in (2, 3, 4, 6)}}


def test_many_prompts_take_a_bounded_number_of_waves(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("rankloom.operators.ranking.WAVES", 3)
    prompts = spark.range(40).selectExpr("id AS query_id", "concat('q', id % 20) AS prompt")
    out = call_ranker(prompts, counting_client(tmp_path), f"{tmp_path}/replies", at_once=3, wave=1)
    assert {r.query_id: r.reply for r in out.collect()} == {i: "[0]" for i in range(40)}
    assert sorted((tmp_path / "asked").read_text().split()) == sorted(f"q{i}" for i in range(20))
    assert len([p for p in (tmp_path / "replies").iterdir() if p.is_dir() and p.name != "none"]) <= 3


def test_a_late_prompt_holds_up_its_own_group_only():
    never = threading.Event()
    client = lambda p: never.wait(20) if p == "late" else p
    assert replies_within(client, ["1", "late", "2", "3", "4"], 0.5, at_once=2) == ["1", None, "2", "3", "4"]
