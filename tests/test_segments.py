"""Appends, replacements and merges give the scores of one index of the live documents."""

import random

import pytest

from rankloom.operators import postings
from rankloom.operators.segments import SegmentedIndex


def rows(df):
    return sorted((r.query_id, r["rank"], r.key, round(r.score, 6)) for r in df.collect())


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.8))}" for _ in range(900)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))
    queries = spark.createDataFrame([(q, " ".join(rng.choice(words) for _ in range(4 + q))) for q in range(6)], "query_id long, query_text string")
    return text, queries, lambda docs: spark.createDataFrame(list(docs.items()), "key long, text string")


def test_every_version_equals_a_full_rebuild(spark, tmp_path, made):
    text, queries, frame = made
    index = SegmentedIndex(spark, str(tmp_path))
    assert index.version() == 0 and index.current().top_k(queries, 5).collect() == []
    live, older = {}, []
    for turn, keys in enumerate([range(100), [5, 6, 7, 200], range(95, 125)], 1):
        added = {k: text() for k in keys}
        live |= added
        assert index.append(frame(added)) == turn == index.version()
        older.append(rows(index.current().top_k(queries, 5)))
        assert older[-1] == rows(postings.top_k(queries, postings.PostingsIndex.build(frame(live)), 5))
    # an older version is still what it was
    assert rows(index.current(2).top_k(queries, 5)) == older[1]
    assert index.merge(small=40) == 4
    assert len(index.current().segments) == 2 and rows(index.current().top_k(queries, 5)) == older[-1]


def test_a_stream_takes_up_a_new_version_at_its_next_batch(spark, tmp_path, made):
    _, _, frame = made
    index = SegmentedIndex(spark, str(tmp_path / "index"))
    others = {10 + i: f"word{i} here" for i in range(6)}
    index.append(frame({1: "apple tree", 2: "apple pie pie", **others}))
    answers = []

    def score(batch, _):
        now = SegmentedIndex(spark, str(tmp_path / "index")).current()
        answers.append((now.version, [r.key for r in now.top_k(batch, 1).collect()]))
        if now.version == 1:
            index.append(frame({2: "stone wall", 3: "pie pie pie"}))

    source = tmp_path / "requests"
    for n in range(2):
        spark.createDataFrame([(n, "pie")], "query_id long, query_text string").coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema("query_id long, query_text string").option("maxFilesPerTrigger", 1).json(str(source))
    stream.writeStream.foreachBatch(score).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert answers == [(1, [2]), (2, [3])]


def test_a_version_is_written_once(spark, tmp_path, made):
    _, _, frame = made
    index = SegmentedIndex(spark, str(tmp_path))
    index.append(frame({1: "a b"}))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        index._switch(1, [], [])
    assert index.version() == 1
