"""Pruned search over sharded postings equals scoring every document."""

import random

import pytest

from rankloom.operators import lexical, postings
from rankloom.plans import registry
from rankloom.sources import tables as T

from conftest import SF001


def rows(df):
    return sorted((r.query_id, r["rank"], r.key, round(r.score, 6)) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(12)] + [(2000, None), (2001, ""), (2002, "common " * 3000)]
    docs += [(3000 + i, f"common {docs[i][1]}") for i in range(300)]
    queries = [(q, " ".join(rng.choice(words) for _ in range(n))) for q, n in enumerate((1, 2, 5, 20, 60, 0))]
    queries += [(90, "common"), (91, "common common w1 w2 w3"), (92, "nothing known here"), (93, None)]
    return spark.createDataFrame(docs, "key long, text string"), spark.createDataFrame(queries, "query_id long, query_text string")


@pytest.mark.parametrize("shard_docs,least,k", [(1 << 14, 1 << 10, 10), (64, 1, 10), (100, 1, 1), (100, 1, 1000)])
def test_equal_to_scoring_every_document(spark, corpus, shard_docs, least, k):
    docs, queries = corpus
    index = postings.PostingsIndex.build(docs, shard_docs=shard_docs, least_docs=least)
    want = rows(lexical.bm25_top_k(queries, lexical.LexicalIndex.build(docs), k))
    assert rows(postings.top_k(queries, index, k)) == want and want


def test_fewer_postings_are_scored_than_held(spark):
    docs = T.document_corpus(spark, SF001)
    index = postings.PostingsIndex.build(docs, shard_docs=1 << 20)
    got = postings.share_scored(T.benchmark_queries(spark, SF001), index, 3).agg({"scored": "sum", "held": "sum"}).first()
    assert 0 < got["sum(scored)"] < 0.8 * got["sum(held)"]


def test_nothing_is_shuffled_but_the_best_rows(spark):
    plan = registry.QUERIES["pruned_topk"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    groups = plan[plan.index("FlatMapGroupsInPandas"):]
    assert "Exchange hashpartitioning(shard" not in groups and "Bucketed: true" in groups


def test_no_documents_or_queries(spark):
    none = spark.createDataFrame([], "key long, text string")
    index = postings.PostingsIndex.build(none)
    asked = spark.createDataFrame([(1, "a b")], "query_id long, query_text string")
    assert postings.top_k(asked, index, 3).collect() == []
    some = postings.PostingsIndex.build(spark.createDataFrame([("x", "a b"), ("y", "b"), *((c, c) for c in "cdefg")], "key string, text string"))
    assert [r.key for r in postings.top_k(asked, some, 3).orderBy("rank").collect()] == ["x", "y"]
    assert postings.top_k(asked.limit(0), some, 3).collect() == []


def test_long_documents_make_smaller_shards(spark, monkeypatch):
    monkeypatch.setattr(postings, "SHARD_TERMS", 100)
    docs = spark.range(30).selectExpr("id AS key", "concat_ws(' ', transform(sequence(1, 20), i -> concat('w', i * (id + 1)))) AS text")
    index = postings.PostingsIndex.build(docs, least_docs=1 << 20)
    assert index.shards == 6
    queries = spark.createDataFrame([(1, "w1 w20 w40")], "query_id long, query_text string")
    want = lexical.bm25_top_k(queries, lexical.LexicalIndex.build(docs), 5)
    show = lambda df: [(r.key, r.rank, round(r.score, 9)) for r in df.orderBy("rank").collect()]
    assert show(postings.top_k(queries, index, 5)) == show(want)


def test_a_shards_rows_are_made_without_a_row_of_python_objects(spark):
    """Arrow in, Arrow out: lists, ranges and keys of a shard as its documents have them."""
    import pyarrow as pa

    docs = [(7, 3, ["a", "b"], [2, 1]), (5, 1, ["b"], [1]), (6, 0, [], [])]
    v = pa.table({"shard": pa.array([4] * 3, pa.int32()), "key": [d[0] for d in docs], "dl": pa.array([d[1] for d in docs], pa.int32()),
                  "terms": pa.array([d[2] for d in docs], pa.list_(pa.string())), "tfs": pa.array([d[3] for d in docs], pa.list_(pa.int32()))})
    rows = {r["term"]: r for r in postings.inverted(v).to_pylist()}
    assert rows[None] == {"shard": 4, "term": None, "docs": [0, 1, 2], "tfs": [0, 1, 3], "ranges": None, "range_tf": None, "keys": [6, 5, 7]}
    assert rows["b"] == {"shard": 4, "term": "b", "docs": [1, 2], "tfs": [1, 1], "ranges": [0], "range_tf": [1], "keys": None}
    assert rows["a"]["docs"] == [2] and rows["a"]["range_tf"] == [2] and len(rows) == 3
