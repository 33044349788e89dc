"""Best documents block by block: equal to scoring every pair, with repeated and null keys and ids."""

import random

import pytest

from rankloom.operators import blocks, dense, lexical
from rankloom.operators.fusion import hybrid_top_k_of_lists, hybrid_top_k_of_pairs
from rankloom.operators.topk import score_order, top_k_per_group


@pytest.mark.parametrize("dim,small", [(7, True), (dense.HASH_DIM, True), (dense.HASH_DIM, False)])
def test_equal_to_scoring_every_pair(spark, monkeypatch, dim, small):
    if small:
        for name, value in (("TILE_QUERIES", 5), ("SPLIT_DOCS", 13), ("QUERIES", 3), ("DOCS", 4), ("ONE_BY_ONE", 6), ("SLICE", 2)):
            monkeypatch.setattr(blocks, name, value)
    rng = random.Random(dim)
    words = [f"w{i}" for i in range(40)]
    corpus = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(60)]
    corpus += [(60, ""), (61, None), (None, "w1 w2"), (None, "w3"), (3, "w1 w1 w5"), (70, corpus[0][1]), (71, corpus[0][1])]
    queries = [(i, " ".join(rng.choices(words, k=6))) for i in range(12)] + [
        (20, "unknown w4"), (21, "unknown words"), (22, ""), (23, None), (None, "w1 w3"), (2, "w9 w9"), (24, " ".join(words))]
    index = lexical.LexicalIndex.build(spark.createDataFrame(corpus, "key long, text string"), dim=dim)
    q = spark.createDataFrame(queries, "query_id long, query_text string")

    def rows(df):
        return sorted(str((r["query_id"], r["rank"], r["key"], round(r["score"], 9))) for r in df.collect())

    for n in (1, 4, 100):
        every = top_k_per_group(lexical.bm25_scores(q, index).filter("score > 0"), "query_id", score_order(), n)
        found = lexical.bm25_top_k(q, index, n, dim)
        assert rows(found) == rows(every)
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroups")[0]
        want = hybrid_top_k_of_pairs(lexical.pair_scores(q, index, dim), n, 0.6)
        assert rows(hybrid_top_k_of_lists(lexical.best_pairs(q, index, 2 * n, dim), n, 0.6)) == rows(want)


def test_no_document_is_copied_for_a_tile(spark, monkeypatch):
    """Tiles read the blocks that were written once; documents and their rows are dealt to no tile."""
    corpus = spark.range(300).selectExpr("id AS key", "concat_ws(' ', transform(sequence(1, 30), i -> concat('w', (i * id) % 97))) AS text")
    queries = corpus.selectExpr("key AS query_id", "text AS query_text")
    index = lexical.LexicalIndex.build(corpus)
    found = {}
    for size in (300, 10):
        monkeypatch.setattr(blocks, "TILE_QUERIES", size)
        got = lexical.best_pairs(queries, index, 5)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Scan ExistingRDD" in plan and "CoGroup" not in plan and plan.count("Exchange hashpartitioning(query_id") == 1
        found[size] = sorted((r.query_id, r.list, r.key, round(r.score, 9)) for r in top_k_per_group(
            got, ["query_id", "list"], score_order(), 5).collect())
    assert len(index.blocked) == 1 and index.blocks(dense.HASH_DIM).agg({"split": "count"}).first()[0] == 1
    assert found[300] == found[10] and {(r[0], r[1]) for r in found[10]} == {(i, k) for i in range(300) for k in (0, 1)}
