"""Both scores from one pass: equal to the two searches by themselves, with colliding buckets and odd queries."""

import random

import pytest

from rankloom.operators import dense, lexical
from rankloom.operators.fusion import hybrid_top_k, hybrid_top_k_of_pairs


@pytest.fixture(scope="module", params=[5, dense.HASH_DIM])
def case(spark, request):
    rng = random.Random(request.param)
    words = [f"w{i}" for i in range(30)]
    corpus = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(40)] + [(40, ""), (41, None)]
    queries = [(1, "w1 w2 w2 w3"), (2, "unknown w4"), (3, "unknown words"), (4, ""), (5, None), (6, " ".join(words))]
    index = lexical.LexicalIndex.build(spark.createDataFrame(corpus, "key long, text string"), dim=request.param)
    q = spark.createDataFrame(queries, "query_id long, query_text string")
    vectors = dense.hash_vectors(q, "query_id", "query_text", request.param, key_alias="query_id")
    pairs = lexical.pair_scores(q, index, request.param)
    return pairs, lexical.hashed_scores(q, vectors, index), lexical.bm25_scores(q, index)


def rounded(rows, name):
    return {(r["query_id"], r["key"]): round(r[name], 9) for r in rows if r[name] is not None}


def test_pairs_hold_both_scores(case):
    pairs, near, text = case
    got = pairs.collect()
    assert rounded(got, "dense") == rounded(near.collect(), "score")
    assert rounded(got, "bm25") == rounded(text.collect(), "score")
    assert len(got) == len({(r["query_id"], r["key"]) for r in got})


@pytest.mark.parametrize("top_k,alpha", [(3, 0.6), (30, 0.5), (2, 1.0), (4, 0.0)])
def test_fused_cut_equals_that_of_two_lists(case, top_k, alpha):
    pairs, near, text = case

    def rows(df):
        return [(r["query_id"], r["rank"], r["key"], round(r["score"], 9)) for r in df.orderBy("query_id", "rank").collect()]

    assert rows(hybrid_top_k_of_pairs(pairs, top_k, alpha)) == rows(hybrid_top_k(near, text, top_k, alpha))
