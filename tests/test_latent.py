"""The distributed factorisation against a small exact SVD."""

import numpy as np
import pytest

from rankloom.operators import dense, latent
from rankloom.operators.dense import hash_bucket
from rankloom.operators.lexical import count_terms

DIM = 256


def corpus(spark, n=60, topics=3, per=8, seed=2):
    rng = np.random.default_rng(seed)
    words = [[f"t{t}w{i}" for i in range(per)] for t in range(topics)]
    rows = [(i, " ".join(rng.choice(words[i % topics], 20))) for i in range(n)]
    return spark.createDataFrame(rows + [(n, None), (n + 1, "")], "key long, text string").repartition(5), rows


def matrix(df):
    """The weighted table, row by row, in numpy."""
    got = count_terms(df, "key", "text", DIM).select("key", "buckets", "tfs").orderBy("key").collect()
    docs = len(got)
    a, df_ = np.zeros((docs, DIM)), np.zeros(DIM)
    for i, r in enumerate(got):
        for b, n in zip(r.buckets, r.tfs, strict=True):
            a[i, b] += 1 + np.log(n)
        df_[list(set(r.buckets))] += 1
    a *= np.where(df_ > 0, np.log((1 + docs) / (1 + df_)) + 1, 0)
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-30)


def test_directions_and_values_equal_an_exact_svd(spark):
    df, _ = corpus(spark)
    found = latent.factorise(df, rank=6, dim=DIM, power=4)
    _, s, vt = np.linalg.svd(matrix(df), full_matrices=False)
    assert np.allclose(found.singular, s[:6], rtol=1e-3)
    # the first directions are the topics': same subspace, up to signs
    assert np.allclose(found.table[:, :3] @ found.table[:, :3].T, vt[:3].T @ vt[:3], atol=1e-3)
    assert np.allclose(found.table.T @ found.table, np.eye(6), atol=1e-6)


def test_low_rank_is_found_exactly(spark):
    df, _ = corpus(spark, n=30, topics=2, per=3)
    a = matrix(df)
    s = np.linalg.svd(a, compute_uv=False)
    found = latent.factorise(df, rank=6, dim=DIM, power=1)
    assert np.allclose(found.singular, s[:6], atol=1e-8)
    assert np.allclose(a @ found.table @ found.table.T, a, atol=1e-8)


def test_texts_of_a_topic_without_common_words_are_near(spark):
    words = [("a b", "b c", "c d", "d a"), ("p q", "q r", "r s", "s p")]
    rows = [(i, words[i % 2][i // 2 % 4]) for i in range(80)]
    df = spark.createDataFrame(rows, "key long, text string")
    space = latent.factorise(df, rank=2, dim=DIM, power=3)
    texts = spark.createDataFrame([(1, "a"), (2, "c"), (3, "q"), (4, None), (5, "unknown words")], "key long, text string")
    got = {r.key: np.array(r.embedding) for r in space.encode(texts, "text").collect()}
    assert got[1] @ got[2] > 0.9 and abs(got[1] @ got[3]) < 0.1
    assert not got[4].any()


def test_encode_keeps_columns_whatever_their_names(spark):
    df, rows = corpus(spark, n=12)
    space = latent.factorise(df, rank=2, dim=DIM)
    odd = df.selectExpr("key", "text", "'x' as row", "1 as buckets", "2 as tfs", "3 as key2")
    got = space.encode(odd, "text")
    assert got.columns == [*odd.columns, "embedding"] and got.count() == 14
    assert all(r.row == "x" and r.tfs == 2 for r in got.collect())
    assert {len(r.embedding) for r in got.collect()} == {2}


def test_search_over_latent_vectors(spark):
    df, rows = corpus(spark)
    space = latent.factorise(df, rank=3, dim=DIM, power=3)
    vectors = space.encode(df, "text")
    top = dense.exact_top_k(vectors.limit(60), vectors, 5, qid="key", exclude_same_key=True).collect()
    same = [r.query_id % 3 == r.key % 3 for r in top if r.query_id < 60]
    assert np.mean(same) > 0.99


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_nothing_to_factorise(spark, rows):
    df = spark.createDataFrame(rows, "key long, text string")
    space = latent.factorise(df, rank=2, dim=DIM)
    assert all(not any(r.embedding) for r in space.encode(df, "text").collect())


def test_buckets_are_those_of_the_hashing_encoder(spark):
    df = spark.createDataFrame([(1, "alpha beta")], "key long, text string")
    got = count_terms(df, "key", "text", DIM).first()
    assert sorted(got.buckets) == sorted(r[0] for r in spark.createDataFrame([("alpha",), ("beta",)], "t string")
                                         .select(hash_bucket("t", DIM)).collect())


def test_one_pass_and_one_count_give_the_same_space(spark, monkeypatch):
    """Each turn reads the documents once, and counted documents have the vectors of their texts."""
    df, _ = corpus(spark)
    passes, one = [], latent._pass
    monkeypatch.setattr(latent, "_pass", lambda *x: passes.append(1) or one(*x))
    counted = count_terms(df, "key", "text", DIM)
    space = latent.factorise_counted(counted, rank=3, dim=DIM, power=2)
    assert len(passes) == 3
    assert np.allclose(space.table, latent.factorise(df, rank=3, dim=DIM, power=2).table, atol=1e-9)
    texts = {r.key: r.embedding for r in space.encode(df, "text").collect()}
    vectors = {r.key: r.embedding for r in space.encode_counted(counted).collect()}
    assert texts.keys() == vectors.keys() and all(np.allclose(texts[k], vectors[k], atol=1e-12) for k in texts)
