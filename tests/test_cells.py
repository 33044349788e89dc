"""Exact vector search: all products, and cells visited by their bound."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.operators import cells, dense

from conftest import SF001


def rows(df):
    return sorted((r.query_id, r["rank"], r.key, round(r.score, 4)) for r in df.collect())


def brute(data, k, queries=None, own=True):
    """Top k by inner product of every usable vector with all others of its length."""
    good = [(i, v) for i, v in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    wanted = {}
    for i, v in good if queries is None else queries:
        wanted[i] = min(wanted.get(i, v), v)
    out = []
    for i, v in wanted.items():
        found = sorted((-round(sum(a * b for a, b in zip(v, w, strict=True)), 9), j) for j, w in good
                       if len(w) == len(v) and not (own and j == i))
        out += [(i, n + 1, j, round(-s, 4)) for n, (s, j) in enumerate(found[:k])]
    return sorted(out)


ODD = [(None, [1.0, 2.0]), (100, None), (101, [None, 1.0]), (102, [float("nan"), 1.0]), (103, [float("inf"), 0.0]), (104, []),
       (105, [1.0, 2.0, 3.0]), (106, [3.0, 2.0, 1.0]), (1 << 60, [0.5, 0.25]), ((1 << 60) + 1, [0.5, 0.25])]


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(1)
    some = [(i, [float(rng.randint(-4, 4)), float(rng.randint(-4, 4))]) for i in range(60)]
    return some + some[:5] + [(7, [9.0, 9.0])] * 40 + ODD


SCHEMA = "key long, embedding array<double>"


def test_all_products_with_odd_and_repeated_rows(spark, odd):
    df = spark.createDataFrame(odd, SCHEMA)
    for block, tile in ((8192, 4096), (16, 8)):
        got = dense.exact_top_k(df, df, 3, qid="key", exclude_same_key=True, block_rows=block, tile_rows=tile)
        assert rows(got) == brute(odd, 3)


def test_keys_need_not_be_numbers(spark):
    data = [("a", [1.0, 0.0]), ("b", [0.5, 0.5]), ("c", [0.0, 1.0])]
    df = spark.createDataFrame(data, "key string, embedding array<float>")
    assert rows(dense.exact_top_k(df, df, 1, qid="key", exclude_same_key=True)) == brute(data, 1)
    assert rows(cells.top_k(df, cells.CellIndex.build(df), 1, qid="key", exclude_same_key=True)) == brute(data, 1)


@pytest.mark.parametrize("count,part", [(5, 4096), (40, 7), (1, 4096)])
def test_cells_equal_all_products_on_odd_rows(spark, odd, count, part):
    df = spark.createDataFrame(odd, SCHEMA)
    index = cells.CellIndex.build(df, cells=count, part=part)
    assert rows(cells.top_k(df, index, 3, qid="key", exclude_same_key=True)) == brute(odd, 3)


def test_cells_equal_all_products_on_embeddings(spark):
    e = spark.read.parquet(f"{SF001}/embeddings.parquet")
    index = cells.CellIndex.build(e, key="vec_id")
    got = cells.top_k(e, index, 10, qid="vec_id", exclude_same_key=True)
    assert rows(got) == rows(dense.exact_top_k(e, e, 10, qid="vec_id", key="vec_id", exclude_same_key=True))


def test_far_cells_are_not_visited(spark):
    rng = np.random.default_rng(3)
    centres = 10 * np.eye(8)
    data = [(i, (centres[i % 8] + rng.normal(0, 0.1, 8)).tolist()) for i in range(800)]
    df = spark.createDataFrame(data, SCHEMA)
    found = cells.search(df, cells.CellIndex.build(df, cells=8), 5, qid="key")
    assert cells.products(found) < 0.3 * 800 * 800
    assert rows(cells.top_k(df, cells.CellIndex.build(df, cells=8), 5, qid="key")) == brute(data, 5, own=False)


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, [1.0])], SCHEMA)
    assert cells.top_k(some, cells.CellIndex.build(none), 2, qid="key").collect() == []
    assert cells.top_k(none, cells.CellIndex.build(some), 2, qid="key").collect() == []
    assert dense.exact_top_k(some, none, 2, qid="key").collect() == []


def test_a_query_that_reaches_every_part_is_a_row_for_each_group_only(spark):
    rng = np.random.default_rng(4)
    data = [(i, rng.normal(0, 1, 16).tolist()) for i in range(600)]
    df = spark.createDataFrame(data, SCHEMA)
    index = cells.CellIndex.build(df, cells=30)
    bounds = cells._bounds(index)
    asked = cells.first_parts(df.withColumnRenamed("key", "query_id"), bounds, 5, "bigint").withColumn("least", F.lit(float("-inf")))
    got = cells.reached(asked, bounds, "bigint").collect()
    assert len(index.cells.collect()) == 30 and len(got) == 600
    first = {r.query_id: r["first"] for r in asked.collect()}
    for r in got:
        bits = np.unpackbits(np.frombuffer(r.parts, np.uint8))[:30]
        assert sorted(np.flatnonzero(bits == 0)) == sorted(first[r.query_id])
    assert rows(cells.top_k(df, index, 5, qid="key", exclude_same_key=True)) == brute(data, 5)


def test_many_groups_and_tiles_equal_all_products(spark, odd, monkeypatch):
    monkeypatch.setattr(cells, "FLOATS", 32)
    df = spark.createDataFrame(odd, SCHEMA)
    index = cells.CellIndex.build(df, cells=9, part=7)
    assert max(cells._bounds(index)[2][-1]) > 3
    assert rows(cells.top_k(df, index, 3, qid="key", exclude_same_key=True)) == brute(odd, 3)


@pytest.mark.parametrize("scale", [1.0, 1e-6, 1e20])
def test_best_of_a_group_equals_all_products(monkeypatch, scale):
    for name, value in (("QUERIES", 4), ("VECTORS", 5), ("MANY", 1)):
        monkeypatch.setattr(cells, name, value)
    rng = np.random.default_rng(5)
    vectors = scale * rng.integers(-9, 9, (40, 3)).astype(float)
    column = lambda m: pa.array(m.tolist(), pa.list_(pa.float64()))
    q = pa.table({"query_id": [f"k{i}" for i in range(11)], "embedding": column(vectors[:11]), "least": [-np.inf] * 11,
                  "parts": pa.array([bytes([0b11000000])] * 10 + [bytes([0b01000000])], pa.binary())})
    v = pa.table({"key": [f"k{i}" for i in range(40)], "place": pa.array([i % 2 for i in range(40)], pa.int32()), "embedding": column(vectors)})
    got = cells.best_of_group(q, v, 3, True).to_pandas()
    assert got["products"].sum() == 10 * 40 + 20
    s = np.round(vectors @ vectors.T, 9)
    for i in range(11):
        best = sorted((-s[i, j], f"k{j}") for j in range(40) if j != i and (i < 10 or j % 2))[:3]
        mine = got[got["query_id"] == f"k{i}"]
        assert sorted(mine["key"]) == sorted(k for _, k in best)
        assert sorted(mine["score"]) == pytest.approx(sorted(-x for x, _ in best), rel=1e-12, abs=1e-9)
