import math
import random

import pytest

from rankloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=5, every=50):
    """All pairs in Python integers."""
    use = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
           if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in use:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for qid, q in queries.items():
        found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in use if i != qid and len(v) == len(q))[:k]
        out += [(qid, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def run(df, **sizes):
    v = topk.quantised(df)
    return sorted(tuple(r) for r in topk.nearest(v.filter("key % 50 = 0"), v, 5, **sizes).collect())


@pytest.mark.parametrize("sizes", [{}, {"shard": 16, "tile": 2, "fan": 3}])
def test_ties_nulls_repeats_and_ragged_rows(spark, sizes):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(160)]
    rows += [(200 + i, [0.25, 0.25, 0.25, 0.25]) for i in range(60)] + rows[:3]
    rows += [(300, None), (301, [None, 1.0, 1.0, 1.0]), (302, [float("nan")] * 4), (303, [float("inf")] * 4), (None, [1.0] * 4),
             (350, [1.0, 2.0]), (351, [3.0, 4.0]), (400, []), (401, [])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'own' as key", "'own' as shard", "1 as score")
    assert run(df, **sizes) == brute(rows)


def test_large_components_stay_exact(spark):
    rows = [(i, [1e12 + i * 1e9, -1e12]) for i in range(0, 60)]
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    limit = (1 << 63) - 1
    want = [(q, r, i, max(-limit - 1, min(limit, s))) for q, r, i, s in brute(rows)]
    got = run(df)
    assert [x[3] for x in got] == [x[3] for x in want]


def test_given_rows_and_none(table):
    rows = [(r.vec_id, r.embedding) for r in table("embeddings").collect()]
    assert run(table("embeddings")) == brute(rows)
    assert run(table("embeddings").limit(0)) == []
