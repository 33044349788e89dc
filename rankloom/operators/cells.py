"""Exact inner-product top-k over k-means cells, visited by their upper bound.

    vectors(cell, part, key, embedding)     every usable vector with its nearest centre
    cells(cell, part, n, radius)            size and radius of every part of a cell

No vector of a cell has a higher inner product with a query than the centre's plus the query's norm
times the cell's radius (the largest distance of its vectors from the centre). A search scores, for
each query, first the parts of highest bound that hold k vectors; their k-th score is the query's
threshold. Then only parts whose bound reaches the threshold are visited, and the lists of both
rounds are merged. Results equal those of all products, which ``dense.exact_top_k`` computes.

The centres are fitted on SAMPLE vectors at most, chosen by hash; every vector is indexed. A cell is
dealt into parts of about PART rows by the hash of the key and the vector, so neither a large cell
nor a key that repeats is one task's work. Centres and radii are broadcast; CELLS bounds the centres, and
the parts, one for PART vectors, are checked against BROADCAST_BYTES. In the first round a part meets its
queries in a cogrouped function. In the second, where vectors without clusters reach every part, tiles of queries
meet groups of parts: rows shuffled are |Q| x |V| / group + |V| x |Q| / tile, both of about FLOATS numbers, and a
tile's products are made part by part for the queries that reach it, of which only hits above the running k-th
score are looked at.

Defined cases: vectors that are null, empty, or hold a null or non-finite component, and null keys, take
no part. Vectors of another length than most are compared with those of their own length only. A
repeated query key is one query (its smallest vector); repeated vectors are candidates each.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rankloom.operators.dense import top_of_block, usable
from rankloom.operators.topk import RANK_DECIMALS, score_order, top_k_per_group
from rankloom.session import BROADCAST_BYTES, ensure_checkpoint_dir, materialize

CELLS, SAMPLE, ROUNDS = 1024, 20_000, 8
PART = 4096
MARGIN = 10.0 ** -(RANK_DECIMALS - 1)       # bounds and scores are rounded sums
SCORES_AT_ONCE = 4 << 20
FLOATS = 1 << 22                            # numbers in a tile of queries or a group of parts
LEAST_TILE = 1 << 10                        # queries
QUERIES, VECTORS, MANY = 512, 1024, 4      # scored at a time; hits kept for each of k until they are settled


def kmeans(rows: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres after ``rounds`` of Lloyd's steps; the first are rows spread evenly over the sample."""
    centres = rows[np.linspace(0, len(rows) - 1, min(cells, len(rows))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(rows, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row and the distance from it."""
    near = np.concatenate([(((centres * centres).sum(axis=1)[None, :] - 2 * rows[a:a + 4096] @ centres.T)).argmin(axis=1)
                           for a in range(0, len(rows), 4096)]) if len(rows) else np.zeros(0, int)
    return near, np.sqrt(((rows - centres[near]) ** 2).sum(axis=1))


@dataclass
class CellIndex:
    vectors: DataFrame
    cells: DataFrame
    centres: dict[int, np.ndarray]          # by vector length

    @staticmethod
    def build(vectors: DataFrame, key: str = "key", vec: str = "embedding", cells: int | None = None,
              path: str | None = None, part: int = PART) -> "CellIndex":
        """Write the index of ``vectors`` under ``path``. By default there are as many centres as the
        root of the number of vectors, at most CELLS."""
        spark = vectors.sparkSession
        path = (path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/rankloom/cells-{uuid.uuid4().hex}").rstrip("/")
        good = vectors.filter(usable(vec) & F.col(key).isNotNull()).select(
            F.col(key).alias("key"), F.transform(vec, lambda x: x.cast("double")).alias("embedding"))
        sizes = {r["d"]: r["n"] for r in good.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
        centres = {}
        for d, n in sizes.items():
            picked = F.pmod(F.xxhash64("embedding", F.lit("cells")), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30))
            rows = [r[0] for r in good.filter((F.size("embedding") == d) & picked).select("embedding").limit(2 * SAMPLE).collect()]
            rows = np.array(sorted(rows), np.float64).reshape(-1, d)
            few = max(1, min(cells or int(n ** 0.5), CELLS))
            centres[d] = kmeans(rows, few) if len(rows) else np.zeros((1, d))
        shared = spark.sparkContext.broadcast(centres)
        kind = dict(good.dtypes)["key"]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pdf = batch.to_pandas()
                lengths = pdf["embedding"].map(len).to_numpy()
                cell, far = np.zeros(len(pdf), np.int32), np.zeros(len(pdf))
                for d in np.unique(lengths):
                    at = np.flatnonzero(lengths == d)
                    cell[at], far[at] = nearest(np.vstack(pdf["embedding"].iloc[at].to_list()), shared.value[int(d)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths.astype(np.int32)), pa.array(cell), pa.array(far)],
                                                 ["key", "embedding", "d", "cell", "far"])

        placed = good.mapInArrow(place, f"key {kind}, embedding array<double>, d int, cell int, far double")
        placed.write.mode("overwrite").parquet(f"{path}/placed")
        placed = spark.read.parquet(f"{path}/placed")
        counts = placed.groupBy("d", "cell").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
        dealt = placed.join(F.broadcast(counts), ["d", "cell"]).withColumn(      # at most a row for each centre
            "part", F.pmod(F.xxhash64("key", "embedding"), F.col("parts")).cast("int"))
        dealt.select("d", "cell", "part", "key", "embedding", "far").write.mode("overwrite").parquet(f"{path}/vectors")
        dealt = spark.read.parquet(f"{path}/vectors")
        dealt.groupBy("d", "cell", "part").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")) \
             .write.mode("overwrite").parquet(f"{path}/cells")
        return CellIndex(dealt.drop("far"), spark.read.parquet(f"{path}/cells"), centres)


def _bounds(index: CellIndex) -> dict[int, tuple[np.ndarray, ...]]:
    """By vector length: (centres, cells, parts, sizes, radii, groups) of all parts."""
    if index.cells.count() * 64 > BROADCAST_BYTES:
        raise ValueError("too many parts of cells to send to the queries: raise PART")
    of: dict[int, list] = {}
    for r in index.cells.collect():
        of.setdefault(r["d"], []).append((r["cell"], r["part"], r["n"], r["radius"]))
    parts = {d: [np.array(x) for x in zip(*sorted(rows), strict=True)] for d, rows in of.items()}
    return {d: (index.centres[d], *rows, _groups(rows[2], d)) for d, rows in parts.items()}


def bounds_of(m: np.ndarray, centres: np.ndarray, cell: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Upper bound of the inner products of each row with the vectors of each part."""
    norms = np.sqrt((m * m).sum(axis=1))[:, None]
    return (m @ centres.T)[:, cell] + norms * radius[None, :] + MARGIN * (1 + norms)


def first_parts(queries: DataFrame, bounds: dict[int, tuple[np.ndarray, ...]], k: int, kind: str) -> DataFrame:
    """(query_id, d, embedding, first): the numbers of the parts of highest bound that hold k vectors besides
    the query's own. Queries that no vector has the length of are left out."""
    shared = queries.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, d, m in _by_length(batches, shared.value):
            centres, cell, _, n, radius, _ = shared.value[d]
            bound = bounds_of(m, centres, cell, radius)
            order = np.argsort(-bound, axis=1, kind="stable")
            before = np.cumsum(n[order], axis=1) - n[order]
            chosen = [o[x <= k].astype(np.int32) for o, x in zip(order, before, strict=True)]      # k and the query's own vector
            yield pa.RecordBatch.from_arrays(
                [table.column("query_id"), pa.array(np.full(len(m), d, np.int32)), table.column("embedding"),
                 pa.array(chosen, pa.list_(pa.int32()))], ["query_id", "d", "embedding", "first"])

    return queries.select("query_id", "embedding").mapInArrow(run, f"query_id {kind}, d int, embedding array<double>, first array<int>")


def reached(asked: DataFrame, bounds: dict[int, tuple[np.ndarray, ...]], kind: str) -> DataFrame:
    """One row for each of ``asked(query_id, embedding, first, least)`` and group of parts that holds one whose
    bound reaches ``least``, without the parts in ``first``; parts: a bit for each part of the group."""
    shared = asked.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, d, m in _by_length(batches, shared.value):
            centres, cell, _, n, radius, grp = shared.value[d]
            # a bound that is no number (of components too large) excludes nothing
            chosen = ~(bounds_of(m, centres, cell, radius) < table.column("least").to_numpy(zero_copy_only=False)[:, None])
            for row, some in zip(chosen, table.column("first").to_pylist(), strict=True):
                row[some] = False
            starts = np.flatnonzero(np.diff(grp, prepend=-1))
            for g, (a, b) in enumerate(zip(starts, [*starts[1:], len(n)], strict=True)):
                at = np.flatnonzero(chosen[:, a:b].any(axis=1))
                bits = np.packbits(chosen[at, a:b], axis=1)
                some = table.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [some.column("query_id"), pa.array(np.full(len(at), d, np.int32)), pa.array(np.full(len(at), g, np.int32)),
                     some.column("embedding"), some.column("least"), pa.array([x.tobytes() for x in bits], pa.binary())],
                    ["query_id", "d", "grp", "embedding", "least", "parts"])

    return asked.select("query_id", "embedding", "first", "least").mapInArrow(
        run, f"query_id {kind}, d int, grp int, embedding array<double>, least double, parts binary")


def _groups(n: np.ndarray, d: int) -> np.ndarray:
    """The group of each part of n vectors of length d: runs of parts of about FLOATS numbers, numbered without gaps."""
    return np.unique((np.cumsum(n) - n) // max(1, FLOATS // d), return_inverse=True)[1]


def _by_length(batches: Iterator[pa.RecordBatch], known: dict) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """(rows, length, vectors) for rows of equal, known length, so few that their bounds are a bounded matrix."""
    for batch in batches:
        lengths = pc.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
        for d in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == d)
            step = max(1, SCORES_AT_ONCE // len(known[d][1])) if d in known else len(at)
            for a in range(0, len(at) if d in known else 0, step):
                rows = batch.take(pa.array(at[a:a + step]))
                yield rows, d, _matrix(rows.column("embedding"), d)


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class Best:
    """The k best (query, vector, score) of some queries, by rounded score, then the vectors' ``codes``. Hits gather
    until there are MANY for each query; then the k-th score becomes the least that counts."""

    def __init__(self, least: np.ndarray, codes: np.ndarray, k: int):
        self.least, self.codes, self.k, self.new = least.copy(), codes, k, 0
        self.hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, i: np.ndarray, j: np.ndarray, s: np.ndarray) -> None:
        self.hits.append((i, j, s))
        self.new += len(i)
        if self.new > MANY * self.k * len(self.least):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, s = (np.concatenate([h[c] for h in self.hits] or [np.zeros(0, int)]) for c in range(3))
        order = np.lexsort((self.codes[j], -np.round(s, RANK_DECIMALS), i))
        i, j, s = i[order], j[order], s[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        last = rank == self.k - 1
        self.least[i[last]] = np.maximum(self.least[i[last]], s[last] - MARGIN)
        self.hits, self.new = [tuple(x[rank < self.k] for x in (i, j, s))], 0
        return self.hits[0]


class Products:
    """Inner products of rows of two matrices that reach a bound: single precision finds those that may, by the
    bound of its error, and double precision makes their scores."""

    def __init__(self, m: np.ndarray, v: np.ndarray):
        self.m, self.v = m, v
        norms, far = (np.sqrt((x * x).sum(axis=1)) for x in (m, v))
        self.error = norms * far.max() * (m.shape[1] + 8) * 2.0 ** -23
        self.single = bool(norms.max() < 1e15 and far.max() < 1e15)      # else it might overflow
        if self.single:
            self.m32, self.v32 = m.astype(np.float32), v.astype(np.float32)
            self.s, self.hit = np.empty(QUERIES * VECTORS, np.float32), np.empty(QUERIES * VECTORS, bool)

    def above(self, rows: np.ndarray, b: int, e: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, score): places in ``rows``, numbers of vectors from b to e; each score that reaches ``least``[i], and more."""
        shape = (len(rows), e - b)
        if self.single:
            size = shape[0] * shape[1]
            s, hit = self.s[:size].reshape(shape), self.hit[:size].reshape(shape)
            np.matmul(self.m32[rows], self.v32[b:e].T, out=s)
            # rounded down by one more step of single precision
            low = least - self.error[rows]
            np.greater_equal(s, (low - np.abs(low) * 2.0 ** -22).astype(np.float32)[:, None], out=hit)
            at = np.flatnonzero(hit)
            if len(at) * 16 < size:
                i, j = np.divmod(at, shape[1])
                return i, j + b, np.einsum("ij,ij->i", self.m[rows[i]], self.v[b + j])
        s = self.m[rows] @ self.v[b:e].T
        i, j = np.nonzero((s >= least[:, None]) & np.isfinite(s))
        return i, j + b, s[i, j]


def best_of_group(q: pa.Table, v: pa.Table, k: int, own: bool) -> pa.Table:
    """(query_id, key, score, products): the k best vectors of a group of parts for each query of a tile, at least
    those that reach the query's ``least``; only the parts in the query's bits are scored."""
    d = len(q.column("embedding")[0])
    place = v.column("place").to_numpy()
    v = v.take(pa.array(np.argsort(place, kind="stable")))
    place = np.sort(place)
    values, codes = np.unique(v.column("key").to_numpy(), return_inverse=True)
    code_of = dict(zip(values.tolist(), range(len(values)), strict=True)) if own else {}
    mine = np.array([code_of.get(x, -1) for x in q.column("query_id").to_numpy().tolist()])
    m, vm = _matrix(q.column("embedding"), d), _matrix(v.column("embedding"), d)
    bits = np.frombuffer(b"".join(q.column("parts").to_pylist()), np.uint8).reshape(len(m), -1)
    least = q.column("least").to_numpy()
    score = Products(m, vm)
    found, products = [], 0
    for a in range(0, len(m), QUERIES):
        chosen = np.unpackbits(bits[a:a + QUERIES], axis=1)
        best = Best(least[a:a + QUERIES], codes, k)
        for p in range(place[-1] + 1):
            x, y = np.searchsorted(place, (p, p + 1)).tolist()
            rows = np.flatnonzero(chosen[:, p])
            products += len(rows) * (y - x)
            for b in range(x, y if len(rows) else x, VECTORS):
                i, j, s = score.above(a + rows, b, min(y, b + VECTORS), best.least[rows])
                if own:
                    other = mine[a + rows[i]] != codes[j]
                    i, j, s = i[other], j[other], s[other]
                best.add(rows[i], j, s)
        i, j, s = best.settle()
        found.append((i + a, j, s))
    i, j, s = (np.concatenate([f[c] for f in found]) for c in range(3))
    # counted on the first row: a group without a hit gives none
    return pa.table({"query_id": q.column("query_id").take(pa.array(i)), "key": v.column("key").take(pa.array(j)),
                     "score": pa.array(s, pa.float64()), "products": pa.array(np.where(np.arange(len(i)) == 0, products, 0), pa.int64())})


def part_names(spark: SparkSession, bounds: dict[int, tuple[np.ndarray, ...]]) -> DataFrame:
    """(d, cell, part, at, grp, place): number of every part, as in the bounds, its group and its number there."""
    rows = [pd.DataFrame({"d": d, "cell": cell, "part": part, "at": np.arange(len(n)), "grp": grp})
            for d, (_, cell, part, n, _, grp) in bounds.items()]
    parts = pd.concat(rows or [pd.DataFrame(columns=["d", "cell", "part", "at", "grp"])], ignore_index=True)
    return spark.createDataFrame(parts.assign(place=parts.groupby(["d", "grp"]).cumcount()).astype("int32"),
                                 "d int, cell int, part int, at int, grp int, place int")


def scored_groups(asked: DataFrame, index: CellIndex, bounds: dict[int, tuple[np.ndarray, ...]], parts: DataFrame, k: int,
                  own: bool, kinds: tuple[str, str], queries: int) -> DataFrame:
    """(query_id, key, score, products) of all parts that ``asked`` reaches: tiles of queries meet groups of parts,
    both of bounded size, so neither a (query, part) pair nor a pair of vectors is a row."""
    groups = max(1, sum(int(grp[-1]) + 1 for *_, grp in bounds.values()))
    cores = asked.sparkSession.sparkContext.defaultParallelism
    tiles = max(1, math.ceil(queries * max(bounds, default=1) / FLOATS), min(math.ceil(2 * cores / groups), queries // LEAST_TILE))
    q = reached(asked, bounds, kinds[0]).withColumn("tile", F.pmod(F.xxhash64("query_id"), F.lit(tiles)).cast("int"))
    v = index.vectors.join(F.broadcast(parts), ["d", "cell", "part"]).select(
        "d", "grp", "place", "key", "embedding", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            return best_of_group(left, right, k, own)
        empty = (left.schema.field("query_id").type, right.schema.field("key").type, pa.float64(), pa.int64())
        return pa.table({c: pa.array([], t) for c, t in zip(("query_id", "key", "score", "products"), empty, strict=True)})

    by = ["d", "grp", "tile"]
    return q.groupBy(*by).cogroup(v.groupBy(*by)).applyInArrow(
        run, f"query_id {kinds[0]}, key {kinds[1]}, score double, products long")


def scored(pairs: DataFrame, index: CellIndex, k: int, own: bool, kinds: tuple[str, str]) -> DataFrame:
    """(query_id, key, score, products): each visited part's k best vectors for each query."""
    def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = top_of_block(q["query_id"].to_numpy(), np.vstack(q["embedding"].to_list()) if len(q) else None,
                           v["key"].to_numpy(), np.vstack(v["embedding"].to_list()) if len(v) else None, k, own)
        # counted on the first row: a part without a single hit has no other vector than the query's own
        return out.assign(products=np.where(np.arange(len(out)) == 0, len(q) * len(v), 0))

    by = ["d", "cell", "part"]
    return pairs.groupBy(*by).cogroup(index.vectors.groupBy(*by)).applyInPandas(
        run, f"query_id {kinds[0]}, key {kinds[1]}, score double, products long")


def search(queries: DataFrame, index: CellIndex, k: int, *, qid: str = "query_id", vec: str = "embedding",
           exclude_same_key: bool = False) -> DataFrame:
    """(query_id, key, score, products) of both rounds: candidates for each query's top k, and the number
    of products made on one row of each visited part or group."""
    q = queries.filter(usable(vec) & F.col(qid).isNotNull()).groupBy(F.col(qid).alias("query_id")).agg(
        F.min(F.transform(vec, lambda x: x.cast("double"))).alias("embedding"))
    kinds = (dict(q.dtypes)["query_id"], dict(index.vectors.dtypes)["key"])
    bounds = _bounds(index)
    parts = part_names(queries.sparkSession, bounds)
    q = materialize(first_parts(q, bounds, k, kinds[0]), "cell_queries")
    pairs = q.select("query_id", "d", "embedding", F.explode("first").alias("at")).join(F.broadcast(parts), ["d", "at"])
    first = materialize(scored(pairs, index, k, exclude_same_key, kinds), "cell_first")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score")))
    kth = first.withColumn("rank", rank).filter(F.col("rank") == k).select(
        "query_id", (F.col("score") - MARGIN).alias("least"))
    asked = q.join(kth, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    return first.unionByName(scored_groups(asked, index, bounds, parts, k, exclude_same_key, kinds, q.count()))


def top_k(queries: DataFrame, index: CellIndex, k: int, **kw) -> DataFrame:
    """G1: (query_id, key, score, rank), the k vectors with the highest inner products; equal to
    ``dense.exact_top_k``."""
    found = search(queries, index, k, **kw).select("query_id", "key", "score")
    return top_k_per_group(found, "query_id", score_order(), k)


def products(found: DataFrame) -> int:
    """Products that a ``search`` made."""
    return found.agg(F.sum("products")).first()[0] or 0

