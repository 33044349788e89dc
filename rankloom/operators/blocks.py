"""Best documents of every query over the document index, in blocks of bounded size.

The documents are written once as blocks of about DOCS, several to a split of about SPLIT_DOCS (or SPLIT_TERMS
terms), queries are hashed into tiles of about TILE_QUERIES. The task of a tile keeps its queries' n best while it
reads the written blocks one after the other (few tiles share the splits out among more tasks). So no document is
copied for a tile and no pair is a row: the disk holds the blocks once and n rows of a query and list, a task's
memory follows the tile and one block, and nothing is collected.

In a block the scores of QUERIES x DOCS pairs at a time are summed: terms that many queries share with many
documents as a product of two small matrices, in single precision, all others one by one. Pairs that may reach
their query's n-th score so far, by the bound of that precision's error, are scored in double precision and kept.

A term's code is its bucket followed by the lower bits of its 64-bit hash, so the codes of a bucket are a range.
Rows of one key are one document, rows of one query id one query (null keys and ids as well), whose scores add up
as in ``lexical.pair_scores``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.topk import RANK_DECIMALS
from rankloom.session import materialize, setting, without_shuffle_files

TILE_QUERIES, SPLIT_DOCS, SPLIT_TERMS = 2048, 1 << 13, 1 << 22
TILE_BYTES = 16 << 20                       # of the queries' text in a tile
LEAST_QUERIES = 1 << 10                     # few queries are dealt to the cores down to tiles of this size
QUERIES, DOCS = 1024, 1024                  # pairs scored at a time
ONE_BY_ONE, SLICE, AT_ONCE = 1 << 19, 1024, 1 << 12     # products of single terms, terms in a matrix, exact scores
DENSE_GAIN = 512                            # a matrix product's cost against that of as many single ones
MARGIN = 10.0 ** -(RANK_DECIMALS - 1)       # a score this close to the n-th may still tie with it
CODE_BITS = 64

BLOCKS = "split int, first long, keys binary, docs binary, dl binary, norm binary, terms binary, starts binary, entries binary"


def code(term: Column, bucket: Column, dim: int) -> Column:
    """A term's bucket (below ``dim``) in the upper bits, its hash in the others."""
    shift = _shift(dim)
    return F.shiftleft(bucket.cast("long"), shift).bitwiseOR(F.xxhash64(term).bitwiseAND(F.lit((1 << shift) - 1)))


def _shift(dim: int) -> int:
    return min(CODE_BITS - 2, CODE_BITS - (dim - 1).bit_length())


class Entries:
    """(row, term, weight) by term, the terms from 0 to ``terms``: the columns of a sparse matrix."""

    def __init__(self, row: np.ndarray, starts: np.ndarray, counts: np.ndarray, weight: np.ndarray):
        self.row, self.starts, self.counts, self.weight = row, starts, counts, weight

    @staticmethod
    def of(row: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int) -> "Entries":
        order = np.argsort(term, kind="stable")
        starts = np.searchsorted(term[order], np.arange(terms + 1))
        return Entries(row[order], starts[:-1], np.diff(starts), weight[order])

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Where the entries of ``terms`` are."""
        n = self.counts[terms]
        return np.repeat(self.starts[terms] - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def dense(self, terms: np.ndarray, rows: int) -> np.ndarray:
        at, n = self.places(terms), self.counts[terms]
        cell = self.row[at] * np.int64(len(terms)) + np.repeat(np.arange(len(terms)), n)
        return np.bincount(cell, self.weight[at], rows * len(terms)).reshape(rows, len(terms))


def one_by_one(q: Entries, d: Entries, terms: np.ndarray, nq: int, nd: int) -> np.ndarray:
    """Scores of nq queries and nd documents over ``terms``: every (query entry, document entry) pair of a term,
    about ONE_BY_ONE at a time."""
    out = np.zeros(nq * nd)
    piece = np.cumsum(q.counts[terms] * d.counts[terms]) // ONE_BY_ONE
    for some in np.split(terms, np.flatnonzero(np.diff(piece)) + 1) if len(terms) else []:
        nqt, ndt = q.counts[some], d.counts[some]
        qat = q.places(some)
        # query entries each repeated for the documents
        each = np.repeat(ndt, nqt)
        dat = np.repeat(np.repeat(d.starts[some], nqt) - (np.cumsum(each) - each), each) + np.arange(each.sum())
        cell = np.repeat(q.row[qat] * np.int64(nd), each) + d.row[dat]
        out += np.bincount(cell, np.repeat(q.weight[qat], each) * d.weight[dat], nq * nd)
    return out.reshape(nq, nd)


class Best:
    """The n best (query, document, score) seen so far of some queries; documents are numbered in key order."""

    def __init__(self, queries: int, n: int):
        self.n, self.least = n, np.zeros(queries)
        self.q = self.d = np.zeros(0, np.int64)
        self.s = np.zeros(0)
        self.new, self.waiting = [], 0

    def add(self, about: np.ndarray, slack: np.ndarray, docs: np.ndarray, exact) -> None:
        """``about`` are scores of all queries with ``docs``, off by a query's ``slack`` at most and zero for a pair
        without a common term; ``exact(i, j)`` are those of some pairs. Positive scores count."""
        good = about >= np.maximum(self.least - slack, np.finfo(np.float64).tiny)[:, None]
        full = np.flatnonzero(np.count_nonzero(good, axis=1) > self.n)
        if len(full):
            at = about.shape[1] - self.n
            good[full] &= about[full] >= (np.partition(about[full], at, axis=1)[:, at] - 2 * slack[full] - MARGIN)[:, None]
        i, j = np.divmod(np.flatnonzero(good), about.shape[1])
        s = exact(i, j)
        kept = np.flatnonzero((s > 0) & (s >= self.least[i]))
        if len(kept):
            self.new.append((i[kept], docs[j[kept]], s[kept]))
            self.waiting += len(kept)
        if self.waiting * 4 > self.n * len(self.least):
            self.settle()

    def settle(self) -> None:
        """Put what was added since to the best."""
        if not self.new:
            return
        q, d, s = (np.concatenate(x) for x in zip((self.q, self.d, self.s), *self.new, strict=True))
        order = np.lexsort((d, -np.round(s, RANK_DECIMALS), q))
        q, d, s = q[order], d[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        self.least[q[rank == self.n - 1]] = s[rank == self.n - 1] - MARGIN
        kept = rank < self.n
        self.q, self.d, self.s, self.new, self.waiting = q[kept], d[kept], s[kept], [], 0


class Asked:
    """Some queries' terms in one list, and the best documents found for them."""

    def __init__(self, entries: Entries, queries: int, n: int):
        self.entries, self.queries, self.best = entries, queries, Best(queries, n)

    def choose(self, often: np.ndarray) -> None:
        """From now on ``often`` are the terms that are multiplied as matrices."""
        self.matrix = self.entries.dense(often, self.queries)
        self.small = self.matrix.astype(np.float32)
        self.length = np.linalg.norm(self.matrix, axis=1)

    def meet(self, held: Entries, rare: np.ndarray, matrix: np.ndarray, small: np.ndarray, docs: np.ndarray, single: bool) -> None:
        """``matrix`` has the documents' weights of the terms that are multiplied as matrices; of the others only
        ``rare`` are in documents. In single precision, with a bound of its error, where ``single``."""
        rest = one_by_one(self.entries, held, rare[self.entries.counts[rare] > 0], self.queries, len(docs))
        if single:
            rest_and = rest + self.small @ small.T
            slack = self.length * (np.linalg.norm(matrix, axis=1).max() * (matrix.shape[1] + 4) * 2.0 ** -23)
        else:
            rest_and, slack = rest + self.matrix @ matrix.T, np.zeros(self.queries)

        def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = rest[i, j]
            for a in range(0, len(i), AT_ONCE):
                some = slice(a, a + AT_ONCE)
                out[some] += np.einsum("ij,ij->i", self.matrix[i[some]], matrix[j[some]])
            return out

        self.best.add(rest_and, slack, docs, exact)


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(code of every row, values in order, null first)."""
    values = pc.unique(column)
    values = values.take(pc.array_sort_indices(values, order="ascending", null_placement="at_start"))
    codes = pc.index_in(column, value_set=values, skip_nulls=False)
    return codes.to_numpy(zero_copy_only=False).astype(np.int64), values


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as to:
        to.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all()


def block_row(v: pa.Table, split: int, first: int) -> pa.RecordBatch:
    """The written form of documents (key, dl, norm, codes, tfs), of which those with a key are all there;
    ``first`` is the number of the first in its split. ``terms`` are their codes in order, of which that at i has
    the entries (row, tf) from starts[i] to starts[i + 1]."""
    drow, keys = _codes(_one(v.column("key")))
    sizes = pc.list_value_length(_one(v.column("tfs"))).to_numpy(zero_copy_only=False)
    codes = _one(v.column("codes")).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    entries = pa.table({c: x.astype(np.min_scalar_type(x.max(initial=0))) for c, x in (
        ("row", np.repeat(np.arange(len(sizes)), sizes)[order]),
        ("tf", _one(v.column("tfs")).flatten().to_numpy(zero_copy_only=False)[order]))})
    parts = [split, first, _bytes(pa.table({"key": keys})), drow.astype("<i4"), v.column("dl").to_numpy().astype("<f8"),
             v.column("norm").to_numpy().astype("<f8"), codes[starts].astype("<u8"), np.append(starts, len(codes)).astype("<i4"),
             _bytes(entries)]
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes() if isinstance(x, np.ndarray) else x], kind) for x, kind in zip(
        parts, [pa.int32(), pa.int64(), *[pa.binary()] * 7], strict=True)], names)


def written(documents: DataFrame, docs: int, length: float, dim: int, path: str) -> DataFrame:
    """The blocks of ``documents``, under ``path``: neighbours in the order of keys, so that any two documents are
    in the order of their (split, number). One shuffle, whose files go when the blocks are written."""
    splits = max(1, math.ceil(docs / SPLIT_DOCS), math.ceil(docs * length / SPLIT_TERMS))
    most = DOCS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, split, first = None, TaskContext.get().partitionId(), 0
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while held.num_rows > most:
                keys = _one(held.column("key"))
                # the rows of a key stay together
                new = pc.fill_null(pc.not_equal(keys[most:], keys[most - 1:-1]), True).to_numpy(zero_copy_only=False)
                both_null = keys[most:].is_null().to_numpy(zero_copy_only=False) & keys[most - 1:-1].is_null().to_numpy(zero_copy_only=False)
                ends = np.flatnonzero(new & ~both_null)
                if not len(ends):
                    break
                n = most + int(ends[0])
                yield block_row(held[:n], split, first)
                held, first = held[n:], first + n
        if held is not None and held.num_rows:
            yield block_row(held, split, first)

    v = documents.filter(F.size("terms") > 0).select(
        "key", "dl", "norm", F.zip_with("terms", "buckets", lambda t, b: code(t, b, dim)).alias("codes"), "tfs")
    with without_shuffle_files(documents.sparkSession):
        v.repartitionByRange(splits, "key").sortWithinPartitions("key").mapInArrow(cut, BLOCKS).write.parquet(path)
    return documents.sparkSession.read.parquet(path)


class Tile:
    """Queries and the best documents found for them so far."""

    def __init__(self, q: pa.Table, n: int, lists: tuple[str, ...], shift: int):
        qrow, self.ids = _codes(_one(q.column("query_id")))
        codes = q.column("code").to_numpy().view(np.uint64)
        self.lists, self.shift, self.n, self.blocks = lists, shift, n, 0
        self.numbers, self.keys = [], []                # of the documents that may be among the best
        self.sides = []                                 # of each list: terms, how many documents had them, groups of queries
        for name in lists:
            weight = q.column("wq" if name == "dense" else "qw").to_numpy(zero_copy_only=False).astype(np.float64)
            on = np.flatnonzero(~np.isnan(weight) & ((weight != 0) if name == "dense" else True))
            row, weight = qrow[on], weight[on]
            values, term = np.unique(codes[on] >> np.uint64(shift) if name == "dense" else codes[on], return_inverse=True)
            groups = []
            for a in range(0, len(self.ids), QUERIES):
                some = np.flatnonzero((row >= a) & (row < a + QUERIES))
                groups.append(Asked(Entries.of(row[some] - a, term[some], weight[some], len(values)), min(QUERIES, len(self.ids) - a), n))
            self.sides.append([values, np.zeros(len(values), np.int64), groups, bool((weight >= 0).all()), None])

    def meet(self, block: dict, scale) -> None:
        terms, starts = np.frombuffer(block["terms"], "<u8"), np.frombuffer(block["starts"], "<i4").astype(np.int64)
        entries = _table(block["entries"])
        rows, tf = entries.column("row").to_numpy(), entries.column("tf").to_numpy().astype(np.float64)
        of_row, dl, norm = (np.frombuffer(block[c], t) for c, t in (("docs", "<i4"), ("dl", "<f8"), ("norm", "<f8")))
        keys = _one(_table(block["keys"]).column("key"))
        numbers = (np.int64(block["split"]) << 40) + block["first"] + np.arange(len(keys))
        self.numbers.append(numbers)
        self.keys.append(keys)
        docs = of_row[rows]
        self.blocks += 1
        for name, side in zip(self.lists, self.sides, strict=True):
            values, seen, groups, single, often = side
            if name == "dense":
                held_terms, weight = terms >> np.uint64(self.shift), tf / norm[rows]
            else:
                held_terms, weight = terms, scale(tf, dl[rows])
            at, to = np.searchsorted(held_terms, values), np.searchsorted(held_terms, values, side="right")
            held = Entries(docs, starts[at], starts[to] - starts[at], weight)
            if not held.counts.any():
                continue
            seen += held.counts
            if often is None or self.blocks & (self.blocks - 1) == 0:
                # what pays as a matrix product, from the documents so far
                work = sum(g.entries.counts for g in groups) * seen / self.blocks
                pays = np.flatnonzero(work * DENSE_GAIN > len(self.ids) * len(keys))
                often = side[4] = pays[np.argsort(-work[pays], kind="stable")[:SLICE]]
                for g in groups:
                    g.choose(often)
            matrix = held.dense(often, len(keys))
            left = held.counts.copy()
            left[often] = 0
            rare, small = np.flatnonzero(left), matrix.astype(np.float32)
            for g in groups:
                g.meet(held, rare, matrix, small, numbers, single)
        if sum(map(len, self.numbers)) > 2 * len(self.ids) * self.n * len(self.lists):
            self.forget()

    def forget(self) -> None:
        """Keep the keys only of documents that are among the best."""
        best = [g.best for side in self.sides for g in side[2]]
        for b in best:
            b.settle()
        numbers, keys = np.concatenate(self.numbers), pa.concat_arrays(self.keys)
        order = np.argsort(numbers)
        used = np.unique(np.concatenate([b.d for b in best]))
        self.numbers, self.keys = [used], [keys.take(pa.array(order[np.searchsorted(numbers[order], used)]))]

    def found(self) -> Iterator[tuple]:
        """Rows (query_id, list, keys, scores): the best of a query and list in order."""
        if not self.numbers:
            return
        self.forget()
        for k, side in enumerate(self.sides):
            for a, g in zip(range(0, len(self.ids), QUERIES), side[2], strict=True):
                ids, first = np.unique(g.best.q, return_index=True)
                ends = np.append(first, len(g.best.q))
                keys = self.keys[0].take(pa.array(np.searchsorted(self.numbers[0], g.best.d)))
                for i, query in enumerate(self.ids.take(pa.array(ids + a)).to_pylist()):
                    yield query, k, keys[ends[i]:ends[i + 1]].to_pylist(), g.best.s[ends[i]:ends[i + 1]].tolist()


def tiles(spark: SparkSession, queries: int, text_bytes: int) -> int:
    """Tiles for so many queries with so much text."""
    return max(1, math.ceil(queries / TILE_QUERIES), math.ceil(text_bytes / TILE_BYTES),
               min(2 * spark.sparkContext.defaultParallelism, queries // LEAST_QUERIES))


def best_documents(side: DataFrame, blocks: DataFrame, key: str, n: int, tiles: int, dim: int,
                   lists: tuple[str, ...], scale) -> DataFrame:
    """(query_id, key, list, score): for every query the n best documents of each list (0, 1: the place in
    ``lists``), positive scores only, of each share of the splits where tiles are too few for the cores.
    ``side(query_id, code, wq, qw)`` holds the queries' terms in ``tiles`` partitions, a query in one;
    ``blocks`` are written documents, with keys of the type ``key``. ``scale(tf, dl)`` is the part of a BM25 weight
    that depends on the document."""
    spark = side.sparkSession
    cores, shift, kind = 2 * spark.sparkContext.defaultParallelism, _shift(dim), dict(side.dtypes)["query_id"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([_bytes(pa.Table.from_batches(some))], pa.binary())], ["tile"])

    def search(pairs: Iterator) -> Iterator[tuple]:
        now, tile = None, None
        for left, block in pairs:
            if left["tile"] != now:
                if tile is not None:
                    yield from tile.found()
                now, tile = left["tile"], Tile(_table(left["tile"]), n, lists, shift)
            tile.meet(block.asDict(), scale)
        if tile is not None:
            yield from tile.found()

    each = materialize(side.select("query_id", "code", "wq", "qw").mapInArrow(packed, "tile binary"), "tiles")
    with setting(spark, "spark.sql.files.minPartitionNum", str(1 << 20)):       # a partition for each tile
        pairs = each.rdd.cartesian(blocks.rdd.coalesce(max(1, -(-cores // tiles))))
    found = spark.createDataFrame(pairs.mapPartitions(search), f"query_id {kind}, list int, key array<{key}>, score array<double>",
                                  verifySchema=False)
    # whatever is made of a query's lists needs no other shuffle
    return found.repartition("query_id").select("query_id", "list", F.explode(F.arrays_zip("key", "score")).alias("x")).select(
        "query_id", "x.key", "list", "x.score")
