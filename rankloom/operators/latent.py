"""Latent vectors of documents and queries from a distributed factorisation.

The weighted term-document table A (a row a document: the tf-idf weights of its hashed terms, of unit
length) is factorised by a randomised range finder:

    Y = A G           G: a fixed random matrix, generated from its seed in every task
    Q = Y R^-1        R by QR of each task's rows of Y, merged one by one
    B = Q' A          as R^-1' (Y' A), Y' A summed by blocks of terms after the same shuffle
    A ~ Q B,  B = U S V'   from the small matrix B B'

So R and B take one pass over A. POWER more passes put A B' in the place of Y, which sharpens the range. What is kept is a table
of terms, ``latent(bucket, vector)``: V's columns. A text's latent vector is its weights times that
table, brought to unit length, so inner products are cosines in the latent space; documents and
queries are encoded alike (``encode``), in one pass over their texts.

Sizes: buckets (``dim``) and ``rank`` are parameters, so the matrices that are broadcast, G and B, have a
bound (dim x (rank + EXTRA) floats) that the rows do not change; every pass over the documents is
one map over their counted terms with sums of blocks of CHUNK buckets shuffled, and R's are rank x rank.

Defined cases: a null text and a text without a known term have the zero vector. Repeated rows count each.
Other columns are kept by ``encode``. Vectors' signs are fixed: the largest component of every latent
direction is positive.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.operators.lexical import count_terms
from rankloom.session import ensure_checkpoint_dir, without_shuffle_files

DIM, RANK, EXTRA, POWER, SEED = 1 << 16, 32, 8, 2, 1
CHUNK = 1024                # buckets summed as one value
ROWS, ENTRIES = 1 << 10, 1 << 14        # documents of a batch weighed at a time, and entries summed


def random_matrix(dim: int, width: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, width))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS)


def weights_of(buckets: pa.ListArray, tfs: pa.ListArray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, buckets, weights) of a batch of rows: (1 + log tf) * idf, of unit length; buckets
    that several terms share add up, as all sums are linear but the length, which is of the sum."""
    row = np.repeat(np.arange(len(buckets)), pc.list_value_length(buckets).fill_null(0).to_numpy(zero_copy_only=False))
    key = row * len(idf) + buckets.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(key, kind="stable")
    key, w = key[order], 1 + np.log(tfs.flatten().to_numpy(zero_copy_only=False)[order].astype(np.float64))
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    row, flat = np.divmod(key[starts], len(idf))
    w = np.add.reduceat(w, starts) * idf[flat] if len(starts) else np.zeros(0)
    length = np.sqrt(np.bincount(row, w * w, len(buckets)))
    w = w / np.where(length > 0, length, 1)[row]
    return np.searchsorted(row, np.arange(len(buckets) + 1)), flat, w


def sums_of(at: np.ndarray, row: np.ndarray, w: np.ndarray, table: np.ndarray, out: np.ndarray) -> None:
    """Adds w * table[row] to the rows ``at`` (ascending) of ``out``, a few entries at a time, so that they stay
    in the processor's cache."""
    for a in range(0, len(at), ENTRIES):
        some = at[a:a + ENTRIES]
        starts = np.flatnonzero(np.concatenate(([True], some[1:] != some[:-1])))
        part = table[row[a:a + ENTRIES]]
        part *= w[a:a + ENTRIES, None]
        out[some[starts]] += np.add.reduceat(part, starts, axis=0)


def projected(bounds: np.ndarray, flat: np.ndarray, w: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sums of weight times the table's row, a row for each [bounds[i], bounds[i + 1])."""
    out = np.zeros((len(bounds) - 1, table.shape[1]))
    sums_of(np.repeat(np.arange(len(out)), np.diff(bounds)), flat, w, table, out)
    return out


def upper(m: np.ndarray) -> np.ndarray:
    """R of m's QR, its diagonal not negative."""
    r = np.linalg.qr(m, mode="r")
    return np.where(np.diag(r) < 0, -1.0, 1.0)[:, None] * r


@dataclass
class Latent:
    terms: DataFrame            # (bucket, vector)
    idf: np.ndarray
    table: np.ndarray           # dim x rank
    singular: np.ndarray

    def encode(self, df: DataFrame, text: str, out: str = "embedding") -> DataFrame:
        """``df`` with its texts' latent vectors of unit length."""
        shared = df.sparkSession.sparkContext.broadcast((self.idf, self.table))
        # the counted terms travel in a struct of their own, beside whatever columns df has
        rows = count_terms(df.select(F.struct(*df.columns).alias("row"), F.col(text).alias("__text")), "row", "__text", len(self.idf))
        return self._encoded(rows.select(F.col("key").alias("row"), "buckets", "tfs"), df.schema.fields, out, shared)

    def encode_counted(self, counted: DataFrame, out: str = "embedding") -> DataFrame:
        """(key, embedding) of rows whose terms are counted with this space's buckets: counted(key, buckets, tfs)."""
        shared = counted.sparkSession.sparkContext.broadcast((self.idf, self.table))
        return self._encoded(counted.select(F.struct("key").alias("row"), "buckets", "tfs"), [counted.schema["key"]], out, shared)

    @staticmethod
    def _encoded(rows: DataFrame, fields: list, out: str, shared) -> DataFrame:
        schema = T.StructType([*fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf, table = shared.value
            for batch in slices(batches):
                m = projected(*weights_of(batch.column("buckets"), batch.column("tfs"), idf), table)
                length = np.linalg.norm(m, axis=1, keepdims=True)
                m = m / np.where(length > 0, length, 1)
                offsets = pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.column("row").flatten(), pa.ListArray.from_arrays(offsets, pa.array(m.ravel()))],
                                                 schema.names)

        return rows.mapInArrow(run, schema)


def factorise(corpus: DataFrame, key: str = "key", text: str = "text", rank: int = RANK, dim: int = DIM,
              power: int = POWER, path: str | None = None) -> Latent:
    """The latent space of ``corpus``: the ``rank`` largest singular directions of its weighted terms."""
    spark = corpus.sparkSession
    path = (path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/rankloom/latent-{uuid.uuid4().hex}").rstrip("/")
    count_terms(corpus, key, text, dim).select("buckets", "tfs").write.mode("overwrite").parquet(f"{path}/counted")
    return factorise_counted(spark.read.parquet(f"{path}/counted"), path, rank, dim, power)


def factorise_counted(counted: DataFrame, path: str | None = None, rank: int = RANK, dim: int = DIM, power: int = POWER) -> Latent:
    """``factorise`` of a written table of documents whose terms are counted with ``dim`` buckets: (buckets, tfs)."""
    spark = counted.sparkSession
    path = (path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/rankloom/latent-{uuid.uuid4().hex}").rstrip("/")
    n = counted.count()
    idf = np.zeros(dim)
    for r in counted.select(F.explode(F.array_distinct("buckets")).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("df")).collect():
        idf[r["b"]] = np.log((1 + n) / (1 + r["df"])) + 1          # at most dim rows
    width = rank + EXTRA
    basis = random_matrix(dim, width)
    for turn in range(power + 1):
        r, b = _pass(counted, idf, basis)
        b = b @ np.linalg.pinv(r, rcond=1e-10)
        if turn < power:
            basis = b / max(1e-30, np.abs(b).max())
    values, u = np.linalg.eigh(b.T @ b)                            # B B', as b is B'
    order = np.argsort(-values)[:rank]
    singular = np.sqrt(np.maximum(values[order], 0))
    table = b @ u[:, order] / np.where(singular > 1e-10 * max(singular.max(initial=0), 1e-30), singular, np.inf)
    sign = np.sign(table[np.abs(table).argmax(axis=0), np.arange(table.shape[1])])
    table = table * np.where(sign == 0, 1, sign)
    used = np.flatnonzero(np.abs(table).any(axis=1))
    terms = spark.createDataFrame(pa.table({"bucket": used, "vector": pa.array(list(table[used]), pa.list_(pa.float64()))}))
    terms.write.mode("overwrite").parquet(f"{path}/latent")
    return Latent(spark.read.parquet(f"{path}/latent"), idf, table, singular)


def _pass(counted: DataFrame, idf: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """R of the QR of Y = A basis, and A' Y, dim x width, from one pass: each task's rows give one R as they stream by
    and their sums by bucket; the R's of all tasks are stacked and reduced one by one, and the blocks of buckets
    added, after a shuffle."""
    dim, width = basis.shape
    shared = counted.sparkSession.sparkContext.broadcast((idf, basis))

    def row(at: int, s: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([s.astype("<f8").tobytes()], pa.binary())], ["at", "s"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, basis = shared.value
        r, sums = np.zeros((0, width)), np.zeros((dim, width))
        for batch in slices(batches):
            bounds, flat, w = weights_of(batch.column("buckets"), batch.column("tfs"), idf)
            y = projected(bounds, flat, w, basis)
            r = upper(np.vstack((r, y)))
            order = np.argsort(flat, kind="stable")
            sums_of(flat[order], np.repeat(np.arange(len(y)), np.diff(bounds))[order], w[order], y, sums)
        yield row(-1, r)
        for at in range(0, dim, CHUNK):
            part = sums[at:at + CHUNK]
            if part.any():
                yield row(at, part)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, s in zip(batch.column("at").to_pylist(), batch.column("s").to_pylist(), strict=True):
                m = np.frombuffer(s, "<f8").reshape(-1, width)
                sums[at] = upper(np.vstack((sums.get(at, m[:0]), m))) if at < 0 else sums.get(at, 0) + m
        for at, s in sums.items():
            yield row(at, s)

    r, out = np.zeros((width, width)), np.zeros((dim, width))
    # a few sums for each core, not one for each split
    cores = 4 * counted.sparkSession.sparkContext.defaultParallelism
    with without_shuffle_files(counted.sparkSession):
        each = counted.select("buckets", "tfs").coalesce(cores).mapInArrow(partial, "at int, s binary")
        rows = each.repartition("at").mapInArrow(added, "at int, s binary").collect()
    shared.destroy()            # its copies on the executors' disks too
    for x in rows:
        s = np.frombuffer(x["s"], "<f8").reshape(-1, width)
        if x["at"] < 0:
            r = upper(np.vstack((r, s)))
        else:
            out[x["at"]:x["at"] + len(s)] = s
    return r, out


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/latent")
