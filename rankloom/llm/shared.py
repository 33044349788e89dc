"""Helpers of the training-data operators: tables in the shared folder, bounded slices of
Arrow batches, and a per-task vocabulary that resolves each distinct chunk of text once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rankloom.session import ensure_checkpoint_dir

SLICE_BYTES = 4 << 20        # text handled at once inside a task
SLICE_ROWS = 4096
CACHE_ENTRIES = 300_000      # distinct chunks a task remembers before it starts afresh


class Scratch:
    """Tables of one job under ``spark.checkpoint.dir``: any executor can read them and a
    lost one does not lose them. ``drop`` removes a table that no later step reads."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rankloom-llm/{job}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], text: str | None = "text",
           size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds at most SLICE_ROWS rows and about ``size`` bytes of
    the ``text`` column (one longer value makes a slice of its own)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if text is None:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                yield batch.slice(i, SLICE_ROWS)
            continue
        sizes = byte_lengths(batch.column(text))
        at, held = 0, 0
        for i, n in enumerate(sizes):
            if i > at and (held + n > size or i - at >= SLICE_ROWS):
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += int(n)
        yield batch.slice(at)


def byte_lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


class Chunks(dict):
    """chunk -> number in order of first appearance; unseen chunks gather in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, chunk):
        n = self[chunk] = len(self)
        self.new.append(chunk)
        return n


class RaggedCache:
    """For each distinct chunk of text, a row of numbers that ``resolve(chunks)`` gives.

    ``resolve`` gets the chunks not yet known and returns (lengths, flat values). Memory is
    bounded: past ``limit`` chunks the cache starts afresh at the next slice; the result
    does not depend on it."""

    def __init__(self, resolve: Callable[[list], tuple[np.ndarray, np.ndarray]], dtype,
                 limit: int = CACHE_ENTRIES):
        self.resolve, self.dtype, self.limit = resolve, dtype, limit
        self.clear()

    def clear(self) -> None:
        self.index = Chunks()
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.dtype)

    def number(self, documents: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all documents' chunks, and each document's bounds in them."""
        counts = np.fromiter(map(len, documents), np.int64, len(documents))
        chunks = chain.from_iterable(documents)
        numbers = np.fromiter(map(self.index.__getitem__, chunks), np.int32, int(counts.sum()))
        return numbers, np.concatenate(([0], np.cumsum(counts)))

    def settle(self) -> None:
        """Resolve the chunks that are new since the last call."""
        if self.index.new:
            lengths, flat = self.resolve(self.index.new)
            lengths = np.asarray(lengths, np.int64)
            starts = len(self.flat) + np.concatenate(([0], np.cumsum(lengths)[:-1]))
            self.starts = np.concatenate((self.starts, starts))
            self.lengths = np.concatenate((self.lengths, lengths))
            self.flat = np.concatenate((self.flat, np.asarray(flat, self.dtype)))
            self.index.new = []

    def gather(self, numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of settled chunks one after another, and each document's bounds in them."""
        sizes = self.lengths[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[numbers] - (ends - sizes), sizes) + np.arange(total)
        return self.flat[at], np.concatenate(([0], ends))[bounds]

    def rows(self, documents: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """``number``, ``settle`` and ``gather`` in one; starts afresh first if it is full."""
        if len(self.index) > self.limit:
            self.clear()
        numbers, bounds = self.number(documents)
        self.settle()
        return self.gather(numbers, bounds)


def sums_between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each [bounds[i], bounds[i + 1]); empty spans give 0."""
    running = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
    return running[bounds[1:]] - running[bounds[:-1]]
