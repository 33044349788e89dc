"""URL filter over a sorted digest array.

A rule (host, path) fits its host and all subdomains of it, if the url's path starts with the
rule's. The list is one file: the sorted XXH64 digests of the rules' ``host + path`` strings,
their verdicts and the strings themselves. Tasks memory-map it, so its pages are shared and
evictable. A url's possible keys (each parent domain of its host with each path prefix of a
length that some rule has) are hashed and probed together by a binary search over whole
batches; a hit counts only if the stored string is the key, so digest collisions do no harm.
The longest fitting rule decides; without one the url is not on the list and is allowed.

The list goes to the tasks as a broadcast whose size is checked against ``max_bytes``
(a larger list is refused, not cut); each worker puts it into an unnamed temporary file once.

Defined cases: a null url, or one without ``://``, has empty host and path and fits no rule. A
rule with a null host is ignored, and so is one whose path cannot start a url's (it is neither
empty nor starts with ``/``); a null path is empty, a null verdict blocks; repeated rules count once, and where
they disagree block wins. An empty list allows everything. Repeated rows are judged each; other
columns are ignored.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.shared import slices

MAX_BYTES = 256 << 20
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path), A-Z of the host lowered; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = rest[:min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))]
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path


class DigestList:
    """The list's file: the number of keys, of path lengths and of label counts, those lengths and
    counts, the digests, each key's end in the strings, the verdicts (1: block), the strings."""

    def __init__(self, data):
        word = lambda at, n: np.frombuffer(data, "<u8", n, at)
        n, lengths, counts = word(0, 3).tolist()
        self.path_lengths, self.label_counts = word(24, lengths).tolist(), word(24 + 8 * lengths, counts).tolist()
        at = 24 + 8 * (lengths + counts)
        self.digests, at = word(at, n), at + 8 * n
        self.ends, at = word(at, n), at + 8 * n
        self.blocks, at = np.frombuffer(data, np.uint8, n, at), at + n
        self.strings, self.at = data, at

    @staticmethod
    def build(rules: list[tuple[str, str, bool]]) -> bytes:
        verdicts: dict[bytes, bool] = {}
        for host, path, block in rules:
            key = (host + path).encode()
            verdicts[key] = verdicts.get(key, False) or block
        keys = sorted(verdicts, key=lambda k: (xxhash.xxh64_intdigest(k), k))
        lengths = sorted({len(path) for _, path, _ in rules})      # in characters
        counts = sorted({host.count(".") + 1 for host, _, _ in rules})
        return b"".join((
            np.array([len(keys), len(lengths), len(counts), *lengths, *counts], "<u8").tobytes(),
            np.array([xxhash.xxh64_intdigest(k) for k in keys], "<u8").tobytes(),
            np.cumsum([len(k) for k in keys], dtype="<u8").tobytes(),
            np.array([verdicts[k] for k in keys], np.uint8).tobytes(), *keys))

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Number of each key in the list, -1 if it is not there."""
        digests = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        first = np.searchsorted(self.digests, digests, side="left")
        last = np.searchsorted(self.digests, digests, side="right")
        out = np.full(len(keys), -1, np.int64)
        for i in np.nonzero(last > first)[0].tolist():
            for j in range(int(first[i]), int(last[i])):          # more than one: digests collide
                if self.key(j) == keys[i]:
                    out[i] = j
        return out

    def key(self, j: int) -> bytes:
        begin = int(self.ends[j - 1]) if j else 0
        return bytes(self.strings[self.at + begin:self.at + int(self.ends[j])])

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str, bool] | None]:
        """The longest fitting rule of each (host, path) and whether it blocks."""
        keys, owner = [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            # only suffixes of as many labels as some rule's host has: no others can be in the list
            labels = host.count(".") + 1 if host else 0
            for n_labels in self.label_counts:
                if n_labels > labels:
                    break
                domain = host if n_labels == labels else ".".join(host.rsplit(".", n_labels)[1:])
                for n in self.path_lengths:
                    if n <= len(path):
                        keys.append((domain + path[:n]).encode())
                        owner.append((i, len(domain) + n, len(domain)))
        best: dict[int, tuple[int, int, int]] = {}
        found = self.find(keys) if keys else []
        for (i, *size), j in zip(owner, found, strict=True):
            if j >= 0 and (i not in best or tuple(size) > best[i][:2]):
                best[i] = (*size, int(j))
        return [(self.key(best[i][2]).decode(), bool(self.blocks[best[i][2]])) if i in best else None
                for i in range(len(hosts))]


_MAPPED: dict[str, DigestList] = {}


def mapped(name: str, shared) -> DigestList:
    """The broadcast list as a memory-mapped file, made once by each worker process."""
    if name not in _MAPPED:
        with tempfile.TemporaryFile() as f:
            f.write(shared.value)
            f.flush()
            _MAPPED[name] = DigestList(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    return _MAPPED[name]


def checked_list(rules: DataFrame, max_bytes: int = MAX_BYTES) -> bytes:
    """The list's file of ``rules(host, path, block)``, refused if it were over ``max_bytes``."""
    usable = rules.filter(F.col("host").isNotNull()).select(
        "host", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("block", F.lit(True)).alias("block"))
    usable = usable.filter((F.col("path") == "") | F.col("path").startswith("/")).distinct()
    size = usable.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 17)).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"the list takes {size} bytes, more than max_bytes = {max_bytes}")
    return DigestList.build([tuple(r) for r in usable.collect()])


def judge(pages: DataFrame, rules: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row's ``url``."""
    data = checked_list(rules, max_bytes)
    shared = pages.sparkSession.sparkContext.broadcast(data)
    name = xxhash.xxh64_hexdigest(data)
    source = pages.select("page_id", F.col("url").cast("string").alias("__url"))
    schema = T.StructType([source.schema["page_id"], *(T.StructField(c, T.StringType())
                                                       for c in ("host", "path", "rule", "verdict"))])

    def run(batches):
        listed = mapped(name, shared)
        for s in slices(batches, "__url"):
            split = [split_url(u) for u in s.column("__url").to_pylist()]
            hosts, paths = [h for h, _ in split], [p for _, p in split]
            found = listed.judge(hosts, paths)
            yield pa.RecordBatch.from_arrays(
                [s.column("page_id"), pa.array(hosts, pa.string()), pa.array(paths, pa.string()),
                 pa.array([r and r[0] for r in found], pa.string()),
                 pa.array(["block" if r and r[1] else "allow" for r in found], pa.string())], schema.names)

    return source.mapInArrow(run, schema)
