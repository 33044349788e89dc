"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint bit is set if it is set in over half of the XXH64 hashes (seed 42) of the
text's word shingles. Two fingerprints within ``radius`` bits share a variant that lies
within ``radius / 2`` bits of both: every distinct fingerprint emits all variants within half
the radius (for 2: itself and its 64 single-bit flips), the variants are shuffled, and
fingerprints that meet on a variant are linked. A variant's group holds distinct fingerprints
of one small ball (at most 65 for radius 2), and each is linked with the group's smallest, not
with all others: all members are within the radius of each other, so the components are the
same. Links are deduplicated and their bit distance is verified.

Documents with the same fingerprint are one node, so copies cost nothing beyond their row.

Defined cases: a null text has no words, like an empty one; no words give fingerprint zero,
linked like any other. Fewer words than a shingle: the whole sequence is the one shingle.
Repeated rows are returned each, with equal results (``keep_one`` keeps one of them). A null ``doc_id`` gets a component like
any row but is never a component's id; a component with null ids only has a null id. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rankloom.llm.components import smallest_reachable
from rankloom.llm.shared import Scratch, as_bytes, slices

SHINGLE, RADIUS, SEED, BITS = 3, 2, 42, 64


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one whole text (UTF-8)."""
    words = text.lower().split()          # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(shingle, len(words)) - 1:]
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    hashes = np.array([digest(view[a:b], SEED) for a, b in zip(begins[:n].tolist(), last.tolist(), strict=True)],
                      dtype="<u8")
    set_in = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_in += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and fp, the fingerprint as a signed long."""
    source = docs.select(*keep, F.col("text").alias("__text"))

    def run(batches):
        for s in slices(batches, "__text"):
            fp = np.array([fingerprint(t, shingle) for t in as_bytes(s.column("__text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([*[s.column(c) for c in keep], pa.array(fp.view(np.int64))], [*keep, "fp"])

    return source.mapInArrow(run, source.select(*keep, F.lit(0).cast("long").alias("fp")).schema)


def ball(radius: int) -> list[int]:
    """Masks of at most ``radius`` bits, as signed longs."""
    masks = [sum(1 << b for b in flip) for n in range(radius + 1) for flip in combinations(range(BITS), n)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b: verified links that join the fingerprints ``fp`` (unique rows) within an
    even ``radius`` into their components."""
    variants = distinct.select("fp", F.explode(F.array(*[F.lit(m) for m in ball(radius // 2)])).alias("mask"))
    met = variants.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    least = F.min("fp").over(W.partitionBy("variant"))
    return (met.select(least.alias("a"), F.col("fp").alias("b")).filter("a < b").distinct()
               .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))


def components(prints: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """(fp, root, component_id) of every fingerprint of ``prints(doc_id, fp)``: the smallest
    fingerprint and the smallest id of its component. Written; the steps' tables are dropped."""
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even: half of it is flipped on either side")
    distinct = scratch.write(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    linked = scratch.write(links(distinct.select("fp"), radius), "linked")
    roots = smallest_reachable(linked, scratch)
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root"))
    component = member.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = scratch.write(member.join(component, "root").select("fp", "root", "component_id"), "components")
    scratch.drop("linked")
    scratch.drop("distinct")
    return found


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``.

    The fingerprints are computed once and written (16 bytes a document); the links and every
    round of the component search are tables in the shared folder too."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.write(fingerprints(docs, shingle), "fingerprints")
    return prints.join(components(prints, radius, scratch).drop("root"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without all but one row of each component: the one with the smallest id
    (null last), and of a repeated id the one with the smallest fingerprint, then text hash. Rows
    are told apart by id and text, so a repeated id loses no text that is nobody's near copy."""
    scratch = Scratch(docs.sparkSession, "simhash")
    text_key = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    prints = scratch.write(fingerprints(docs.select("doc_id", "text", text_key.alias("key")), shingle, ("doc_id", "key")), "fingerprints")
    found = components(prints, radius, scratch)
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp", "key")
    of_print = prints.groupBy("fp").agg(F.min(first).alias("first"))     # copies are one row before they meet their component
    kept = scratch.write(of_print.join(found, "fp").groupBy("root").agg(F.min("first").alias("first"))
                         .select(F.col("first.doc_id").alias("id"), F.col("first.key").alias("key")), "kept")
    tagged = docs.select(F.struct(*docs.columns).alias("row"), text_key.alias("key"), F.col("doc_id").alias("id"))
    same = tagged["id"].eqNullSafe(kept["id"]) & (tagged["key"] == kept["key"])
    return tagged.join(kept, same, "left_semi").dropDuplicates(["id", "key"]).select("row.*")
