"""Divergence of sources, by hash-consed segment trees over term ids.

Within a language the kept terms are dealt by hash into blocks. In a block, terms get ids in order
of their total count, and every source is a segment tree over the ids: a leaf is a count, an inner
node a pair of nodes. Nodes are hash-consed over all sources of the block: equal subtrees are
one node with one number, which runs of rare terms make frequent. To compare two sources, both
trees are walked together from the roots: at each level the distinct node pairs reached are kept
once, at the leaves each distinct pair of counts is priced once, in exact integers, for both
directions, and sums go up again with each node pair's multiplicity resolved by its number. Block
sums are added up by (source, other source).

A block's task holds about BLOCK (source, term) counts, and one tile of at most SOURCES sources on
either side: more blocks or tiles, never larger ones, hold more terms or sources. Every source of
the language is in each of its blocks, also where it has none of the terms. A source's share of
all rows plays no part there: counts are summed with partial sums before any shuffle.

Defined cases: null text, language and source are read as empty. Terms are maximal runs of ASCII
letters and of characters above U+007F, A-Z lower-cased. Every row is a document of its own,
repeated ids included. A group or language without kept terms has no `term` rows and the value 0
in its `pair` rows. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rankloom.llm.shared import Scratch, as_bytes, slices
from rankloom.operators.topk import top_k_per_group
from rankloom.session import broadcast_below

MIN_DOCS, TOP_TERMS = 3, 200
UNIT = 1_000_000_000
BLOCK, SOURCES = 32_768, 64
NO_TERM = -1                # the count of a leaf that only fills up a tree
HELD_COUNTS = 400_000       # (group, term) counts a task holds before it hands them on
SAFE = (1 << 62) // UNIT    # counts below this are priced in 64-bit integers
#: Bytes of terms, A-Z lower-cased; all else is a space.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every group, and
    one row with an empty term for the group itself."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    source = docs.select(text("lang").cast("string").alias("lang"), text("source").cast("string").alias("source"),
                         F.col("text").alias("__text"))

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for s in slices(batches, "__text"):
            for lang, name, doc in zip(s.column("lang").to_pylist(), s.column("source").to_pylist(),
                                       as_bytes(s.column("__text")), strict=True):
                n, docs_with = held.setdefault((lang, name), (Counter(), Counter()))
                terms = terms_of(doc)
                n.update(terms)
                docs_with.update(set(terms))
                n[b""] += 1
            if sum(len(n) for n, _ in held.values()) > HELD_COUNTS:
                yield from _counted(held)
                held = {}
        yield from _counted(held)

    return source.mapInArrow(run, "lang string, source string, term binary, n long, docs long") \
        .repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _counted(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, name), (n, docs_with) in held.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(n), pa.string()), pa.array([name] * len(n), pa.string()), pa.array(list(n), pa.binary()),
             pa.array(list(n.values()), pa.int64()), pa.array([docs_with[t] for t in n], pa.int64())],
            ["lang", "source", "term", "n", "docs"])


def cons(level: np.ndarray) -> list[np.ndarray]:
    """Levels of the hash-consed trees of the rows of ``level`` (counts, a power of two of them):
    the leaves' counts, and for each level above the (left, right) pairs of its nodes. The last
    entry is each row's root."""
    values, ids = np.unique(level, return_inverse=True)
    out, ids = [values], ids.reshape(level.shape)
    while ids.shape[1] > 1:
        pairs = ids[:, 0::2].astype(np.int64) * (int(ids.max()) + 1) + ids[:, 1::2]
        nodes, up = np.unique(pairs, return_inverse=True)
        out.append(np.stack(np.divmod(nodes, int(ids.max()) + 1)))
        ids = up.reshape(pairs.shape)
    return [*out, ids[:, 0]]


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """p of every count: 1 + floor(UNIT * (count + 1) / (total + terms)), exact."""
    of = max(1, total + terms)            # 0 only if there is no term
    if len(counts) == 0 or counts.max() < SAFE:
        return 1 + UNIT * (counts.astype(np.int64) + 1) // of
    return np.array([1 + UNIT * (int(c) + 1) // of for c in counts], np.int64)


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def divergence(trees: list[np.ndarray], a: int, b: int, of_a: tuple[int, int], of_b: tuple[int, int]) -> tuple[int, int]:
    """Sums of the prices of a against b and b against a over the leaves of roots ``a`` and ``b``;
    ``of_a`` and ``of_b`` are (total, terms) of the groups."""
    wide, down, roots = [len(trees[0])] + [x.shape[1] for x in trees[1:-1]], [], trees[-1]
    here = (np.array([roots[a]]), np.array([roots[b]]))
    for level in range(len(wide) - 1, 0, -1):
        left, right = (trees[level][side] for side in (0, 1))
        keys = np.concatenate((left[here[0]] * wide[level - 1] + left[here[1]], right[here[0]] * wide[level - 1] + right[here[1]]))
        pairs, at = np.unique(keys, return_inverse=True)
        down.append(at.reshape(2, -1))
        here = np.divmod(pairs, wide[level - 1])
    counts = [trees[0][x] for x in here]
    p, q = shares(counts[0], *of_a), shares(counts[1], *of_b)
    sums = np.stack((price(p, q), price(q, p))) * (counts[0] != NO_TERM)
    for at in reversed(down):
        sums = sums[:, at[0]] + sums[:, at[1]]
    return int(sums[0, 0]), int(sums[1, 0])


def matrix(rows: pd.DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of ``names`` (rows) over the block's terms in order of their total, the terms, and
    their totals."""
    total = rows.drop_duplicates("term").sort_values(["all", "term"], kind="stable")
    terms = total["term"].to_numpy()
    place, row = pd.Index(terms), pd.Index(names)
    out = np.zeros((len(names), len(terms)), np.int64)
    out[row.get_indexer(rows["source"]), place.get_indexer(rows["term"])] = rows["n"].to_numpy()
    return out, terms, total["all"].to_numpy()


def filled(counts: np.ndarray) -> np.ndarray:
    """``counts`` with columns of NO_TERM up to a power of two."""
    wide = 1 << max(0, counts.shape[1] - 1).bit_length()
    return np.pad(counts, ((0, 0), (0, wide - counts.shape[1])), constant_values=NO_TERM)


def pairs(counts: np.ndarray, heads: pd.DataFrame, terms: int, absent: int, across: bool) -> Iterator[tuple[str, str, int]]:
    """(source, item, value): sums over the block of all ordered pairs of ``heads(source, tile, total)``,
    whose counts are the rows of ``counts``; ``absent`` more terms of the block occur in none of them.
    Only pairs ``across`` the tiles, if so said."""
    names, tile, totals = (heads[c].tolist() for c in ("source", "tile", "total"))
    trees = cons(filled(counts))
    for i in range(len(names)):
        for j in range(i + 1, len(names)):
            if not (across and tile[i] == tile[j]):
                there, back = divergence(trees, i, j, (totals[i], terms), (totals[j], terms))
                p, q = (shares(np.zeros(1, np.int64), totals[x], terms) for x in (i, j))
                yield names[i], names[j], there + absent * int(price(p, q)[0])
                yield names[j], names[i], back + absent * int(price(q, p)[0])


def raised(counts: np.ndarray, all_: np.ndarray, names: np.ndarray, of_source: tuple[int, int], of_lang: tuple[int, int],
           most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` highest-priced terms whose share in the source passes that in the language,
    with their prices; each distinct pair of counts is priced once."""
    here = np.flatnonzero(counts > 0)
    found, at = np.unique(np.stack((counts[here], all_[here])), axis=1, return_inverse=True)
    p, q = shares(found[0], *of_source), shares(found[1], *of_lang)
    value, over = price(p, q)[at.ravel()], (p > q)[at.ravel()]
    value, here = value[over], here[over]
    best = np.lexsort((names[here], -value))[:most] if len(here) else here
    return names[here[best]], value[best]


def job(rows: pd.DataFrame, top: int) -> pd.DataFrame:
    """(source, part, item, value) of one block and pair of tiles. ``rows`` hold (ta, tb, source, tile,
    term, n, all, total, terms, lang_total, block_terms); one with a null term for each source, with
    its total and the number of the block's terms."""
    heads = rows[rows["term"].isna()].sort_values("source", kind="stable")
    terms, lang_total = int(heads["terms"].iloc[0]), int(heads["lang_total"].iloc[0])
    counts, names, all_ = matrix(rows[rows["term"].notna()], heads["source"].tolist())
    absent = int(heads["block_terms"].iloc[0]) - len(names)
    across = bool(rows["ta"].iloc[0] != rows["tb"].iloc[0])
    out = [(a, "pair", b.encode(), value) for a, b, value in pairs(counts, heads, terms, absent, across)]
    if not across:
        for i, (source, total) in enumerate(zip(heads["source"], heads["total"], strict=True)):
            found = raised(counts[i], all_, names, (int(total), terms), (lang_total, terms), top)
            out += [(source, "term", t, int(v)) for t, v in zip(*found, strict=True)]
    return pd.DataFrame(out, columns=["source", "part", "item", "value"])


def kept_counts(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n, all, first): the terms in at least ``min_docs`` documents of their
    language, with the language's occurrences and a mark at its first source; and one row with an
    empty term for each group. One shuffle, by language and term, serves the sums and the window."""
    counts = count_terms(docs)
    term = W.partitionBy("lang", "term")
    seen = counts.withColumns({"all": F.sum("n").over(term), "in": F.sum("docs").over(term), "first": F.min("source").over(term)})
    return seen.filter((F.col("in") >= min_docs) | (F.col("term") == b"")).select(
        "lang", "source", "term", "n", "all", (F.col("first") == F.col("source")).alias("first"))


def tile_of() -> Column:
    return F.pmod(F.xxhash64("source", F.lit("tile")), F.col("tiles")).cast("int")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, block: int = BLOCK, sources: int = SOURCES) -> DataFrame:
    """lang, source, part, item, value, rank for every group of ``docs``."""
    scratch = Scratch(docs.sparkSession, "divergence")
    counted = scratch.write(kept_counts(docs, min_docs), "counts")
    is_term = F.col("term") != b""
    groups = scratch.write(counted.groupBy("lang", "source").agg(
        F.coalesce(F.sum(F.when(is_term, F.col("n"))), F.lit(0)).alias("total"), F.count(F.when(is_term, 1)).alias("entries"),
        F.count(F.when(is_term & F.col("first"), 1)).alias("firsts")), "groups")
    whole = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("int")
    langs = scratch.write(groups.groupBy("lang").agg(
        F.sum("total").alias("lang_total"), F.sum("firsts").alias("terms"), whole(F.sum("entries"), block).alias("blocks"),
        whole(F.count(F.lit(1)), sources).alias("tiles")), "langs")
    # one row for each language, sent to the counts while its size, known from the table, allows it
    langs = broadcast_below(langs, langs.agg(F.coalesce(F.sum(F.octet_length("lang") + F.lit(64)), F.lit(0))).first()[0])
    zero = F.lit(0).cast("long")
    entries = counted.filter(is_term).join(langs, "lang").withColumns(
        {"total": zero, "block_terms": zero, "block": F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")})
    in_block = entries.filter("first").groupBy("lang", "block").agg(F.count(F.lit(1)).alias("block_terms"))
    heads = groups.join(langs, "lang").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(
        in_block, ["lang", "block"], "left").withColumns(
        {"term": F.lit(None).cast("binary"), "n": zero, "all": zero, "block_terms": F.coalesce("block_terms", zero)})
    columns = ["lang", "block", "ta", "tb", "source", "tile", "term", "n", "all", "total", "terms", "lang_total", "block_terms"]

    def dealt(rows: DataFrame) -> DataFrame:
        placed = rows.withColumn("tile", tile_of()).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        return placed.withColumns({"ta": F.least("tile", "u"), "tb": F.greatest("tile", "u")}).select(*columns)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return job(rows, top).assign(lang=key[0])

    found = scratch.write(dealt(heads).unionByName(dealt(entries)).groupBy("lang", "block", "ta", "tb").applyInPandas(
        run, "source string, part string, item binary, value long, lang string"), "found")
    values = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = [F.desc("value"), F.asc("item")]
    ranked = values.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(*order)))
    terms = top_k_per_group(found.filter("part = 'term'"), ["lang", "source"], order, top)
    columns = ["lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank"]
    return ranked.select(*columns).unionByName(terms.select(*columns))
