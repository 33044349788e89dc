"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Each task collects the distinct pattern matches (words) of its documents and encodes them all
together: an inverted index from each adjacent token pair to its positions in the words is
built once, then the merges are applied in rank order, each at all its positions, and only the
pairs of the touched neighbours are indexed anew. A word's ids are then looked up for each of
its occurrences. Memory is bounded: at most HELD_BYTES of text and CACHE_ENTRIES distinct words
(plus those of one slice) are held by a task; the result does not depend on these limits.

As in the tiktoken library, a word that is a token as a whole gets that token, and equal ranks
merge from the left. If a merge makes a pair of lower rank than its own (a vocabulary whose
tokens were not built from earlier ones), the word is encoded again by itself, one merge at a
time, so ids are the library's for any rank file.

Defined cases: a null text is empty; an empty text has no ids and the hashes of no bytes.
Repeated rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.shared import RaggedCache, byte_lengths, slices

HELD_BYTES = 24 << 20
HELD_WORDS = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Merges:
    """The merge rules that a rank file implies: a pair merges to the token of its joined bytes.
    A pair is one number, ``left << 32 | right``."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        rules = {ranks[t[:i]] << 32 | ranks[t[i:]]: rank for t, rank in ranks.items()
                 for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pairs = np.array(sorted(rules), np.int64)
        self.makes = np.array([rules[p] for p in self.pairs.tolist()] + [-1], np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair merges to, -1 for none."""
        pairs = left << 32 | right
        at = np.searchsorted(self.pairs, pairs)
        found = self.pairs[np.minimum(at, len(self.pairs) - 1)] == pairs if len(self.pairs) else at < 0
        return np.where(found, self.makes[at], -1)

    def alone(self, word: bytes) -> list[int]:
        """One word, one merge at a time: the lowest rank, the leftmost first."""
        ids = self.first[np.frombuffer(word, np.uint8)]
        while len(ids) > 1:
            made = self.merged(ids[:-1], ids[1:])
            if (made < 0).all():
                break
            i = int(np.where(made < 0, np.iinfo(np.int64).max, made).argmin())
            ids = np.concatenate((ids[:i], made[i:i + 1], ids[i + 2:]))
        return ids.tolist()

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids), by replaying the merges over all words."""
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int64, len(words))
        divided = (whole < 0) & np.fromiter(map(bool, words), bool, len(words))
        split = np.nonzero(divided)[0].tolist()
        sizes = np.fromiter((len(words[i]) for i in split), np.int64, len(split))
        ends = np.cumsum(sizes)
        tokens = self.first[np.frombuffer(b"".join(words[i] for i in split), np.uint8)]
        odd = self._apply(tokens, ends)
        alive = tokens >= 0
        lengths = (whole >= 0).astype(np.int64)
        lengths[divided] = np.add.reduceat(alive, ends - sizes, dtype=np.int64) if split else 0
        from_split = np.repeat(divided, lengths)
        flat = np.empty(len(from_split), np.int64)
        flat[from_split], flat[~from_split] = tokens[alive], whole[whole >= 0]
        if not len(odd):
            return lengths, flat
        rows = np.split(flat, np.cumsum(lengths)[:-1])
        for n in np.unique(np.searchsorted(ends, odd, side="right")).tolist():
            rows[split[n]] = np.array(self.alone(words[split[n]]), np.int64)
        return np.array([len(r) for r in rows], np.int64), np.concatenate(rows)

    def _apply(self, tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """All merges in rank order, in place (-1: merged into the left); ``ends`` of the words.
        Returns positions of words where a merge made a pair of lower rank than its own."""
        n = len(tokens)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends[:-1]] = -1
        where: dict[int, list[np.ndarray]] = {}       # token -> positions of the pairs that make it
        queue: list[int] = []

        def index(positions: np.ndarray, made: np.ndarray) -> None:
            some = made >= 0
            positions, made = positions[some], made[some]
            order = np.argsort(made, kind="stable")
            positions, made = positions[order], made[order]
            cuts = np.nonzero(made[1:] != made[:-1])[0] + 1
            begins = np.concatenate(([0], cuts)).tolist()
            for a, b in zip(begins, [*begins[1:], len(made)], strict=True):
                if a == b:
                    continue
                token = int(made[a])
                if token in where:
                    where[token].append(positions[a:b])
                else:
                    where[token] = [positions[a:b]]
                    heapq.heappush(queue, token)

        start = np.nonzero(after >= 0)[0]
        index(start, self.merged(tokens[start], tokens[start + 1]))
        odd = [np.zeros(0, np.int64)]
        while queue:
            rank = heapq.heappop(queue)
            at = where.pop(rank)
            p = np.unique(np.concatenate(at))
            q = after[p]
            there = (tokens[p] >= 0) & (q >= 0)
            p, q = p[there], q[there]
            there = self.merged(tokens[p], tokens[q]) == rank     # else a neighbour has merged before
            p, q = p[there], q[there]
            if not len(p):
                continue
            follows = q[:-1] == p[1:]
            if follows.any():                                     # a run, as in aaaa: every other one
                number = np.arange(len(p))
                first = np.maximum.accumulate(np.where(np.concatenate(([True], ~follows)), number, 0))
                there = (number - first) % 2 == 0
                p, q = p[there], q[there]
            right = after[q]
            inner = right >= 0
            pi, ri = p[inner], right[inner]
            passing = self.merged(np.full(len(ri), rank), tokens[ri])
            tokens[p], tokens[q] = rank, -1
            after[p] = right
            before[ri] = pi
            left = before[p]
            li = left[left >= 0]
            positions = np.concatenate((pi, li))
            made = np.concatenate((self.merged(np.full(len(ri), rank), tokens[ri]),
                                   self.merged(tokens[li], np.full(len(li), rank))))
            odd += [pi[(passing >= 0) & (passing < rank)], positions[(made >= 0) & (made < rank)]]
            if len(made):
                index(positions, made)
        return np.concatenate(odd)


@cache
def merges_of(path: str) -> Merges:
    """One rule table per worker process."""
    return Merges(read_ranks(path))


class Encoder:
    """Ids of whole texts, many at a time; ``ready`` batches come once their words are encoded."""

    def __init__(self, path: str, pattern: str):
        self.merges = merges_of(path)
        self.find = regex.compile(pattern).findall
        self.cache = RaggedCache(self._resolve, np.uint32)

    def _resolve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.merges.replay([w.encode() for w in words])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.merges.bytes_of.__getitem__, ids.tolist()))

    def encode(self, parts: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """(part, ids of all its texts, each text's bounds in them)."""
        waiting, held = [], 0
        for part in parts:
            texts = part.column(text).to_pylist()
            numbers, bounds = self.cache.number([self.find(t) if t else () for t in texts])
            waiting.append((part, numbers, bounds))
            held += int(byte_lengths(part.column(text)).sum())
            if held >= HELD_BYTES or len(self.cache.index.new) >= HELD_WORDS:
                yield from self._ready(waiting)
                waiting, held = [], 0
        yield from self._ready(waiting)

    def _ready(self, waiting):
        self.cache.settle()
        for part, numbers, bounds in waiting:
            yield part, *self.cache.gather(numbers, bounds)
        if len(self.cache.index) > self.cache.limit:
            self.cache.clear()


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (as bytes: little-endian unsigned 32-bit) and decoded (bytes) per row."""
    source = docs.select("doc_id", F.col("text").alias("__text"))

    def run(batches):
        encoder = Encoder(ranks_path, pattern)
        for part, ids, bounds in encoder.encode(slices(batches, "__text"), "__text"):
            each = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([x.astype("<u4").tobytes() for x in each], pa.binary()),
                 pa.array([encoder.decode(x) for x in each], pa.binary())], ["doc_id", "ids", "decoded"])

    return source.mapInArrow(run, source.select("doc_id", F.lit(b"").alias("ids"), F.lit(b"").alias("decoded")).schema)


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 digests of ids and decoded bytes."""
    coded = encode_decode(docs, ranks_path, pattern)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
