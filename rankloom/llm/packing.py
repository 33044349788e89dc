"""Hierarchical packing of documents into training sequences of several lengths.

A document's tokens are cut into full windows of the longest tier; the rest is routed to the
shortest tier that holds it. Tiers are packed from long to short: every piece routed to a tier
opens a window of that tier, and the gap it leaves is filled with the longest pieces of shorter
tiers that fit, the last of them cut where it must. A cut-off rest goes back to its tier. So
every window is full, and as tier lengths are powers of two none is padded. The pieces left
over at the end of a task, less than one window, fill windows of ever shorter powers of two.
Sequences
are then dealt, longest first, to the step group with the fewest tokens so far, so the groups
of a packing round hold about STEP_TOKENS each.

Each task tokenises and packs its own documents in one pass, GROUP_TOKENS at a time, without a
shuffle; memory is bounded by one round. Sequence ids carry the task's partition number, so
they are unique and the same when a task runs again.

Defined cases: a null text is empty; an empty document is its end mark alone. Repeated rows
and null ids are packed like any row; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.shared import RaggedCache, as_bytes, slices

TIERS = (2048, 1024, 512, 256)
END_ID = 1
GROUP_TOKENS = 1 << 20
STEP_TOKENS = 1 << 15
Piece = tuple[int, int, int]          # document number, start, length


#: The split pattern of the vocabulary's tokenizer, and the printable characters of
#: the bytes that its byte-level step does not keep as they are.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
KEPT_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: chr(b) for b in KEPT_BYTES} | {
    b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in KEPT_BYTES)}
CACHED_CHUNKS, CACHED_WORDS = 300_000, 400_000      # that a task remembers


class Tokens:
    """Ids of whole texts. White space separates tokens of this vocabulary and is dropped, so
    each distinct chunk between ASCII white space is tokenised once.

    A chunk of Latin letters, digits and ASCII signs is normalised by lower-casing and split
    here, and only its distinct words go to the tokenizer's model; every other chunk goes through
    the whole tokenizer. The two ways agree (tests compare them). A text that holds the string of
    an added token goes through the whole tokenizer in one piece, which gives that token's id."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        added = [re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(added), re.I).search if added else lambda text: None
        self.model = self.tokenizer.model
        self.plain = regex.compile("[\x21-\x7e\u00c0-\u024f]+").fullmatch
        self.split = regex.compile(SPLIT).findall
        self.words: dict[str, bytes] = {}                   # ids as little-endian unsigned 32-bit
        self.ascii_words: dict[bytes, bytes] = {}
        self.signs = {ord(c): self._ids(c) for c in ",.;:!?"}
        self.cache = RaggedCache(self._resolve, np.uint32, CACHED_CHUNKS)

    def _ids(self, word: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(word)], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() else "".join(map(BYTE_CHARS.__getitem__, word.encode()))
        found = self.words[word] = self._ids(shown)
        return found

    def _letters(self, word: bytes) -> bytes:
        found = self.ascii_words[word] = self._ids(word.decode())
        return found

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _resolve(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) + len(self.ascii_words) > CACHED_WORDS:
            self.words.clear()
            self.ascii_words.clear()
        known, letters, sign, rows = self.words.get, self.ascii_words.get, self.signs.get, []
        for chunk in chunks:
            if chunk.isalpha():                                      # ASCII letters only
                word = chunk.lower()
                rows.append(letters(word) or self._letters(word))
            elif chunk[:-1].isalpha() and (end := sign(chunk[-1])):  # and one sign after them
                word = chunk[:-1].lower()
                rows.append((letters(word) or self._letters(word)) + end)
            elif self.plain(text := chunk.decode("utf-8", "replace")):
                rows.append(b"".join([known(w) or self._word(w) for w in self.split(text.lower())]))
            else:
                rows.append(self._whole(text).tobytes())
        lengths = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
        return lengths, np.frombuffer(b"".join(rows), "<u4")

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        # lower case of ASCII is the normaliser's; other texts are left to it
        whole = {i: self._whole(t.decode("utf-8", "replace")) for i, t in enumerate(texts) if self.added(t)}
        flat, bounds = self.cache.rows([[] if i in whole else (t.lower() if t.isascii() else t).split()
                                        for i, t in enumerate(texts)])
        end = np.array([END_ID], np.uint32)
        return [np.concatenate((whole[i] if i in whole else flat[a:b], end))
                for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]


class Packer:
    """Pieces waiting for a window, by length, with a bit mask of the lengths that are there."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        if any(t & (t - 1) for t in tiers) or sorted(tiers, reverse=True) != list(tiers):
            raise ValueError("tiers are powers of two, from long to short")
        self.tiers = tiers
        self.waiting: list[list[Piece]] = [[] for _ in range(tiers[0] + 1)]
        self.lengths = 0

    def add(self, piece: Piece) -> None:
        self.waiting[piece[2]].append(piece)
        self.lengths |= 1 << piece[2]

    def _take(self, length: int) -> Piece:
        piece = self.waiting[length].pop()
        if not self.waiting[length]:
            self.lengths &= ~(1 << length)
        return piece

    def _fill(self, window: list[Piece], gap: int) -> int:
        """Fill a window's gap; what is left of it once no piece waits."""
        while gap and self.lengths:
            fit = self.lengths & ((2 << gap) - 1)
            if fit:
                piece = self._take(fit.bit_length() - 1)
            else:
                longer = self.lengths >> (gap + 1)
                doc, start, length = self._take(gap + (longer & -longer).bit_length())
                piece = (doc, start, gap)
                self.add((doc, start + gap, length - gap))
            window.append(piece)
            gap -= piece[2]
        return gap

    def windows(self) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
        """Full windows (length, pieces) of all waiting pieces, and the pieces left over."""
        full, left = [], []
        for tier, shorter in zip(self.tiers, (*self.tiers[1:], 0), strict=True):
            while routed := self.lengths >> (shorter + 1) & ((1 << (tier - shorter)) - 1):
                window = [self._take(shorter + routed.bit_length())]
                if self._fill(window, tier - window[0][2]):
                    left = window
                else:
                    full.append((tier, window))
        return full, left

    def rest(self, pieces: list[Piece]) -> list[tuple[int, list[Piece]]]:
        """Full windows of leftover pieces, less than the longest tier: one for each power of two
        in their total."""
        out, pieces = [], pieces[::-1]
        total = sum(p[2] for p in pieces)
        for size in (1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1):
            window, gap = [], size
            while gap:
                doc, start, length = pieces.pop()
                n = min(length, gap)
                window.append((doc, start, n))
                gap -= n
                if n < length:
                    pieces.append((doc, start + n, length - n))
            out.append((size, window))
        return out


def step_groups(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group for each sequence: the longest first, each to the group with the fewest tokens."""
    loads = [(0, g) for g in range(max(1, -(-sum(sizes) // step_tokens)))]
    groups = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g = heapq.heappop(loads)
        groups[i] = g
        heapq.heappush(loads, (load + sizes[i], g))
    return groups


def pack(docs: DataFrame, tokens: Callable[[], Tokens], tiers: tuple[int, ...] = TIERS,
         group_tokens: int = GROUP_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, tier (the sequence's length) and step_group."""
    source = docs.select("doc_id", F.col("text").alias("__text"))
    schema = T.StructType([source.schema["doc_id"]] + [
        T.StructField(n, t) for n, t in (
            ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()),
            ("sequence_id", T.LongType()), ("offset", T.LongType()), ("tier", T.IntegerType()),
            ("step_group", T.LongType()))])
    arrow = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, longest = tokens(), tiers[0]
        base = TaskContext.get().partitionId() << 40
        made = {"sequence": base, "group": base}
        ids_kind = None

        def emit(windows: list[tuple[int, list[Piece]]]) -> Iterator[pa.RecordBatch]:
            if not windows:
                return
            group = step_groups([n for n, _ in windows], step_tokens)
            rows = []
            for (n, pieces), g in zip(windows, group, strict=True):
                offset = 0
                for doc, start, length in pieces:
                    key, ids, first, whole = held[doc]
                    rows.append((key, start, length, ids[start - first:start - first + length].tobytes(), whole,
                                 made["sequence"], offset, n, made["group"] + g))
                    offset += length
                made["sequence"] += 1
            made["group"] += max(group) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [ids_kind, *arrow], strict=True)], schema.names)

        packer, held, number, waiting = Packer(tiers), {}, 0, 0
        windows: list[tuple[int, list[Piece]]] = []
        for part in slices(batches, "__text"):
            ids_kind = part.schema.field("doc_id").type
            for key, ids in zip(part.column("doc_id").to_pylist(), make.of(as_bytes(part.column("__text"))), strict=True):
                n, number = len(ids), number + 1
                held[number] = (key, ids, 0, n)
                whole = n - n % longest
                windows += [(longest, [(number, at, longest)]) for at in range(0, whole, longest)]
                if n > whole:
                    packer.add((number, whole, n - whole))
                waiting += n
                if waiting >= group_tokens:
                    full, left = packer.windows()
                    yield from emit(windows + full)
                    # what is left over waits for the next round, with its own tokens only
                    held = {d: (held[d][0], held[d][1][s - held[d][2]:s - held[d][2] + m].copy(), s, held[d][3])
                            for d, s, m in left}
                    windows, waiting = [], 0
                    for piece in left:
                        packer.add(piece)
        full, left = packer.windows()
        yield from emit(windows + full + packer.rest(left))

    return source.mapInArrow(run, schema)


def packed_digests(docs: DataFrame, tokenizer_path: str, **parameters) -> DataFrame:
    """The pieces of ``pack`` with the CRC-32 of their ids instead of the ids."""
    return pack(docs, lambda: Tokens(tokenizer_path), **parameters).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
