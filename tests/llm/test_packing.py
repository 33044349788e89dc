import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rankloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def test_tokens_equal_the_tokenizer(reference):
    rng = random.Random(2)
    letters = "abST'sréÉÜßİıŁ1 2,.#!?-_|<>\n ́字 \x1c \U0001f600"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", " ", "<|endoftext|> a<|startoftext|>", "é É É", "ΑΣ ΑΣΑ", "'S'll"] + [f"a{chr(c)}b" for c in range(1, 0x500)]
    tokens = packing.Tokens(PATH)
    for at in range(0, len(texts), 500):
        part = texts[at:at + 500]
        for text, ids in zip(part, tokens.of([t.encode() for t in part]), strict=True):
            assert ids.tolist() == reference(text), text


def verify(rows, texts, reference):
    """Pieces cover every document once, sequences are gapless and almost without padding."""
    full = {d: np.array(reference(t), "<u4") for d, t in texts.items()}
    by_doc, by_seq = {}, {}
    for r in rows:
        ids = full[r.doc_id]
        assert r.doc_tokens == len(ids) and r.length > 0
        assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == full.keys()
    for d, pieces in by_doc.items():
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == len(full[d])
    sizes = []
    for pieces in by_seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        sizes.append(at)
    assert max(sizes) <= 2048
    return sum(2048 - n for n in sizes if n & (n - 1)), sum(sizes)


def test_defined_cases(docs_of, reference):
    rows = [(1, None, None, None), (2, "", None, None), (3, "word " * 9000, None, None), (None, "a b", None, None),
            (4, "one two three", "en", "s")]
    got = packing.packed_digests(docs_of(rows), PATH).collect()
    padding, _ = verify(got, {d: t for d, t, *_ in rows}, reference)
    assert padding == 0
    assert packing.packed_digests(docs_of([]), PATH).collect() == []
    twice = packing.packed_digests(docs_of([(1, "a b", None, None)] * 2), PATH).collect()
    assert sum(r.length for r in twice) == 6 and {r.doc_tokens for r in twice} == {3}


def test_given_rows_in_several_tasks_and_rounds(table, reference):
    docs = table("documents").repartition(2, "doc_id")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = packing.packed_digests(docs, PATH, group_tokens=20_000).collect()
    padding, total = verify(got, texts, reference)
    assert padding == 0 and total == sum(r.doc_tokens for r in got if r.start == 0)
    steps = {}
    for r in got:
        steps[r.step_group] = steps.get(r.step_group, 0) + r.length
    assert max(steps.values()) <= packing.STEP_TOKENS + 2048


def test_every_window_but_the_last_is_full():
    rng = random.Random(1)
    for _ in range(200):
        p, lengths = packing.Packer(), [rng.randint(1, 2048) for _ in range(rng.randint(0, 30))]
        for i, n in enumerate(lengths):
            p.add((i, 0, n))
        full, left = p.windows()
        assert all(sum(x[2] for x in pieces) == n and n in packing.TIERS for n, pieces in full)
        rest = p.rest(left)
        assert sum(n for n, _ in full + rest) == sum(lengths)
        assert all(sum(x[2] for x in pieces) == n and n & (n - 1) == 0 for n, pieces in rest)


def test_tiers_are_checked():
    with pytest.raises(ValueError):
        packing.Packer((2000, 100))


def test_step_groups_are_balanced():
    groups = packing.step_groups([2048] * 30 + [256] * 17 + [1024] * 9, 1 << 14)
    loads = {}
    for n, g in zip([2048] * 30 + [256] * 17 + [1024] * 9, groups, strict=True):
        loads[g] = loads.get(g, 0) + n
    assert max(loads.values()) - min(loads.values()) <= 2048


def test_added_tokens_in_a_text_get_their_ids():
    plain = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>Y<|endoftext|>é", "É <|ENDOFTEXT|> a", "a b", "<|endoftext", "ab"]
    for text, ids in zip(texts, packing.Tokens(PATH).of([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == [*plain.encode(text, add_special_tokens=False).ids, packing.END_ID], text
    assert packing.Tokens(PATH).of([b"a <|endoftext|> b"])[0].tolist()[1] == 49407
