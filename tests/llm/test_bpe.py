import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from rankloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def encode(encoder, texts):
    numbers, bounds = encoder.cache.number([encoder.find(t) for t in texts])
    encoder.cache.settle()
    ids, bounds = encoder.cache.gather(numbers, bounds)
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_ids_are_the_librarys_for_all_code_points(library):
    encoder = bpe.Encoder(PATH, public_tokenizers.PATTERN)
    points = [chr(c) for c in [*range(0x3100), *range(0xFB00, 0x10500), *range(0x1F300, 0x1F700)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b 1{c}{c}2 .{c}. {c} \n{c}" for c in points]
    assert encode(encoder, texts) == [library.encode_ordinary(t) for t in texts]


def test_ids_are_the_librarys_for_random_texts(library):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab'sé \n\t#1   　字\U0001f600Tre") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", "a" * 3000, "ab" * 2000, "'" * 999, " " * 1000, "x" * 200_000]
    got = encode(bpe.Encoder(PATH, public_tokenizers.PATTERN), texts)
    assert got == [library.encode_ordinary(t) for t in texts]


def test_any_rank_file():
    """Vocabularies whose tokens were not built from earlier ones."""
    rng = random.Random(5)
    for _ in range(100):
        extra = list({bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 4))) for _ in range(12)})
        rng.shuffle(extra)
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(extra)}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        words = list({"".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(40)})
        lengths, flat = bpe.Merges(ranks).replay([w.encode() for w in words])
        rows = np.split(flat, np.cumsum(lengths)[:-1])
        assert [r.tolist() for r in rows] == [own.encode_ordinary(w) for w in words]


def test_limits_do_not_change_the_result(docs_of, table, library, monkeypatch):
    docs = table("documents").limit(40)
    want = {r.doc_id: library.encode_ordinary(r.text) for r in docs.collect()}
    got = bpe.encode_decode(docs, PATH, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got} == want
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.decoded.decode() == texts[r.doc_id] for r in got)


def test_defined_cases(docs_of, library):
    rows = [(1, None, None, None), (2, "", "en", "s"), (None, "a b", None, None), (3, "many words " * 20000, None, None),
            (3, "x", None, None), (3, "x", None, None)]
    got = bpe.digests(docs_of(rows), PATH, public_tokenizers.PATTERN).collect()
    for r, (doc, text, *_) in zip(got, rows, strict=True):
        ids = library.encode_ordinary(text or "")
        assert (r.doc_id, r.n_tokens) == (doc, len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.digests(docs_of([]), PATH, public_tokenizers.PATTERN).collect() == []
