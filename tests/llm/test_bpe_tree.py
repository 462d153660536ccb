"""Ids of the tree reduction against the tiktoken library, and the round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from saltmarsh.llm import bpe

PIECES = ["a", "b", "ab", " ", "  ", "\n", "\r\n", "\t", "'", "r", "e", "s", "'ll", "'S", "1", "23", "é", "日本", "!", "?!", "the", " the", "don", "aaaa", "🙂", " ", "　", "\x85", "é", "<|endoftext|>", "\x00"]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load()


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


@pytest.mark.parametrize("part", [1, 2, 5, 2048])
def test_same_ids_wherever_a_text_is_cut(vocabulary, library, part):
    rng = random.Random(part)
    vocabulary.part, vocabulary.long = part, 2
    try:
        for _ in range(3000):
            text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40)))
            assert vocabulary.encode(text) == library.encode_ordinary(text), repr(text)
    finally:
        vocabulary.part, vocabulary.long = bpe.PART, bpe.LONG


def test_any_character_on_either_side_of_a_cut(vocabulary, library):
    vocabulary.part, vocabulary.long = 3, 2
    try:
        for code in [*range(0x3000), *range(0x3000, 0x110000, 97)]:
            if not 0xD800 <= code < 0xE000:
                c = chr(code)
                text = f"x{c}x  {c}{c} 1{c}1'{c}  {c}"
                assert vocabulary.encode(text) == library.encode_ordinary(text), hex(code)
    finally:
        vocabulary.part, vocabulary.long = bpe.PART, bpe.LONG


def test_two_neighbours_decide(vocabulary, library):
    """A sequence whose neighbours all agree is the encoding; one that isn't has neighbours that don't."""
    rng = random.Random(1)
    for _ in range(2000):
        word = "".join(rng.choice("abcdet") for _ in range(rng.randint(2, 14)))
        ids = library.encode_ordinary(word)
        assert all(vocabulary.agree(a, b) for a, b in zip(ids, ids[1:]))
        cut = rng.randint(1, len(word) - 1)
        other = library.encode_ordinary(word[:cut]) + library.encode_ordinary(word[cut:])
        assert (other == ids) == all(vocabulary.agree(a, b) for a, b in zip(other, other[1:]))


@pytest.mark.parametrize("text", ["a" * 20_001, " " * 9_001 + "x", "é" * 7_000, "!?" * 8_000, "'" * 999 + "re", "日" * 9_000, "".join(random.Random(2).choices("abcdefgh", k=40_000)), "word " * 30_000])
def test_long_matches_and_texts(vocabulary, library, text):
    ids = vocabulary.encode(text)
    assert ids == library.encode_ordinary(text)
    assert vocabulary.decode(ids) == text.encode()


def digest(data):
    return hashlib.sha256(data).hexdigest()


def test_rows(spark, library):
    texts = ["Hello  world's end\n\n", None, "", "a" * 3000, "Hello  world's end\n\n", " x" * 5000]
    rows = [(i if i != 3 else None, t, "n", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int")
    want = []
    for doc_id, text, _, _ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), digest(np.array(ids, dtype="<u4").tobytes()), digest((text or "").encode())))
    assert sorted(map(tuple, bpe.round_trip(docs).collect()), key=str) == sorted(want, key=str)
    assert bpe.round_trip(docs.limit(0)).collect() == []
    decoded = bpe.decode(bpe.encode(docs)).collect()
    assert sorted((r[0] is None, r[0] or 0, bytes(r[1]).decode()) for r in decoded) == sorted((i is None, i or 0, t or "") for i, t, _, _ in rows)


def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        assert (got[doc_id].n_tokens, got[doc_id].ids_sha256, got[doc_id].decoded_sha256) == (len(ids), digest(np.array(ids, dtype="<u4").tobytes()), digest((text or "").encode()))
