import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from terrastrata.llm import bpe

from .cases import LONG, TEXTS, no_documents, odd_documents

PATH = P.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = bpe.Vocabulary.load(open(PATH, "rb").read())
CODEC = bpe.Codec(VOCABULARY, P.PATTERN)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
ENCODING = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    ids = CODEC.encode(text)
    assert ids == ENCODING.encode_ordinary(text)
    assert VOCABULARY.decode(ids).decode() == text


@pytest.mark.parametrize("text", ["a" * 3000, " " * 700 + "x", "=" * 999, "\n\n \n", LONG, "<|endoftext|>", "it'll we've'll", "0123456789" * 50])
def test_hard_texts(text):
    assert CODEC.encode(text) == ENCODING.encode_ordinary(text)


def test_pieces_can_be_appended_to_and_edited():
    r = random.Random(3)
    letters = [b"a", b"th", b"ing", b"e", b"er", b"on", "é".encode(), b"z", b"0"]
    for _ in range(150):
        piece = bpe.Piece(VOCABULARY, b"".join(r.choices(letters, k=r.randint(0, 60))))
        piece.append(b"".join(r.choices(letters, k=r.randint(0, 5))))
        assert piece.table == VOCABULARY.table(piece.data)
        a = r.randint(0, len(piece.data))
        b = r.randint(a, len(piece.data))
        piece.replace(a, b, b"".join(r.choices(letters, k=r.randint(0, 4))))
        assert piece.table == VOCABULARY.table(piece.data)
        assert list(piece.ids) == list(VOCABULARY.encode_piece(piece.data))


def test_an_edit_touches_few_entries():
    piece = bpe.Piece(VOCABULARY, b"banana" * 400)
    assert piece.replace(600, 603, b"xyz") < 300
    assert piece.table == VOCABULARY.table(piece.data)


def test_texts_can_be_appended_to():
    r = random.Random(5)
    parts = ["it", "'", "ll", " ", "  ", "\n", "we", "'v", "e", "!", "9", "é", " the", "日"]
    for _ in range(400):
        a, b = ("".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(2))
        assert CODEC.append(a, CODEC.encode(a), b) == ENCODING.encode_ordinary(a + b)


def test_digests_of_odd_rows(spark):
    got = bpe.digests(odd_documents(spark), PATH, P.PATTERN).collect()
    want = []
    for row in TEXTS:
        ids = ENCODING.encode_ordinary(row[1] or "")
        want.append((row[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((row[1] or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.digests(no_documents(spark), PATH, P.PATTERN).collect() == []


def test_round_trip_of_tables(spark):
    docs = odd_documents(spark)
    got = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH)
    assert got.columns == [*docs.columns, "ids", "decoded"]
    for row in got.select("text", "decoded").collect():
        assert bytes(row["decoded"]).decode() == (row["text"] or "")


def test_chunks_do_not_change_digests(monkeypatch):
    before = CODEC.digest(LONG)
    monkeypatch.setattr(bpe, "CHUNK", 100)
    assert CODEC.digest(LONG) == before


def test_unreachable_tokens_are_left_out():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"xyz": 257}
    tiny = bpe.Vocabulary(ranks)
    own = tiktoken.Encoding("tiny", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    for text in ("xyz", "axyz", "abxyzab", "ab"):
        assert list(tiny.encode_piece(text.encode())) == own.encode_ordinary(text)
