"""Ids against the tiktoken library and a plain merge; decoding against a whole decode."""

import hashlib
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import PATTERN

from parallax.llm import bpe


@pytest.fixture(scope="module")
def own():
    return bpe.Transducer(bpe.read_ranks(bpe.default_ranks()))


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_ids_equal_the_librarys(own, library):
    rng = random.Random(5)
    tokens = list(own.ranks)
    texts = ["", " ", "\n\n a", "don't", "<|endoftext|>", "a" * 5000, "ab" * 3000, "  \t\x85\xa0x", "é́ßẞ", "१२३ 三 \U0001f600‍"]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += [b"".join(rng.choice(tokens) for _ in range(rng.randrange(12))).decode("utf-8", "replace") for _ in range(600)]
    texts += ["".join(chr(rng.choice([rng.randrange(256), rng.randrange(0xD000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(rng.randrange(40))) for _ in range(600)]
    assert [own.encode(t).tolist() for t in texts] == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text_equals_the_librarys(own, library, text):
    ids = own.encode(text).tolist()
    assert ids == library.encode_ordinary(text)
    assert "".join(bpe.decoded([[i] for i in ids], own.bytes_of)) == text


def test_pairs_equal_plain_merges(own):
    rng = random.Random(2)
    ids = list(own.bytes_of)
    for at in range(4000):
        u, v = (rng.choice(ids[: 2000 if at % 2 else None]) for _ in range(2))
        both = [own.bytes_of[u], own.bytes_of[v]]
        assert own.may_meet(u, v) == (bpe.merged(b"".join(both), own.ranks) == both)


def test_long_pieces_are_streamed_with_little_memory(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "WINDOW", 64)
    rng = random.Random(3)
    text = "".join(rng.choice("etaoin") for _ in range(20_000))
    runs = list(own.piece(text.encode()))
    assert len(runs) > 100 and [i for r in runs for i in r] == library.encode_ordinary(text)


def test_caches_may_be_dropped_at_any_time(library, own, monkeypatch):
    for name, most in (("STEPS", 7), ("PAIRS", 5), ("PIECES", 2)):
        monkeypatch.setattr(bpe, name, most)
    small = bpe.Transducer(own.ranks)
    text = "The quick brown fox, in 1999, jumped over the lazy dog's back. " * 3
    assert small.encode(text).tolist() == library.encode_ordinary(text) and len(small.steps) <= 7


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(max_size=6), max_size=12))
def test_streamed_utf8_equals_a_whole_decode(parts):
    stream = bpe.Utf8()
    assert "".join([stream.feed(p) for p in parts]) + stream.close() == b"".join(parts).decode("utf-8", "replace")


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=30))
def test_no_character_is_cut(text):
    stream = bpe.Utf8()
    out = [stream.feed(bytes([b])) for b in text.encode()]
    assert "�" not in "".join(out).replace("�", "", text.count("�")) and "".join(out) == text and stream.close() == ""


def test_ranks_without_single_bytes_are_refused():
    with pytest.raises(ValueError, match="single bytes"):
        bpe.Transducer({b"a": 0})


def test_columns_nulls_and_empty_tables(spark):
    rows = [(1, "hello world", 5, "x"), (2, None, 6, None), (3, "", 7, "y"), (1, "hello world", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS int, source string")
    found = bpe.encode(docs)
    assert found.columns == ["doc_id", "text", "source", "ids"]
    back = bpe.decode(found).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["ids"], r["decoded"]) for r in back] == [(1, [31373, 995], "hello world")] * 2 + [(2, [], ""), (3, [], "")]
    nothing = hashlib.sha256(b"").hexdigest()
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.digests(found).collect()}
    assert got[1] == (2, hashlib.sha256(b"31373 995").hexdigest(), hashlib.sha256(b"hello world").hexdigest()) and got[2] == got[3] == (0, nothing, nothing)
    assert bpe.decode(bpe.encode(docs.limit(0))).count() == 0 == bpe.digests(bpe.encode(docs.limit(0))).count()


def test_null_and_unknown_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, [31373, 99999999, 995]), (3, [163])], "k long, ids array<int>")
    assert [r["text"] for r in bpe.decode(rows, out="text").orderBy("k").collect()] == [None, "hello� world", "�"]


def test_digests_over_many_chunks(spark, library, monkeypatch):
    text = "naïve café — 東京 \U0001f600 " * 30_000
    (r,) = bpe.digests(bpe.encode(spark.createDataFrame([("k", text)], "doc_id string, text string"))).collect()
    ids = library.encode_ordinary(text)
    assert len(ids) > 2 * bpe.CHUNK and r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
