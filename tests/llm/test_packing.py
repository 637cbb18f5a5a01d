import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallax.llm.packing import CAPACITY, WAITING, Packer, default_tokenizer, encoder, pack


def padded(n):
    return n if n & (n - 1) == 0 else CAPACITY


def test_bins_hold_as_many_as_their_class_and_whole_documents():
    packer = Packer(0)
    lengths = [700, 600, 1500, 683, 1000, 1024, 400]  # classes 2, 3, 1, 2, 2, 2, 5
    for i, n in enumerate(lengths):
        packer.add(i, np.arange(n, dtype="<u4"))
    assert {k: [len(p[2]) for p in v] for k, v in packer.open.items()} == {3: [600], 5: [400]}
    assert sorted([len(p[2]) for p in pieces] for _, pieces in packer.waiting) == [[700, 683], [1000, 1024], [1500]]
    packer.add(9, np.arange(2100, dtype="<u4"))  # too long for a bin: fills the largest space first
    assert [(r[0], r[1], r[2]) for r in packer.out] == [(0, 0, 700), (3, 0, 683), (9, 0, 665)]
    assert [len(p[2]) for p in packer.waiting[-1][1]] == [1435]  # what then fits is whole again


@pytest.mark.parametrize("seed", [1, 2])
def test_each_id_is_in_one_piece_and_memory_is_bounded(seed):
    rng = np.random.default_rng(seed)
    packer, lengths = Packer(0), [*rng.integers(1, 3000, 400), 200_000, *rng.integers(1, 60, 400)]
    for i, n in enumerate(lengths):
        packer.add(i, np.arange(n, dtype="<u4"))
        assert len(packer.waiting) <= WAITING + 1
    packer.finish()
    pieces = {}
    for doc, start, length, *_ in packer.out:
        pieces.setdefault(doc, []).append((start, length))
    for i, n in enumerate(lengths):
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at and length > 0
            at += length
        assert at == n
    assert sum(map(len, pieces.values())) <= sum(lengths) / CAPACITY + 1.5 * len(lengths)


def test_encoder_equals_tokenizers():
    from tokenizers import Tokenizer

    texts = ["", "a", "don't  stop\n\n now", "x<|endoftext|>y", "é" * 50, "  ", "12 345", "a" * 5000, "你好\U0001f600"]
    plain = Tokenizer.from_file(default_tokenizer())
    assert encoder(default_tokenizer())(texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_sequences_have_little_padding():
    rng = np.random.default_rng(0)
    packer = Packer(7)
    lengths = np.r_[rng.integers(1, 4000, 300), [1] * 50]
    for i, n in enumerate(lengths):
        packer.add(i, np.arange(n, dtype="<u4"))
    packer.finish()
    used = {}
    for _, _, length, _, _, seq, offset in packer.out:
        assert used.get(seq, 0) == offset
        used[seq] = offset + length
    assert max(used.values()) <= CAPACITY and sum(used.values()) == lengths.sum()
    assert sum(map(padded, used.values())) <= 1.02 * lengths.sum()


def test_ids_beyond_doubles_and_a_very_long_text(spark):
    long = "".join(f"word{i % 977} " for i in range(250_000)) + "z" * 200_000
    docs = spark.createDataFrame([(2**53 + 1, "a"), (2**53, "b"), (2**63 - 1, long), (None, "c")], "doc_id long, text string").coalesce(1)
    rows = pack(docs).collect()
    assert {r["doc_id"] for r in rows} == {2**53 + 1, 2**53, 2**63 - 1, None}
    n = len(encoder(default_tokenizer())([long])[0]) + 1
    assert sum(r["length"] for r in rows if r["doc_id"] == 2**63 - 1) == n and all(r["doc_tokens"] == n for r in rows if r["doc_id"] == 2**63 - 1)


def test_round_trip_of_pieces(spark):
    docs = spark.createDataFrame(
        [(1, "one two three " * 900, "x"), (2, None, "y"), (3, "", "z"), (None, "no id", None), (4, "same", None), (4, "same", None)],
        "doc_id long, text string, length string",
    )
    rows = pack(docs).collect()
    encode = encoder(default_tokenizer())
    ids = {1: [*encode(["one two three " * 900])[0], 1], 2: [1], 3: [1], None: [*encode(["no id"])[0], 1], 4: [*encode(["same"])[0], 1]}
    for r in rows:
        own = ids[r["doc_id"]]
        part = own[r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(own) and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    for doc_id, times in ((1, 1), (2, 1), (3, 1), (None, 1), (4, 2)):
        assert sum(r["length"] for r in rows if r["doc_id"] == doc_id) == times * len(ids[doc_id])
    by_seq = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert by_seq.get(r["sequence_id"], 0) == r["offset"]
        by_seq[r["sequence_id"]] = r["offset"] + r["length"]
    assert pack(docs.filter(F.lit(False))).count() == 0
