"""Packing tokenized documents into fixed-size training sequences by harmonic classes.

A document of length l is in class k = capacity // l (its reciprocal capacity); a bin of the class takes
k documents, whole. What its documents leave free waits for filling: documents longer than the capacity,
which must be cut anyway, first fill the bins that wait, then make full sequences, and their rest goes to its
class. Where more than ``WAITING`` bins wait, the next document fills them too, the bin with the largest
space that it can fill first, so that one whose length equals a space stays whole.

Each worker (task) keeps its own bins, so that nothing is shuffled and any task can be run again alone. What
a task leaves in open and waiting bins, a bounded number of tokens, is joined and cut at the capacity and,
at the very end, at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import ArrowBatches, arrow_batch, ready

CAPACITY = 2048
#: Bins of a worker that wait for filling; at the capacity of 2048, 64 of them hold under 1 MB.
WAITING = 64
END_ID = 1
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """The vocabulary of a byte-level ``tokenizers`` file: texts -> lists of ids.

    Where the merges of such a file are in the order of their ids and its split is ``PATTERN``, its ids are
    ranks, by which the tiktoken library finds the same ids several times faster; texts with a special
    token's string go through ``tokenizers`` itself. Other files go through ``tokenizers`` altogether.
    """
    import json

    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec.get("added_tokens", [])]

    def by_tokenizers(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]

    if not ranked(spec):
        return by_tokenizers
    shown = byte_alphabet()
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={bytes(shown[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        return [by_tokenizers([t])[0] if any(s in t for s in special) else fast.encode_ordinary(t) for t in texts]

    return encode


def ranked(spec: dict) -> bool:
    """Whether a ``tokenizers`` file is plain byte-level BPE whose merges are in the order of their ids."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if not plain or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    ids = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    return all(x < y for x, y in zip([-1, *ids], ids, strict=False))


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write the 256 bytes."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Packer:
    """The bins of one worker, as lists of pieces (doc_id, start, ids, tokens of the document). ``out`` has the finished rows."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY):
        self.capacity, self.next, self.out = capacity, first_sequence, []
        self.open: dict[int, list[tuple]] = {}
        self.waiting: list[tuple[int, list[tuple]]] = []  # (free, pieces), by what is free

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while self.waiting and (total - start > self.capacity or len(self.waiting) > WAITING and total > start):
            left = total - start
            at = max(0, bisect(self.waiting, left, key=lambda w: w[0]) - 1)  # the largest space that it fills, or else the smallest
            free, pieces = self.waiting.pop(at)
            take = min(free, left)
            pieces.append((doc_id, start, ids[start : start + take], total))
            start += take
            self.wait(free - take, pieces)
        while total - start >= self.capacity:
            self.emit([(doc_id, start, ids[start : start + self.capacity], total)])
            start += self.capacity
        if start < total:
            k = self.capacity // (total - start)
            pieces = self.open.setdefault(k, [])
            pieces.append((doc_id, start, ids[start:], total))
            if len(pieces) == k:
                self.wait(self.capacity - sum(len(p[2]) for p in pieces), self.open.pop(k))

    def wait(self, free: int, pieces: list[tuple]) -> None:
        if free:
            insort(self.waiting, (free, pieces), key=lambda w: w[0])
        else:
            self.emit(pieces)

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def finish(self) -> None:
        """Join what the bins hold and cut it to sequences that need no padding."""
        left = [p for pieces in [*(w[1] for w in self.waiting), *(self.open[k] for k in sorted(self.open))] for p in pieces]
        self.open, self.waiting = {}, []
        total = sum(len(p[2]) for p in left)
        room = self.target(total)
        filled: list[tuple] = []
        for doc_id, start, ids, n in left:
            while len(ids):
                take = min(room, len(ids))
                filled.append((doc_id, start, ids[:take], n))
                start, ids, room, total = start + take, ids[take:], room - take, total - take
                if room == 0:
                    self.emit(filled)
                    filled, room = [], self.target(total)

    def target(self, total: int) -> int:
        return self.capacity if total >= self.capacity else 1 << (total.bit_length() - 1) if total else 0


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of packed sequences of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts are the end id alone; a null doc_id stays null; repeated rows are packed
    once each; an empty table gives no rows. Sequence ids are unique within the result. The
    capacity must be a power of two.
    """
    if capacity < 2 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    path = tokenizer or default_tokenizer()
    ready(docs.sparkSession)

    schema = pa.schema([(c, pa.int64()) for c in COLUMNS])

    def run(batches: ArrowBatches) -> ArrowBatches:
        encode = encoder(path)
        packer = Packer(TaskContext.get().partitionId() << 40, capacity)

        def done() -> pa.RecordBatch:
            rows, packer.out = packer.out, []
            return arrow_batch(rows, schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, np.array([*encode([text.as_py() or ""])[0], END_ID], "<u4"))
            yield done()
        packer.finish()
        yield done()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ", ".join(f"{c} long" for c in COLUMNS))
