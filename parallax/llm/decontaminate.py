"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of words, hashed to ``BUCKETS``, are counted over all documents.
2. Benchmark items are cut to passages of ``WINDOW`` words at most; a randomised singular value
   decomposition of their TF-IDF matrix, whose products are summed over partitions, gives a latent
   space of ``RANK`` dimensions.
3. All windows of the documents' words, half overlapping, that have a word of the benchmark are projected;
   passages at a latent cosine of ``COSINE`` are candidates. Weights fall where many documents hold an item, so
   the windows with a run of ``ANSWER_WORDS`` words that ends an item, or that few other items share with one of
   its passages, are candidates at any cosine: no exact copy depends on weights.
4. The longest common subsequence of the item's words and the words around a window decides: a
   share of ``SURE`` of the item, or of ``LIKELY`` when the item's answer, its last words, is there too.
   Candidates of an item are taken nearest first, until one is confirmed or all have failed.

Words are lower-cased and ASCII signs are dropped, so decorated copies are found.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import MIX_A, fresh, null_to_empty, ready, stored, sum_blocks

BUCKETS = 1 << 16
RANK = 128
OVERSAMPLE = 16
WINDOW = 48
SHORT_WINDOW = 12
COSINE = 0.45
#: Documents that are taken to exist beside the input, so that words of a few documents are not common.
PRIOR = 20
#: Words with a lower idf, in more than about three of five documents, have no part in latent vectors,
#: but in those of passages and windows that have no other words.
COMMON = 1.0
#: Words are searched in runs of about so many.
CHUNK = 1 << 18
SURE, LIKELY = 0.7, 0.5
ANSWER_WORDS = 6
#: Slots of the table of items' words, by which words are told apart that share a bucket.
SLOTS = 1 << 22
#: Items that a worker holds, about 45 MB; a larger benchmark is searched in blocks, a pass over the documents for each.
BLOCK_ITEMS = 20_000
BLOCK = 1024
SIGNS = string.punctuation.encode()


def words(text: str) -> np.ndarray:
    return np.array([*map(xxhash.xxh3_64_intdigest, text.lower().encode("utf-8", "replace").translate(None, SIGNS).split())], np.uint64)


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def slots(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(20)) & np.uint64(SLOTS - 1)).astype(np.int64)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """idf by bucket, from all rows of ``docs`` (text); a quarter of a megabyte, whatever the input."""
    spark = ready(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(BUCKETS + 1, np.float32)
        for pdf in batches:
            for text in null_to_empty(pdf["text"]):
                seen[np.unique(buckets(words(text)))] += 1
                seen[BUCKETS] += 1
        if seen[BUCKETS]:
            parts = [seen[a : a + BLOCK] for a in range(0, BUCKETS + 1, BLOCK)]
            yield pd.DataFrame({"block": range(len(parts)), "body": [p.tobytes() for p in parts]})

    sums = sum_blocks(docs.select(F.col("text").cast("string")).mapInPandas(count, "block int, body binary"), min(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if not sums:
        return np.ones(BUCKETS, np.float32)
    seen = np.concatenate([sums[i] for i in range(len(sums))])
    return np.log1p((seen[BUCKETS] + PRIOR) / (seen[:BUCKETS] + 0.5)).astype(np.float32)


def passages(hashes: np.ndarray) -> list[np.ndarray]:
    """An item's words in even parts of ``WINDOW`` at most."""
    return np.array_split(hashes, max(1, -(-len(hashes) // WINDOW))) if len(hashes) else []


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * MIX_A + hashes[j : j + n]
    return out


def telling_runs(items: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By size, the hashes of runs, sorted, and their items: each item's last run, and of each passage the one that the fewest items share."""
    sizes = [min(ANSWER_WORDS, *map(len, passages(h))) for h in items]
    out = {}
    for size in sorted(set(sizes)):
        own = [i for i, s in enumerate(sizes) if s == size]
        seen, shared = np.unique(np.concatenate([np.unique(run_hashes(items[i], size)) for i in own]), return_counts=True)
        found = set()
        for i in own:
            found.add((int(run_hashes(items[i], size)[-1]), i))
            for part in passages(items[i]):
                runs = run_hashes(part, size)
                found.add((int(runs[np.argmin(shared[np.searchsorted(seen, runs)])]), i))
        pairs = sorted(found)
        out[size] = (np.array([h for h, _ in pairs], np.uint64), np.array([i for _, i in pairs], np.int64))
    return out


def weighed(hashes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.unique(buckets(hashes), return_counts=True)
    return at, (1 + np.log(n)) * idf[at]


@dataclass
class Latent:
    """A block of items in latent space. ``basis`` has a row for each bucket with items' words, ``row`` finds it;
    ``known`` flags the slots of items' words."""

    idf: np.ndarray
    known: np.ndarray
    row: np.ndarray
    basis: np.ndarray
    passages: np.ndarray
    item: np.ndarray
    short: np.ndarray
    items: list[tuple[int, np.ndarray]]
    masks: dict[int, dict[int, int]] = field(default_factory=dict)
    runs: dict[int, tuple[np.ndarray, np.ndarray]] = field(init=False)

    def __post_init__(self):
        self.runs = telling_runs([h for _, h in self.items])

    def said(self, hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, items) of the items' telling runs; ``text`` has the text of each word."""
        where, which = [], []
        for size, (runs, item) in self.runs.items():
            h = run_hashes(hashes, size)
            flags = np.zeros(SLOTS, bool)
            flags[slots(runs)] = True
            at = np.flatnonzero(flags[slots(h)] & (text[: len(h)] == text[len(text) - len(h) :]))
            lo, hi = (np.searchsorted(runs, h[at], side=x) for x in ("left", "right"))
            n = hi - lo
            where.append(np.repeat(at, n))
            which.append(item[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())])
        return (np.concatenate(where), np.concatenate(which)) if where else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def search(self, texts: list[str]) -> list[list[tuple[int, float, float, bool]]]:
        """(item_id, cosine, shared part of the item, whether its answer is there) of the items in each text."""
        hashed = [words(t) for t in texts]
        near: list[dict[int, list[tuple[float, int, int]]]] = [{} for _ in texts]
        first, held = 0, 0
        for i, h in enumerate(hashed):
            held += len(h)
            if held >= CHUNK or i == len(hashed) - 1:
                for size, wanted in ((WINDOW, ~self.short), (SHORT_WINDOW, self.short)):
                    if held and wanted.any():
                        self.near(hashed[first : i + 1], size, wanted, near[first : i + 1])
                first, held = i + 1, 0
        return [[x for at, windows in sorted(b.items()) if (x := self.first(h, at, windows))] for h, b in zip(hashed, near, strict=True)]

    def first(self, hashes: np.ndarray, at: int, windows: list[tuple[float, int, int]]):
        """The item as confirmed around the nearest window (cosine, start, end) that does so; None after all failed."""
        n = len(self.items[at][1])
        runs: list[tuple[int, int]] = []
        for _, start, end in sorted(windows, key=lambda w: w[1]):  # what a run of windows does not hold, none of them holds
            if runs and start - n <= runs[-1][1] + n:
                runs[-1] = (runs[-1][0], max(runs[-1][1], end))
            else:
                runs.append((start, end))
        runs = [(start, end) for start, end in runs if self.common(at, hashes[max(0, start - n) : end + n], LIKELY * n) >= LIKELY * n]
        for w in sorted(windows, key=lambda w: (-w[0], w[1])) if runs else ():
            if any(start <= w[1] < end for start, end in runs) and (x := self.confirmed(hashes, at, *w)):
                return x
        return None

    def confirmed(self, hashes: np.ndarray, at: int, cosine: float, start: int, end: int):
        item_id, item = self.items[at]
        region = hashes[max(0, start - len(item)) : end + len(item)]
        shared = self.common(at, region) / len(item)
        if shared < LIKELY:
            return None
        there = contains(region, item[-min(ANSWER_WORDS, len(item)) :])
        return (item_id, cosine, shared, there) if shared >= SURE or there else None

    def near(self, hashed: list[np.ndarray], size: int, wanted: np.ndarray, near: list[dict]) -> None:
        """All windows over the cosine or with a telling run, for each item of each text."""
        n = np.array([len(h) for h in hashed])
        hashes, offsets, step = np.concatenate(hashed), np.concatenate([[0], np.cumsum(n)[:-1]]), size // 2
        at = buckets(hashes)
        weight = self.idf[at]
        known = self.known[slots(hashes)]
        rare = known & (weight >= COMMON)
        windows = np.where(n > 0, np.maximum(0, -(-(n - size) // step)) + 1, 0)
        text = np.repeat(np.arange(len(n)), windows)
        k = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
        starts = np.minimum(k * step, np.maximum(0, n[text] - size))
        a, b = offsets[text] + starts, offsets[text] + np.minimum(starts + size, n[text])
        columns = np.flatnonzero(wanted)
        latent, owner = self.passages[columns], self.item[columns]
        place, said = self.said(hashes, np.repeat(np.arange(len(n)), n))
        mine = np.isin(said, owner)
        place, said = place[mine], said[mine]
        inside = np.repeat(np.arange(len(n)), n)[place]
        first = np.cumsum(windows) - windows
        held = first[inside] + np.minimum((place - offsets[inside]) // step, windows[inside] - 1)
        pairs = np.unique(np.stack([held, said]), axis=1)  # windows and items with a telling run
        rows, ends = self.row[at], np.cumsum(n)
        of_rare, of_known = (np.concatenate([[0], np.cumsum(x)]) for x in (rare, known))
        some = of_rare[b] > of_rare[a]
        block = max(64, (1 << 20) // max(1, len(columns)))
        for of, ours, these in ((of_rare, rare, np.flatnonzero(some)), (of_known, known, np.flatnonzero(~some & (of_known[b] > of_known[a])))):
            kept = np.flatnonzero(ours)
            for i in range(0, len(these), block):
                w = these[i : i + block]
                told = pairs[:, (pairs[0] >= w[0]) & (pairs[0] <= w[-1])]
                second = a[w] + step < b[w]
                halves, half = np.unique(np.concatenate([a[w], a[w[second]] + step]), return_inverse=True)
                lo, hi = of[halves], of[np.minimum(halves + step, ends[np.searchsorted(ends, halves, side="right")])]
                sums = self.summed(kept, lo, hi, rows, weight)
                z = sums[half[: len(w)]]
                z[second] += sums[half[len(w) :]]
                z /= np.maximum(1e-9, np.linalg.norm(z, axis=1, keepdims=True))
                cosines = z @ latent.T
                taken = cosines >= COSINE
                row_of = dict(zip(w.tolist(), range(len(w)), strict=True))
                for x, item in told.T.tolist():
                    if x in row_of:
                        own = np.flatnonzero(owner == item)
                        taken[row_of[x], own[np.argmax(cosines[row_of[x], own])]] = True
                for x, p in zip(*np.nonzero(taken), strict=True):
                    d, item, c = int(text[w[x]]), int(owner[p]), float(cosines[x, p])
                    near[d].setdefault(item, []).append((c, int(starts[w[x]]), int(b[w[x]] - offsets[d])))

    def summed(self, kept: np.ndarray, lo: np.ndarray, hi: np.ndarray, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Sums of the weighed rows of the basis, for each range of ``kept`` words."""
        counts = hi - lo
        order = np.argsort(-counts, kind="stable")
        lo, counts = lo[order], counts[order]
        z = np.zeros((len(lo), self.basis.shape[1]), np.float32)
        for j in range(int(counts[0])):  # the j-th word of all ranges that have so many
            more = int(np.searchsorted(-counts, -j, side="left"))
            at_j = kept[lo[:more] + j]
            z[:more] += self.basis[rows[at_j]] * weight[at_j, None]
        out = np.empty_like(z)
        out[order] = z
        return out

    def common(self, at: int, region: np.ndarray, least: float = 0) -> int:
        """Length of the longest common subsequence, a bit for each word of the item; 0 if too few words are the item's for ``least``."""
        if at not in self.masks:
            mask: dict[int, int] = {}
            for i, w in enumerate(self.items[at][1].tolist()):
                mask[w] = mask.get(w, 0) | 1 << i
            self.masks[at] = mask
        mask, n = self.masks[at], len(self.items[at][1])
        full = (1 << n) - 1
        v = full
        said = [mask[w] for w in region.tolist() if w in mask]
        if len(said) < least:
            return 0
        for m in said:
            u = v & m
            v = (v + u | v - u) & full
        return n - v.bit_count()


def contains(region: np.ndarray, part: np.ndarray) -> bool:
    starts = np.flatnonzero(region[: max(0, len(region) - len(part) + 1)] == part[0])
    return any((region[a : a + len(part)] == part).all() for a in starts)


def latent_space(items: DataFrame, idf: np.ndarray) -> Latent:
    """Randomised SVD of the TF-IDF passages of ``items`` (item_id, text): range finding with one power iteration."""
    spark = ready(items.sparkSession)
    width = RANK + OVERSAMPLE
    shared = spark.sparkContext.broadcast(idf)
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.filter("item_id IS NOT NULL AND text IS NOT NULL")

    def products(q, gram: bool):
        """Sums of A'(A q) by blocks of buckets, or of (A q)'(A q)."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = np.random.default_rng(17).normal(size=(BUCKETS, width)).astype(np.float32) if q is None else None
            row, basis = (None, None) if q is None else q.value
            sums = np.zeros((width, width) if gram else (BUCKETS, width), np.float32)
            for pdf in batches:
                for text in null_to_empty(pdf["text"]):
                    for part in passages(words(text)):
                        at, weight = weighed(part, shared.value)
                        weight = weight / max(1e-9, np.linalg.norm(weight))
                        y = weight @ (m[at] if m is not None else basis[row[at]])
                        if gram:
                            sums += np.outer(y, y)
                        else:
                            sums[at] += np.outer(weight, y)
            blocks = [sums] if gram else np.split(sums, BUCKETS // BLOCK)
            used = [i for i, s in enumerate(blocks) if s.any()]
            yield pd.DataFrame({"block": used, "body": [blocks[i].astype(np.float32).tobytes() for i in used]})

        got = sum_blocks(rows.mapInPandas(run, "block int, body binary"), 8)
        if gram:
            return got[0].reshape(width, width) if got else np.eye(width)
        full = np.zeros((BUCKETS, width), np.float32)
        for i, body in got.items():
            full[i * BLOCK : (i + 1) * BLOCK] = body.reshape(BLOCK, width)
        return full

    def basis_of(full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        used = np.flatnonzero(full.any(axis=1))
        row = np.full(BUCKETS, -1, np.int32)
        row[used] = np.arange(len(used))
        q, _ = np.linalg.qr(full[used].astype(np.float64)) if len(used) else (np.zeros((0, width)), None)
        if q.shape[1] < width:
            q = np.concatenate([q, np.zeros((len(q), width - q.shape[1]))], axis=1)
        return row, q.astype(np.float32)

    q = basis_of(products(None, False))
    q = basis_of(products(spark.sparkContext.broadcast(q), False))
    _, vectors = np.linalg.eigh(products(spark.sparkContext.broadcast(q), True).astype(np.float64))
    row, basis = q[0], (q[1] @ vectors[:, ::-1][:, :RANK]).astype(np.float32)

    known = sorted({(r["item_id"], r["text"]) for r in rows.collect()})
    kept, owner, latent, short = [], [], [], []
    for item_id, text in known:
        hashes = words(text)
        if not len(hashes):
            continue
        for part in passages(hashes):
            at, weight = weighed(part, idf)
            rare = weight >= COMMON
            z = weight[rare] @ basis[row[at[rare]]] if rare.any() else weight @ basis[row[at]]
            owner.append(len(kept))
            latent.append(z / max(1e-9, np.linalg.norm(z)))
            short.append(len(part) <= SHORT_WINDOW)
        kept.append((item_id, hashes))
    flags = np.zeros(SLOTS, bool)
    for _, hashes in kept:
        flags[slots(hashes)] = True
    return Latent(idf, flags, row, basis, np.array(latent, np.float32).reshape(len(latent), RANK), np.array(owner, np.int64), np.array(short, bool), kept)


LEAKS = "array<struct<item_id:bigint,cosine:double,shared:double,answered:boolean>>"


def annotate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with ``leaks``: the items (item_id, cosine, shared, answered) found in ``text``.

    Null and empty texts have none; items with a null id or without words are never found. Repeated rows
    and other columns stay; a column ``leaks`` is replaced. Without documents or items nothing is found.
    """
    spark = ready(docs.sparkSession)
    docs = docs.drop("leaks")
    idf = inverse_frequencies(docs)
    blocks = max(1, -(-benchmark.count() // BLOCK_ITEMS))
    if blocks == 1:
        return docs.withColumn("leaks", searched(spark.sparkContext.broadcast(latent_space(benchmark, idf))).cast(LEAKS))
    key = fresh(docs, "_key")  # leaks depend on texts alone
    named = docs.withColumn(key, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    found: list[DataFrame] = []
    for i in range(blocks):  # a pass for each block: workers hold one
        block = spark.sparkContext.broadcast(latent_space(benchmark.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i), idf))
        leaks = named.select(key, searched(block).cast(LEAKS).alias("leaks")).filter(F.size("leaks") > 0)
        found.append(stored(leaks.groupBy(key).agg(F.first("leaks").alias("leaks")), "leaks"))
        block.destroy()
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    joined = every.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    return named.join(joined, key, "left").withColumn("leaks", F.coalesce("leaks", F.array().cast(LEAKS))).drop(key)


def searched(block) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("item_id", "cosine", "shared", "answered"), x, strict=True)) for x in found] for found in block.value.search(null_to_empty(texts))], dtype=object)

    return F.pandas_udf(run, LEAKS)(F.col("text").cast("string"))
