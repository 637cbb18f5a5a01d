"""Lempel-Ziv phrase fingerprints.

A text is parsed left to right into dictionary phrases: each phrase is the longest one seen before
plus one character. The set of phrases, hashed, gives a signature of ``BINS`` minimum hashes (one
permutation: a hash's leading bits choose its bin, the bin keeps its smallest hash). The share of
equal bins estimates the Jaccard likeness of two phrase sets, which is high where one text
would help to compress the other. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import ArrowBatches, arrow_batch, ready

BINS = 128
SHIFT = np.uint64(57)
NONE = np.uint64(2**64 - 1)
#: Rows of a range in ``in_ranges``, keys that are drawn for each, and the most ranges: at three times 10^10
#: rows a range then has 28,000 rows, the bounds have 16 MB and the drawn keys 64 MB.
RANGE_ROWS = 2000
DRAWN = 4
MAX_RANGES = 1 << 20
LOWEST = -(2**63)


def phrases(text: str, seen: set[str], begun: str = "") -> tuple[str, list[str]]:
    """Go on parsing: adds to ``seen``, returns the phrase begun and the new phrases."""
    new = []
    for c in text:
        begun += c
        if begun not in seen:
            seen.add(begun)
            new.append(begun)
            begun = ""
    return begun, new


def minima(new: list[str]) -> np.ndarray:
    bins = np.full(BINS, NONE)
    if new:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))
        np.minimum.at(bins, (hashes >> SHIFT).astype(np.int64), hashes & np.uint64(2**57 - 1))
    return bins


def shown(bins: np.ndarray) -> str:
    """Sixteen bits a bin, in hexadecimal; ffff is an empty bin."""
    short = np.where(bins == NONE, 0xFFFF, np.minimum(bins & np.uint64(0xFFFF), np.uint64(0xFFFE)))
    return short.astype(">u2").tobytes().hex()


def fingerprint(text: str) -> str:
    return shown(minima(phrases(text, set())[1]))


def likeness(a: str, b: str) -> float:
    """Share of equal bins among those that either has; 1 for two texts without phrases."""
    x, y = (np.frombuffer(bytes.fromhex(s), ">u2") for s in (a, b))
    used = (x != 0xFFFF) | (y != 0xFFFF)
    return float((x == y)[used].mean()) if used.any() else 1.0


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many first characters of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def fingerprints(text: str, following: str) -> tuple[str, str, str]:
    """The edited text and the fingerprints of text and edited text; their common start is parsed once."""
    cut = len(text) // 3
    kept, own = text[: len(text) - cut], text[len(text) - cut :]
    seen: set[str] = set()
    begun, new = phrases(kept, seen)
    head = minima(new)
    other = seen.copy()
    changed = following[:cut]
    a = np.minimum(head, minima(phrases(own, seen, begun)[1]))
    b = np.minimum(head, minima(phrases(changed, other, begun)[1]))
    return kept + changed, shown(a), shown(b)


KEY = np.dtype([("order", np.int64), ("hash", np.int64)])


def in_ranges(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) dealt to ranges of (doc_id downwards, hash of text), each sorted and followed by the
    first row of the next range (``_ahead``), the last range by the first row of all.

    Bounds are keys of rows, drawn from all of them, so the first row of a range is known by its key. Only rows equal in
    id and text share a key. Null ids count as the lowest.
    """
    spark = ready(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = keyed.withColumn("_order", F.bitwise_not(F.coalesce("doc_id", F.lit(LOWEST))))  # ascends where ids descend
    ahead = F.xxhash64("text")
    lowest, n = keyed.agg(F.min("_order"), F.count(F.lit(1))).first()
    ranges = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    first = keyed.filter(F.col("_order") == F.lit(lowest)).agg(F.min(ahead)).first()[0] if n else 0
    drawn = keyed.sample(min(1.0, DRAWN * ranges / max(1, n)), seed=23).select("_order", ahead.alias("_hash")).toPandas() if ranges > 1 else pd.DataFrame({"_order": [], "_hash": []})
    keys = np.sort(np.rec.fromarrays([drawn["_order"].to_numpy(np.int64), drawn["_hash"].to_numpy(np.int64)], dtype=KEY))
    bounds = np.unique(np.concatenate([np.array([(lowest or 0, first)], KEY), keys[DRAWN::DRAWN]]))
    shared = spark.sparkContext.broadcast(bounds)

    def places(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for order, hashed in batches:
            rows = np.rec.fromarrays([order.to_numpy(np.int64), hashed.to_numpy(np.int64)], dtype=KEY)
            own = np.searchsorted(shared.value, rows, side="right") - 1
            before = np.where(shared.value[own] == rows, (own - 1) % len(shared.value), -1)
            yield pd.DataFrame({"own": own.astype(np.int32), "before": before.astype(np.int32)})

    place = F.pandas_udf(places, "own int, before int")
    wide = keyed.withColumn("_hash", ahead).withColumn("_place", place("_order", "_hash"))
    to = F.when(F.col("_place.before") >= 0, F.array("_place.own", "_place.before")).otherwise(F.array("_place.own"))
    spread = wide.select("doc_id", "text", "_order", "_hash", F.posexplode(to).alias("_ahead", "_range"))
    return spread.repartition("_range").sortWithinPartitions("_range", "_ahead", "_order", "_hash", "text")


RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text; others ignored) its fingerprint, that of its edited text,
    and its likeness to that text and to the next document, by descending doc_id (after the last: the first).

    Null texts count as empty; an empty text is like an empty one (1) and unlike any other (0). A
    single row is its own next. Null ids count as the lowest, repeated ids go by the hash (xxhash64) of their
    texts; a run of rows equal in id and text is parsed once. An empty table gives no rows.
    """

    def run(batches: ArrowBatches) -> ArrowBatches:
        now = prev = waiting = parsed = None
        ended = False
        for batch in batches:
            rows: list[tuple] = []
            ids = zip(*(batch.column(c).to_pylist() for c in ("_range", "_ahead", "doc_id")), strict=True)
            for (rng, ahead, doc_id), text in zip(ids, batch.column("text"), strict=True):
                text = text.as_py()
                if rng != now:
                    now, prev, waiting, ended = rng, None, None, False
                if ended:
                    continue
                if prev is not None:
                    if parsed is None or parsed[0] != (prev[1], text):
                        parsed = ((prev[1], text), fingerprints(prev[1], text))
                    changed, own, other = parsed[1]
                    if waiting:
                        rows.append((*waiting, likeness(waiting[3], own)))
                    waiting = (prev[0], len(prev[1]), hashlib.sha256(changed.encode()).hexdigest(), own, other, likeness(own, other))
                if ahead:
                    rows.append((*waiting, likeness(waiting[3], fingerprint(text))))
                    ended = True
                prev = (doc_id, text)
            yield arrow_batch(rows, RESULT)

    return in_ranges(docs).select("_range", "_ahead", "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
