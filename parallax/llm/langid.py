"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's letters are lower-cased and everything else becomes a boundary. Its subwords are all
character pairs, triples and quadruples with at most a boundary at either end, hashed to
``BUCKETS``. The mean of their embeddings goes through a linear softmax; both are trained by
stochastic gradient descent in numpy. As everything up to the softmax is linear, prediction adds up
one table row of logits per subword. A temperature fitted on rows kept out of training calibrates
the score; texts whose score is under a bound, taken from the lowest scores of those rows, are
rejected.

Training sees at most about ``MAX_ROWS`` labelled rows (each language gets an equal share of them,
chosen by a hash of doc_id): the whole text of each, and two short runs of it, as texts may be short.
Everything covers whole texts; long ones go by pieces of positions whose sums are added.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import ArrowBatches, arrow_batch, fresh, null_to_empty, ready

BUCKETS = 1 << 15
WIDTH = 16
MAX_ROWS = 4000
#: Subwords of the short runs.
RUNS = (24, 120)
UNKNOWN = "und"
#: Texts are handled in pieces of about so many characters, so memory stays bounded.
CHUNK = 1 << 18
#: Scores of rows kept out of training under this quantile are rejected, and never scores over REJECT_MOST.
REJECT_QUANTILE = 0.001
REJECT_MOST = 0.5


@lru_cache(maxsize=1)
def known_letters() -> np.ndarray:
    """By code point: 1 for letters, 0 for others, -1 for what was not met yet."""
    return np.full(0x110000, -1, np.int8)


def letters(chars: np.ndarray) -> np.ndarray:
    flags = known_letters()
    found = flags[chars]
    if (found < 0).any():
        new = np.unique(chars[found < 0])
        flags[new] = [unicodedata.category(chr(c))[0] == "L" for c in new.tolist()]
        found = flags[chars]
    return found == 1


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The lowered characters of several texts, each between boundaries, and where each text begins."""
    lowered = [t.lower() for t in texts]
    chars = np.frombuffer("".join(f"\0{t}\0" for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    return chars, np.concatenate([[0], np.cumsum([len(t) + 2 for t in lowered])[:-1]]).astype(np.int64)


def subwords(chars: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed subwords (0: none) that begin at each position from ``a`` up to ``b``, and whether there is a letter."""
    part = np.concatenate([chars[a : b + 3], np.ones(max(0, b + 3 - len(chars)), np.uint32)])
    is_letter = letters(part)
    c = np.where(is_letter, part, 1).astype(np.uint32)
    n = b - a
    one, two, three, four = (c[i : i + n] for i in range(4))
    i1, i2 = is_letter[1 : n + 1], is_letter[2 : n + 2]
    pair = one * np.uint32(0x9E3779B1) + two * np.uint32(0x85EBCA77)
    triple = pair * np.uint32(0xC2B2AE3D) + three * np.uint32(0x27D4EB2F)
    quad = triple * np.uint32(0x165667B1) + four * np.uint32(0x9E3779B1)
    hashed = np.empty((n, 3), np.int32)
    for k, (h, real) in enumerate(((pair, is_letter[:n] | i1), (triple, i1), (quad, i1 & i2))):
        hashed[:, k] = np.where(real, ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17)) % np.uint32(BUCKETS - 1) + np.uint32(1), 0)
    return hashed, is_letter[:n]


def pieces(chars: np.ndarray) -> Iterator[tuple[int, int]]:
    for a in range(0, len(chars), CHUNK):
        yield a, min(a + CHUNK, len(chars))


@dataclass
class LanguageModel:
    """``table``: logits by subword bucket, row 0 empty."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        chars, starts = code_points(texts)
        sums, counts, has = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts)), np.zeros(len(texts), bool)
        for a, b in pieces(chars):
            hashed, is_letter = subwords(chars, a, b)
            first, last = np.searchsorted(starts, [a, b - 1], side="right") - 1
            cuts = np.concatenate([[0], starts[first + 1 : last + 1] - a])
            own = slice(first, last + 1)
            for k in range(3):
                sums[own] += np.add.reduceat(self.table[hashed[:, k]], cuts, axis=0)
            counts[own] += np.add.reduceat((hashed > 0).sum(axis=1), cuts)
            has[own] |= np.add.reduceat(is_letter.astype(np.int64), cuts) > 0
        z = (sums / np.maximum(1, counts)[:, None] + self.bias) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), has

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        langs: list[str] = []
        scores: list[np.ndarray] = []
        for part in chunks(texts):
            if not self.langs:
                langs += [UNKNOWN] * len(part)
                scores.append(np.zeros(len(part)))
                continue
            p, has = self.probabilities(part)
            best = p.argmax(axis=1)
            langs += [self.langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
            scores.append(np.where(has, p.max(axis=1), 0.0))
        return langs, np.concatenate(scores) if scores else np.zeros(0)


def chunks(texts: list[str], size: int = CHUNK) -> Iterator[list[str]]:
    part: list[str] = []
    held = 0
    for t in texts:
        part.append(t)
        held += len(t) + 2
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


Sample = list[tuple[str, np.ndarray, np.ndarray]]


def labelled_sample(docs: DataFrame, max_rows: int = MAX_ROWS) -> Sample:
    """(lang, subwords, their shares) of at most about ``max_rows`` rows of (doc_id, text, lang), nulls left out.

    Each row gives three: two short runs of it and its whole text.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    each = max_rows / len(counts)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, each / n)])
    chosen = known.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def counted(batches: ArrowBatches) -> ArrowBatches:
        for batch in batches:
            rows = []
            for key, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rng = np.random.default_rng(key & 0xFFFFFFFF)
                chars, _ = code_points([text])
                whole = np.zeros(BUCKETS, np.int64)
                for a, b in pieces(chars):
                    whole += np.bincount(subwords(chars, a, b)[0].ravel(), minlength=BUCKETS)
                whole[0] = 0
                for i, size in enumerate(RUNS):  # about so many subwords: three begin at a position
                    at = int(rng.integers(0, max(1, len(chars) - size // 3 + 1)))
                    run = subwords(chars, at, min(len(chars), at + size // 3))[0].ravel()
                    rows.append((key, i, lang, *shares(np.bincount(run[run > 0], minlength=1))))
                rows.append((key, len(RUNS), lang, *shares(whole)))
            yield arrow_batch([r for r in rows if r[3]], SAMPLED)

    rows = chosen.select(F.xxhash64("doc_id", "text"), "lang", "text").mapInArrow(counted, "key long, run int, lang string, ids binary, n binary").collect()
    rows.sort(key=lambda r: (r["key"], r["run"], r["lang"]))
    return [(r["lang"], np.frombuffer(r["ids"], np.uint16).astype(np.int64), np.frombuffer(r["n"], np.float32)) for r in rows]


SAMPLED = pa.schema([("key", pa.int64()), ("run", pa.int32()), ("lang", pa.string()), ("ids", pa.binary()), ("n", pa.binary())])


def shares(counts: np.ndarray) -> tuple[bytes, bytes]:
    ids = np.flatnonzero(counts)
    return ids.astype(np.uint16).tobytes(), (counts[ids] / max(1, counts.sum())).astype(np.float32).tobytes()


def fit(sample: Sample, epochs: int = 4, rate: float = 4.0, seed: int = 5) -> LanguageModel:
    """Train on (lang, subwords, their shares); every fifth three of them calibrate instead."""
    langs = sorted({lang for lang, _, _ in sample})
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH))
    out = np.zeros((WIDTH, len(langs)))
    bias = np.zeros(len(langs))
    rows = [(langs.index(lang), ids, n) for lang, ids, n in sample]
    kept = [i for i in range(len(rows)) if (i // 3) % 5 == 0] if len(rows) >= 60 else []
    train = np.array(sorted(set(range(len(rows))) - set(kept)))
    steps, done = max(1, epochs * len(train)), 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            y, ids, n = rows[i]
            lr = rate * (1 - done / steps)
            done += 1
            mean = n @ emb[ids]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= lr * np.outer(mean, p)
            bias -= 0.1 * lr * p
            emb[ids] -= np.outer(n, lr * back)
    logits = emb @ out
    logits[0] = 0
    calibrate = kept or list(train)
    z = np.array([rows[i][2] @ logits[rows[i][1]] + bias for i in calibrate])
    y = np.array([rows[i][0] for i in calibrate])

    def loss(t: float) -> float:
        s = z / t
        return float(-(s[np.arange(len(y)), y] - np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) - s.max(1)).mean())

    temperature = min(np.geomspace(1, 20, 40), key=loss)  # never surer than trained
    s = np.exp((z - z.max(1, keepdims=True)) / temperature)
    top = (s / s.sum(1, keepdims=True)).max(axis=1)
    return LanguageModel(langs, logits.astype(np.float32), bias, float(temperature), min(REJECT_MOST, float(np.quantile(top, REJECT_QUANTILE))))


def train(docs: DataFrame, max_rows: int = MAX_ROWS) -> LanguageModel:
    ready(docs.sparkSession)
    return fit(labelled_sample(docs, max_rows))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_rejected; only the column ``text`` is read for them.

    Texts without a letter (null and empty ones too) are ``und`` with score 0 and rejected. Without
    any learned language all are ``und``. All other columns and repeated rows stay as they are; columns
    with the names of the new ones are replaced.
    """
    spark = ready(docs.sparkSession)
    new = ("lang_pred", "lang_score", "lang_rejected")
    docs = docs.drop(*new)
    shared = spark.sparkContext.broadcast(model)

    def result(texts: pd.Series) -> pd.DataFrame:
        langs, scores = shared.value.predict(null_to_empty(texts))
        rejected = [lang == UNKNOWN or score < shared.value.reject_below for lang, score in zip(langs, scores, strict=True)]
        return pd.DataFrame({"lang_pred": langs, "lang_score": scores, "lang_rejected": rejected})

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield result(texts)

    # not to be computed again for a filter on its result
    predict = F.pandas_udf(run, "lang_pred string, lang_score double, lang_rejected boolean").asNondeterministic()
    found = fresh(docs, "_found")
    return docs.withColumn(found, predict(F.col("text").cast("string"))).select(*docs.columns, *[F.col(f"{found}.{c}").alias(c) for c in new])

