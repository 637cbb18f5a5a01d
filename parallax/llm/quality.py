"""Quality scores: random-indexing word vectors, pooled, through a two-layer numpy network.

Words are runs of letters, runs of digits and runs of other signs, hashed to ``BUCKETS``. Each
bucket has a sparse random index vector; the vector of a word is the sum of the index vectors of
its neighbours (two on either side) over all documents. A document is the idf-weighted mean of its
words' vectors, with a few shares (capitals, signs, repeats, distinct words) and its length. A network with one hidden
layer is trained on labelled rows and a temperature, fitted on rows kept out, calibrates it.

The vectors and document frequencies count all documents. The network sees at most about
``MAX_ROWS`` labelled rows, chosen by a hash of doc_id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import hashed_share, null_to_empty, ready, sum_blocks

BUCKETS = 1 << 15
WIDTH = 64
SPIKES = 4
WINDOW = 2
HIDDEN = 32
MAX_ROWS = 8000
THRESHOLD = 0.7
#: Bucket vectors travel in blocks of so many.
BLOCK = 256
#: Most tasks of the counting pass: each emits 8.5 MB at most, so all emit 560 GB at most, whatever the input.
PARTIALS = 1 << 16
#: Words are counted in runs of about so many, so memory stays bounded.
CHUNK = 1 << 21
WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


class Buckets(dict):
    """Word -> bucket; forgets its words when it has too many."""

    LIMIT = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = b = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace")) % BUCKETS
        return b


def words(text: str, buckets: Buckets) -> np.ndarray:
    return np.array([*map(buckets.__getitem__, WORD.findall(text.lower()))], np.int64)


def spikes() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the index vectors."""
    rng = np.random.default_rng(11)
    return rng.integers(0, WIDTH, (BUCKETS, SPIKES)), np.where(np.arange(SPIKES) % 2, -1.0, 1.0)


@dataclass
class WordVectors:
    vectors: np.ndarray
    idf: np.ndarray

    def pool(self, text: str, buckets: Buckets) -> np.ndarray:
        ids = words(text, buckets)
        n = max(1, len(ids))
        shares = np.zeros(6)
        mean = np.zeros(WIDTH)
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        if len(ids):
            weights = self.idf[ids]
            mean = weights @ self.vectors[ids] / max(1e-9, weights.sum())
            signs = ((raw >= 33) & (raw <= 47)) | ((raw >= 58) & (raw <= 64)) | ((raw >= 91) & (raw <= 96)) | ((raw >= 123) & (raw <= 126))
            capitals, small = ((raw >= 65) & (raw <= 90)).sum(), ((raw >= 97) & (raw <= 122)).sum()
            shares[:] = (
                np.log1p(n) / 10, capitals / max(1, capitals + small), signs.sum() / max(1, len(raw)),
                (ids[1:] == ids[:-1]).sum() / n, len(np.unique(ids)) / n, len(raw) / n / 10,
            )
        return np.concatenate([mean, shares])


def word_vectors(docs: DataFrame) -> WordVectors:
    """Random indexing and document frequencies over all rows; 8 MB, whatever the input."""
    spark = ready(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets, (at, signs) = Buckets(), spikes()
        sums = np.zeros(BUCKETS * WIDTH)
        seen = np.zeros((BUCKETS, 1))
        n_docs = 0

        def add(ids: np.ndarray) -> None:
            """Counts of (word, neighbour) give the sums of index vectors."""
            for shift in range(1, WINDOW + 1):
                a, b = ids[:-shift], ids[shift:]
                real = (a >= 0) & (b >= 0)
                a, b = a[real], b[real]
                for word, near in ((a, b), (b, a)):
                    for k in range(SPIKES):
                        sums[:] += signs[k] * np.bincount(word * WIDTH + at[near, k], minlength=BUCKETS * WIDTH)

        held: list[np.ndarray] = []
        size = 0
        for pdf in batches:
            for text in null_to_empty(pdf["text"]):
                ids = words(text, buckets)
                n_docs += 1
                seen[np.unique(ids), 0] += 1
                held += [ids, np.full(WINDOW, -1)]
                size += len(ids)
                if size >= CHUNK:
                    add(np.concatenate(held))
                    held, size = [], 0
        if held:
            add(np.concatenate(held))
        if n_docs:
            full = np.concatenate([sums.reshape(BUCKETS, WIDTH), seen], axis=1).astype(np.float32).reshape(BUCKETS // BLOCK, -1)
            used = np.flatnonzero(seen.reshape(BUCKETS // BLOCK, -1).any(axis=1)).tolist()
            yield pd.DataFrame({"block": [*used, BUCKETS // BLOCK], "body": [*(full[i].tobytes() for i in used), np.array([n_docs], np.float32).tobytes()]})

    partials = docs.select(F.col("text").cast("string")).coalesce(PARTIALS).mapInPandas(count, "block int, body binary")
    blocks = sum_blocks(partials, min(64, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if not blocks:
        return WordVectors(np.zeros((BUCKETS, WIDTH), np.float32), np.zeros(BUCKETS, np.float32))
    unused = np.zeros(BLOCK * (WIDTH + 1), np.float32)
    full = np.concatenate([blocks.get(i, unused) for i in range(BUCKETS // BLOCK)]).reshape(BUCKETS, WIDTH + 1)
    vectors = full[:, :WIDTH].copy()
    vectors /= np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True))
    idf = np.log((1 + blocks[BUCKETS // BLOCK][0]) / (1 + full[:, WIDTH]))
    return WordVectors(vectors.astype(np.float32), (idf + 0.05).astype(np.float32))


@dataclass
class QualityModel:
    vectors: WordVectors
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def score(self, texts: list[str], buckets: Buckets) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.array([self.vectors.pool(t, buckets) for t in texts])
        h = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return 1 / (1 + np.exp(-np.clip((h @ self.w2 + self.b2) / self.temperature, -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, vectors, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Pooled rows and labels of at most about ``max_rows`` rows of ``labels`` (doc_id, quality) that have a document."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    n = known.count()
    chosen = known.filter(hashed_share("doc_id", max_rows / max(1, n), 9)).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = Buckets()
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "quality": pdf["quality"], "x": [vectors.value.pool(t, buckets).tolist() for t in null_to_empty(pdf["text"])]})

    got = sorted(rows.mapInPandas(pool, "doc_id long, quality int, x array<double>").collect())
    return np.array([r["x"] for r in got]).reshape(len(got), WIDTH + 6), np.array([r["quality"] for r in got], float)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, epochs: int = 60, seed: int = 2) -> QualityModel:
    """``docs``: all documents, for the word vectors; ``labels``: only those that may be learned from."""
    vectors = word_vectors(docs)
    x, y = labelled(docs, labels, docs.sparkSession.sparkContext.broadcast(vectors), max_rows)
    return fit(vectors, x, y, epochs, seed)


def fit(vectors: WordVectors, x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 2) -> QualityModel:
    rng = np.random.default_rng(seed)
    kept = np.arange(len(y)) % 5 == 0 if len(y) >= 50 else np.zeros(len(y), bool)
    mean = x[~kept].mean(axis=0) if len(y) else np.zeros(WIDTH + 6)
    scale = x[~kept].std(axis=0) + 1e-3 if len(y) else np.ones(WIDTH + 6)
    z = (x - mean) / scale
    p = {"w1": rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": np.zeros(HIDDEN), "b2": np.zeros(1)}
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    train_rows, step = np.flatnonzero(~kept), 0
    for _ in range(epochs if len(y) else 0):
        for rows in np.array_split(rng.permutation(train_rows), max(1, len(train_rows) // 64)):
            xb, yb = z[rows], y[rows]
            h = np.tanh(xb @ p["w1"] + p["b1"])
            err = (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -30, 30))) - yb) / len(rows)
            dh = np.outer(err, p["w2"]) * (1 - h * h)
            grad = {"w1": xb.T @ dh + 1e-4 * p["w1"], "b1": dh.sum(0), "w2": h.T @ err + 1e-4 * p["w2"], "b2": np.array([err.sum()])}
            step += 1
            for k, g in grad.items():  # Adam
                m, v = state[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p[k] -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    logits = np.tanh(z @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"]
    held = kept if kept.any() else ~kept

    def loss(t: float) -> float:
        s = np.clip(logits[held] / t, -30, 30)
        return float(np.mean(np.log1p(np.exp(-s)) * y[held] + np.log1p(np.exp(s)) * (1 - y[held])))

    temperature = min(np.geomspace(0.3, 10, 50), key=loss) if len(y) else 1.0
    return QualityModel(vectors, mean, scale, p["w1"], p["b1"], p["w2"], float(p["b2"][0]), float(temperature))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with quality_score, read from ``text`` alone. Null texts score as empty ones. Other columns
    and repeated rows stay; a column quality_score is replaced. Without labelled rows all score 0.5."""
    spark = ready(docs.sparkSession)
    docs = docs.drop("quality_score")
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets = Buckets()
        for texts in batches:
            yield pd.Series(shared.value.score(null_to_empty(texts), buckets), dtype="float64")

    scored = F.pandas_udf(run, "double")
    return docs.withColumn("quality_score", scored(F.col("text").cast("string")))
