import random

import numpy as np

from parallax.llm import quality


def rows(n):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "omega", "of", "the"]
    for i in range(n):
        good = rng.random() < 0.6
        text = " ".join(rng.choices(words, k=rng.randint(5, 60)))
        yield i, text if good else " ".join(f"{w.upper()}!!" for w in text.split()), int(good)


def frames(spark, n=400):
    made = [*rows(n)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in made], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = frames(spark)
    model = quality.train(docs, labels.filter("doc_id % 4 != 2"))
    got = quality.score(docs, model).join(labels, "doc_id").filter("doc_id % 4 = 2").collect()
    assert sum((r["quality_score"] >= 0.5) == r["quality"] for r in got) >= 0.97 * len(got)


def test_word_vectors_equal_a_plain_count(spark):
    docs, _ = frames(spark, 30)
    made = quality.word_vectors(docs)
    buckets, (at, signs) = quality.Buckets(), quality.spikes()
    sums = np.zeros((quality.BUCKETS, quality.WIDTH))
    seen = np.zeros(quality.BUCKETS)
    texts = [r["text"] for r in docs.collect()]
    for text in texts:
        ids = quality.words(text, buckets)
        seen[np.unique(ids)] += 1
        for i, w in enumerate(ids):
            for j in range(max(0, i - quality.WINDOW), min(len(ids), i + quality.WINDOW + 1)):
                if j != i:
                    np.add.at(sums[w], at[ids[j]], signs)
    used = seen > 0
    sums /= np.maximum(1e-9, np.linalg.norm(sums, axis=1, keepdims=True))
    assert np.allclose(made.vectors[used], sums[used], atol=1e-5)
    assert np.allclose(made.idf, np.log((1 + len(texts)) / (1 + seen)) + 0.05, atol=1e-5)


def test_edge_cases(spark):
    docs, labels = frames(spark, 120)
    model = quality.train(docs, labels)
    odd = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (3, "alpha of " * 100_000, 3.0), (3, "alpha of " * 100_000, 3.0), (None, "beta", None)], "doc_id long, text string, quality_score double")
    got = {(r["doc_id"], r["quality_score"]) for r in quality.score(odd, model).collect()}
    assert len(got) == 4 and all(0 <= s <= 1 for _, s in got)
    assert len({s for i, s in got if i in (1, 2)}) == 1
    assert quality.score(odd.limit(0), model).count() == 0
    none = quality.train(docs, labels.limit(0))
    assert {r["quality_score"] for r in quality.score(docs, none).collect()} == {0.5}
    empty = quality.train(docs.limit(0), labels)
    assert quality.score(docs, empty).count() == 120
