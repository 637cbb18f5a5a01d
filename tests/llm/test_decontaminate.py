import random

import numpy as np
from pyspark.sql import functions as F

from parallax.llm import decontaminate as dc


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, leaks string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in dc.annotate(d, b).select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.item_id").collect()}


def corpus():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(4000)]
    common = ["the", "of", "and", "to", "in"]

    def text(n):
        return [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]

    items = [(i, text(rng.randint(8, 130))) for i in range(60)]
    docs, planted = [], set()
    for i in range(240):
        body = text(rng.randint(20, 700))
        if i % 4 == 0:
            item, said = items[rng.randrange(len(items))]
            said = said[:]
            if i % 8 == 0:  # a paraphrase: a tenth of the words changed or left out
                for _ in range(len(said) // 10):
                    said[rng.randrange(len(said) - 6)] = rng.choice(vocabulary)
            if i % 12 == 0:
                said = [w.upper() + "!!" for w in said]
            at = rng.randrange(len(body))
            body[at:at] = said
            planted.add((i, item))
        docs.append((i, " ".join(body)))
    return docs, [(i, " ".join(t)) for i, t in items], planted


def test_finds_copies_and_paraphrases_only(spark):
    docs, items, planted = corpus()
    assert found(spark, docs, items) == planted


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 20)
    docs, items, planted = corpus()
    assert found(spark, docs, items) == planted


def test_common_subsequence_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (rng.integers(0, 6, rng.integers(1, 30)).astype(np.uint64) for _ in range(2))
        block = dc.Latent(None, None, None, None, None, None, None, [(0, a)])
        assert block.common(0, b) == lcs(a.tolist(), b.tolist())


def test_latent_space_keeps_what_an_exact_decomposition_keeps(spark):
    docs, items, _ = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    idf = dc.inverse_frequencies(d)
    space = dc.latent_space(spark.createDataFrame(items, "item_id long, text string"), idf)
    rows = []
    for _, text in items:
        for part in dc.passages(dc.words(text)):
            x = np.zeros(dc.BUCKETS)
            at, weight = dc.weighed(part, idf)
            x[at] = weight / np.linalg.norm(weight)
            rows.append(x[space.row >= 0])
    kept = np.linalg.norm(np.array(rows) @ space.basis) ** 2
    best = (np.linalg.svd(np.array(rows), compute_uv=False)[: dc.RANK] ** 2).sum()
    assert kept >= 0.97 * best


def test_frequencies_equal_a_plain_count(spark):
    texts = ["a b a", None, "b, C!", ""]
    idf = dc.inverse_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"))
    at = {w: int(dc.buckets(dc.words(w))[0]) for w in "abc"}
    assert np.allclose([idf[at[w]] for w in "abc"], [np.log1p(24 / (n + 0.5)) for n in (1, 2, 1)])


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, "x " * 200_000 + "alpha beta gamma delta epsilon zeta eta theta"), (None, "alpha beta gamma delta epsilon zeta eta theta"), (4, "!!!")]
    items = [(7, "Alpha, beta gamma delta epsilon zeta eta theta."), (None, "x x x x x x x x"), (8, None), (9, "")]
    assert found(spark, docs + docs, items) == {(3, 7), (None, 7)}
    assert found(spark, [(1, items[0][1])], items[:1]) == {(1, 7)}
    assert found(spark, docs, []) == set() and found(spark, [], items) == set()


def test_copy_is_found_behind_nearer_windows(spark):
    """Words of the item in another order are nearer than its copy, whose window has other known words too."""
    rng = random.Random(5)
    items = [(i, [f"q{i}x{k}" for k in range(30)]) for i in range(3)]
    shuffled = items[0][1][:]
    rng.shuffle(shuffled)
    filler = [f"f{k}" for k in range(150)]
    docs = [(i, " ".join([*shuffled, *filler[: 100 + i], *items[1][1][:9], *items[0][1], *items[2][1][:9]])) for i in range(24)]
    docs += [(100 + i, " ".join([*shuffled, *filler])) for i in range(3)]
    docs += [(200 + i, " ".join(filler)) for i in range(60)]
    assert found(spark, docs, [(i, " ".join(t)) for i, t in items]) == {(i, 0) for i in range(24)}


def test_copies_that_many_documents_hold(spark):
    """A third, then most of the documents hold one item; words of other items, which are rarer, stand around it."""
    rng = random.Random(6)
    items = [(0, [f"c{k}" for k in range(16)])] + [(i, [f"r{i}x{k}" for k in range(40)]) for i in range(1, 40)]
    others = [w for _, t in items[1:] for w in t]
    for share in (3, 1):
        docs, planted = [], set()
        for i in range(90):
            body = [rng.choice(others) for _ in range(120)]
            if i % share == 0:
                body[50:50] = items[0][1]
                planted.add((i, 0))
            docs.append((i, " ".join(body)))
        assert found(spark, docs, [(i, " ".join(t)) for i, t in items]) == planted


def test_recall_by_share_of_words_changed(spark):
    """Paraphrases with up to three of ten words changed, and items with their halves swapped."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(4000)]
    items = [(i, rng.choices(vocabulary, k=rng.randint(20, 80))) for i in range(40)]
    docs, kind = [], {}
    for change in (0.1, 0.2, 0.25, 0.3, "swapped"):
        for i, item in items:
            said = item[len(item) // 2 :] + item[: len(item) // 2] if change == "swapped" else item[:]
            if change != "swapped":
                for at in rng.sample(range(len(said) - 6), int(change * len(said))):
                    said[at] = rng.choice(vocabulary)
            kind[len(docs)] = (change, i)
            docs.append((len(docs), " ".join([*rng.choices(vocabulary, k=150), *said, *rng.choices(vocabulary, k=150)])))
    clean = len(docs)
    docs += [(clean + i, " ".join(rng.choices(vocabulary, k=400))) for i in range(200)]
    got = found(spark, docs, [(i, " ".join(t)) for i, t in items])
    assert got <= {(d, i) for d, (_, i) in kind.items()}
    recall = {c: sum((d, i) in got for d, (k, i) in kind.items() if k == c) / len(items) for c in (0.1, 0.2, 0.25, 0.3, "swapped")}
    print(recall)
    assert min(recall.values()) >= 0.9
