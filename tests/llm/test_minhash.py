import random

import numpy as np
import pytest

from parallax.llm import minhash as mh


def words_of(text):
    return (text or "").encode().lower().split()


def shingle_set(text):
    w = words_of(text)
    return frozenset({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if w else frozenset()


def brute(rows):
    """component_id by comparing all pairs; rows of one id are one vertex."""
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def corpus(seed, n, copies, edits):
    """Texts, and a group of near copies of one of them with 0 to ``edits`` words changed."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 120))) for _ in range(n)]
    base = rng.choices(vocabulary, k=140)
    for _ in range(copies):
        w = base[:]
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    rng.shuffle(texts)
    return list(enumerate(texts))


def got(spark, rows):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n string")
    return mh.assign(docs).collect()


def test_against_brute_force(spark):
    rows = corpus(1, 250, 40, 5)
    rows += [(900, rows[3][1]), (901, rows[3][1].upper()), (902, "A b\tc"), (903, "a  B c"), (904, "a b"), (905, "é É")]
    out = {r["doc_id"]: r for r in got(spark, rows)}
    assert {i: r["component_id"] for i, r in out.items()} == brute(rows)
    assert all(r["n_shingles"] == len(shingle_set(t)) and r["kept"] == (i == r["component_id"]) for i, t in rows for r in [out[i]])


@pytest.mark.parametrize("depth", [1, 3])
def test_large_nodes_and_clusters(spark, monkeypatch, depth):
    """Groups far larger than nodes and cells: pivots, deeper branching, blocks."""
    monkeypatch.setattr(mh, "LEAF", 8)
    monkeypatch.setattr(mh, "CELL", 16)
    monkeypatch.setattr(mh, "BLOCK", 8)
    monkeypatch.setattr(mh, "SUBBLOCK", 4)
    monkeypatch.setattr(mh, "OUTSIDERS", 12 if depth == 1 else 40)
    monkeypatch.setattr(mh.common, "BROADCAST_ROWS", 0 if depth == 1 else 10)
    monkeypatch.setattr(mh, "PIVOTS", 4)
    monkeypatch.setattr(mh, "DEPTH", depth)
    monkeypatch.setattr(mh, "LOCAL_EDGES", 0 if depth == 1 else 10_000)
    rows = corpus(2, 60, 240, 14)
    assert {r["doc_id"]: r["component_id"] for r in got(spark, rows)} == brute(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "x y"), (4, "x y"), (5, "x y"), (None, "x y"), (6, "long text here " * 60_000), (7, "long text here " * 60_001), (8, "p q r"), (8, "s t u"), (9, "s t u")]
    out = got(spark, rows)
    assert len(out) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in out} == {(None, None), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 6), (8, 8), (9, 8)}
    assert all(r["kept"] for r in out if r["doc_id"] in (None, 1, 2, 3))
    assert mh.assign(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_of_one_id_tie_their_texts(spark):
    rows = [(3, "a a1 a2"), (5, "a a1 a2"), (5, "b b1"), (5, "c c1"), (7, "c c1"), (4, "b b1")]
    assert {r["doc_id"]: r["component_id"] for r in got(spark, rows)} == brute(rows) == {3: 3, 4: 3, 5: 3, 7: 3}


def test_deduplicated_loses_no_text_of_a_kept_document(spark):
    rows = [(1, "one two three four five six", 0), (1, "other words of the same id", 1), (1, "other words of the same id", 2), (2, "One two three four five six", 3), (3, "other words of the same id", 4), (2**63 - 1, "x", 5), (2**53 + 1, "y", 6), (None, "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rep int")
    out = sorted((r["doc_id"] or 0, r["text"]) for r in mh.deduplicated(docs).collect())
    assert out == [(0, "x"), (1, "one two three four five six"), (1, "other words of the same id"), (2**53 + 1, "y"), (2**63 - 1, "x")]


def test_ids_beyond_doubles_beside_a_null(spark):
    docs = spark.createDataFrame([(2**53 + 1, "a b"), (2**53, "c d"), (2**63 - 1, "a b"), (None, "a b")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in mh.assign(docs).collect()} == {(2**53 + 1, 2**53 + 1), (2**53, 2**53), (2**63 - 1, 2**53 + 1), (None, None)}


def test_deduplicated_keeps_one_of_each(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "a b c", "y"), (3, None, "z"), (None, "a b c", "u"), (4, "d", "k"), (4, "d", "l")], "doc_id long, text string, lang string")
    assert sorted(((r["doc_id"], r["lang"]) for r in mh.deduplicated(docs).drop("text").collect() if r["lang"] not in "kl"), key=str) == [(1, "x"), (3, "z"), (None, "u")]
    odd = docs.selectExpr("*", "'x' AS _row", "'y' AS _kept")
    assert {(r["_row"], r["_kept"]) for r in mh.deduplicated(odd).collect()} == {("x", "y")}
    assert mh.deduplicated(docs).count() == 4 and mh.deduplicated(docs).columns == docs.columns


@pytest.mark.parametrize("m", [2, 4, 5, 40])
def test_links_are_exact(m):
    rng = np.random.default_rng(m)
    sets = [np.unique(rng.integers(0, 30, rng.integers(0, 40))).astype(np.uint64) for _ in range(m)]
    found = mh.links(sets)
    for i in range(m):
        for j in range(m):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            assert found[i, j] == (i != j and bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b))


@pytest.mark.parametrize("local", [0, 1000])
def test_components_of_a_long_path(spark, monkeypatch, local):
    monkeypatch.setattr(mh, "LOCAL_EDGES", local)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99)], "u long, v long")
    assert {(r["id"], r["root"]) for r in mh.components([edges]).collect()} == {(i, 0) for i in range(41)} | {(99, 99), (100, 99)}
