import random

import numpy as np

from parallax.llm import langid

WORDS = {"aa": "the and thing over hand", "bb": "der und nicht über schön", "cc": "él niño mañana sección corazón"}


def corpus(n):
    rng = random.Random(1)
    return [(i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randint(4, 60))), lang) for i in range(n) for lang in [rng.choice([*WORDS])]]


def test_learns_languages_and_defines_edge_cases(spark):
    rows = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.langs == ["aa", "bb", "cc"]
    odd = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "123 !!", "x"), (4, "the and " * 200_000, "x"), (5, "über und", None), (5, "über und", None), (None, "MAÑANA CORAZÓN", None)],
        "doc_id long, text string, lang_pred string",
    )
    got = sorted((r["doc_id"] or 0, r["lang_pred"], r["lang_score"] > 0.5, r["lang_rejected"]) for r in langid.identify(odd, model).collect())
    assert got == [(0, "cc", True, False), (1, "und", False, True), (2, "und", False, True), (3, "und", False, True), (4, "aa", True, False), (5, "bb", True, False), (5, "bb", True, False)]
    assert langid.identify(odd.limit(0), model).count() == 0


def test_held_out_accuracy_and_calibration(spark):
    docs = spark.createDataFrame(corpus(400), "doc_id long, text string, lang string")
    model = langid.train(docs.filter("doc_id % 2 = 0"))
    got = langid.identify(docs.filter("doc_id % 2 = 1"), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)
    assert not any(r["lang_rejected"] for r in got if r["lang_score"] > 0.5)


def sample_of(rows):
    out = []
    for _, text, lang in rows:
        chars, _ = langid.code_points([text])
        counts = np.bincount(langid.subwords(chars, 0, len(chars))[0].ravel(), minlength=langid.BUCKETS)
        counts[0] = 0
        ids, n = langid.shares(counts)
        out.append((lang, np.frombuffer(ids, np.uint16).astype(np.int64), np.frombuffer(n, np.float32)))
    return out


def test_neither_batches_nor_pieces_change_results(monkeypatch):
    model = langid.fit(sample_of(corpus(60)))
    texts = [t for _, t, _ in corpus(40)] + ["", "x", "über \U00010330é " * 500]
    together = model.predict(texts)
    alone = [model.predict([t]) for t in texts]
    monkeypatch.setattr(langid, "CHUNK", 7)
    cut = model.probabilities(texts)
    monkeypatch.undo()
    whole = model.probabilities(texts)
    assert together[0] == [a[0][0] for a in alone]
    assert all(abs(s - a[1][0]) < 1e-9 for s, a in zip(together[1], alone, strict=True))
    assert np.allclose(cut[0], whole[0]) and (cut[1] == whole[1]).all()


def test_whole_texts_are_learned_from(spark):
    text = "the and thing " * 30_000 + "zebra"
    got = max(langid.labelled_sample(spark.createDataFrame([(1, text, "aa")], "doc_id long, text string, lang string")), key=lambda s: len(s[1]))
    counts = np.bincount(langid.subwords(langid.code_points([text])[0], 0, len(text) + 2)[0].ravel(), minlength=langid.BUCKETS)
    counts[0] = 0
    assert got[1].tolist() == np.flatnonzero(counts).tolist() and np.allclose(got[2], counts[got[1]] / counts.sum())


def test_ties_go_to_the_first_language():
    model = langid.LanguageModel(["aa", "bb"], np.zeros((langid.BUCKETS, 2), np.float32), np.zeros(2), 1.0, 0.0)
    assert model.predict(["some text"])[0] == ["aa"] and model.predict(["some text"])[1].tolist() == [0.5]


def test_clashing_names(spark):
    docs = spark.createDataFrame([("the and", "x")], "text string, _found string")
    got = langid.identify(docs, langid.train(spark.createDataFrame(corpus(60), "doc_id long, text string, lang string"))).first()
    assert (got["_found"], got["lang_pred"]) == ("x", "aa")


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    got = langid.identify(docs, langid.train(docs)).collect()
    assert (got[0]["lang_pred"], got[0]["lang_score"]) == ("und", 0.0)
