"""The audit against brute force over dense tables; radix selection against a sort."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from parallax.llm import divergence

SCHEMA = "text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(docs, ranks=200):
    docs = [tuple("" if v is None else v for v in d) for d in docs]
    seen, groups, counts = defaultdict(Counter), sorted({(lang, s) for _, lang, s in docs}), defaultdict(Counter)
    for text, lang, source in docs:
        terms = TERM.findall(text.translate(UPPER))
        seen[lang].update(set(terms))
        for key in ((lang, source), (lang, None)):
            counts[key].update(terms)
    out = []
    for lang, source in groups:
        kept = [t for t, n in seen[lang].items() if n >= 3]

        def p(key, kept=kept):
            d = sum(counts[key][t] for t in kept) + len(kept)
            return {t: 1 + 1_000_000_000 * (counts[key][t] + 1) // d for t in kept}

        own, whole = p((lang, source)), p((lang, None))
        pairs = [(sum((own[t] - q) ** 2 // q for t, q in p((lang, s)).items()), s) for x, s in groups if x == lang and s != source]
        terms = [((own[t] - whole[t]) ** 2 // whole[t], t) for t in kept if counts[lang, source][t] and own[t] > whole[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
            for rank, (value, item) in enumerate(sorted(found, key=lambda v: (-v[0], v[1].encode()))[:most], 1):
                out.append((lang, source, part, item, value, rank))
    return sorted(out)


def some_docs(n=300, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("Ab", "cd", "é", "ZÖ", "東") for b in ("x", "Y", "zz", "ß", "ø", "\U0001f600")]
    docs = [(" ".join(rng.choice(words[: rng.randrange(1, 31)]) + rng.choice(["", ".", "1", "_"]) for _ in range(rng.randrange(30))), rng.choice(["en", "de"]), rng.choice(["s0", "s0", "s1", "S2", "é"])) for _ in range(n)]
    return [*docs, (None, "en", "s9"), ("", "en", None), ("Abx abX", None, "s1"), ("lone lone", "fr", "a"), (None, "fr", "b"), ("a b\x00c", "en", "s0")]


def test_audit_equals_brute_force(spark):
    docs = some_docs()
    got = divergence.audit(spark.createDataFrame(docs, SCHEMA).repartition(5))
    assert got.dtypes[-2:] == [("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, got.collect())) == brute(docs)


def test_long_texts_and_small_tasks(spark, monkeypatch):
    docs = [("Größe " * 3000 + "x" * 5000 + " the " * 500, "en", s) for s in "abc"] + some_docs(40)
    want = brute(docs)
    monkeypatch.setattr(divergence, "SLICE", 701)
    for text, *_ in docs:
        assert [w.decode() for ws in divergence.terms_of((text or "").encode()) for w in ws] == TERM.findall((text or "").translate(UPPER))
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(docs, SCHEMA)).collect())) == want


def test_many_terms_are_selected(spark):
    rng = random.Random(6)
    docs = [(" ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(676) if rng.random() < 0.7), "en", f"s{k % 3}") for k in range(12)]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(docs, SCHEMA)).collect())) == brute(docs)


@pytest.mark.parametrize("k, tied", [(1, 1), (7, 1), (7, 3), (50, 10), (5, 10_000)])
def test_selection_equals_a_sort(spark, k, tied):
    rng = random.Random(k * 31 + tied)
    rows = []
    for g in range(4):
        values = [rng.choice([0, 1, 65_535, 65_536, 1 << 40, rng.randrange(1 << 59)]) if g % 2 else 7 for _ in range(80)]
        rows += [("x", f"g{g}", "same" * 40 + rng.choice(["", "a", "é", "zz"]) + str(i), v) for i, v in enumerate(values)]
    rows += [("x", "few", "a", 3), ("x", "few", "b", 3)]
    df = spark.createDataFrame(rows, "lang string, source string, item string, value long")
    got = sorted((r["source"], r["rank"], r["item"], r["value"]) for r in divergence.largest(df, 5, k, tied).collect())
    want = []
    for g in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[3], r[2].encode()))[:k]
        want += [(g, i, r[2], r[3]) for i, r in enumerate(own, 1)]
    assert got == sorted(want)


def test_many_groups_are_joined_by_salts(spark, monkeypatch):
    docs = some_docs(60)
    monkeypatch.setattr(divergence, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(docs, SCHEMA)).collect())) == brute(docs)


def test_empty_tables_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert divergence.audit(empty).count() == 0
    docs = some_docs(50)
    wide = spark.createDataFrame(docs, SCHEMA).withColumns({"term": F.lit("x"), "n": F.lit(1), "value": F.lit(2.5), "Rank": F.lit("r")})
    assert sorted(map(tuple, divergence.audit(wide).collect())) == brute(docs)


def test_shares_are_exact_beyond_longs(spark):
    (r,) = spark.sql("SELECT 40000000000000L AS n, 90000000000001L AS d").select(divergence.share("n", "d").alias("p")).collect()
    assert r["p"] == 1 + 1_000_000_000 * (40_000_000_000_000 + 1) // 90_000_000_000_001
