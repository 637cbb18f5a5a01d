import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from parallax.llm import decontaminate, langid, minhash, stages
from parallax.llm.packing import default_tokenizer, encoder
from tests.llm import test_minhash, test_pii

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORDS = {"aa": [f"the{i}and" for i in range(900)], "bb": [f"über{c}schön" for c in map(chr, range(97, 123))] + [f"nicht{i}" for i in range(900)]}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A folder with documents and benchmark, and the rows."""
    rng = random.Random(6)
    rows = []
    for i in range(160):
        lang = rng.choice([*WORDS])
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randint(30, 200))), lang))
    item = " ".join(rng.choices(WORDS["aa"], k=30))
    rows += [(200, rows[3][1], rows[3][2]), (201, rows[4][1] + " more", rows[4][2]), (202, None, "aa"), (203, "123 456", "bb"), (204, rows[7][1] + " " + item, rows[7][2])]
    rows += [(205, " ".join(rng.choices(WORDS["aa"], k=40)) + " a@b.cd and 1.2.3.4", "aa")]
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, item


def through(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        out.append(docs)
    return out


def test_every_stage_against_its_definition(spark, made):
    folder, docs, item = made
    found = through(spark, folder)
    kept = [{r["doc_id"]: r for r in df.collect()} for df in found[:-1]]
    assert all(df.columns == COLUMNS for df in found[:-1])
    texts = {i: t for i, t, *_ in docs}
    # what has a language stays
    assert set(kept[0]) == {i for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    # one of each component stays
    component = test_minhash.brute([(i, texts[i]) for i in kept[0]])
    assert set(kept[1]) == {i for i in kept[0] if component[i] == i}
    # what holds the item goes
    assert set(kept[2]) == {i for i in kept[1] if item not in texts[i]}
    # personal data go, documents stay
    assert set(kept[3]) == set(kept[2])
    assert all(test_pii.brute(r["text"]) == "" and r["n_chars"] == len(r["text"]) for r in kept[3].values())
    assert all(r["text"] == texts[i] for i, r in kept[3].items() if not test_pii.brute(texts[i]))
    # every id is packed once
    encode = encoder(default_tokenizer())
    left = {i: [*encode([r["text"]])[0], 1] for i, r in kept[3].items()}
    packed = found[-1].collect()
    for r in packed:
        part = left[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    assert sum(r["length"] for r in packed) == sum(map(len, left.values()))
    ran = corpus_pipeline.run(spark, folder)
    total = lambda rows: sorted((r["doc_id"], r["start"], r["length"]) for r in rows)
    assert sum(r["length"] for r in ran.collect()) == sum(n for _, _, n in total(packed))


def test_stages_handle_empty_and_null_rows(spark, made):
    folder, *_ = made
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(None, None, None, None, None)] * 2, [(1, "", None, None, 0), (1, "", None, None, 0)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, folder).count() >= 0


def test_stages_keep_columns_with_clashing_names_and_long_texts(spark, made):
    folder, docs, item = made
    long = " ".join(WORDS["aa"]) * 60
    rows = [*docs[:60], (300, long, "aa", "s", len(long)), (301, long + " " + item + " end", "aa", "s", 0)]
    names = ("lang_pred", "lang_rejected", "component_id", "Kept", "n_shingles", "leaks", "pii_spans", "pii_base", "_text", "unit", "row")
    wide = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"concat('{c}', doc_id) AS {c}" for c in names])
    plain = wide.select(*COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, folder)
        kept = {r["doc_id"]: r for r in got.collect()}
        assert got.columns == wide.columns, name
        assert set(kept) == {r["doc_id"] for r in stage(spark, plain, folder).select("doc_id").collect()}, name
        own = {"language_id": ("lang_pred", "lang_rejected"), "decontamination": ("leaks",), "pii": ("pii_spans", "pii_base")}.get(name, ())
        assert all(r[c] == f"{c}{i}" for i, r in kept.items() for c in names if c not in own), name
        assert 300 in kept and (301 in kept) == (name in ("language_id", "pii")) or name == "near_dedup", name


def test_operators_are_those_of_the_stages():
    assert [f for _, f in corpus_pipeline.STAGES] == [stages.language_id, stages.near_dedup, stages.decontaminated, stages.without_pii, stages.packing]
    assert langid.REJECT_MOST <= 0.5 and minhash.SIMILAR == 75 and minhash.WORDS == 5 and decontaminate.SURE > decontaminate.LIKELY
