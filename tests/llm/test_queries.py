"""The registered queries at the smallest scale: against their SQL where there is some, else against brute force."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from parallax.llm import decontaminate
from parallax.llm.packing import default_tokenizer
from parallax.llm.queries import ORACLES, QUERIES
from tests.llm import test_decontaminate, test_fingerprint, test_licenses, test_minhash, test_pii

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(db):
    return db.sql("SELECT doc_id, text, lang, source FROM documents").fetchall()


@pytest.mark.parametrize("name", [*ORACLES])
def test_query_equals_its_sql(spark, db, name):
    got = QUERIES[name](spark, FOLDER)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, db.sql(ORACLES[name]).select(*got.columns).fetchall()))


def test_op1_equals_brute_force(spark, docs):
    got = {r["doc_id"]: r["component_id"] for r in QUERIES["op1_minhash"](spark, FOLDER).collect()}
    assert got == test_minhash.brute([(i, t) for i, t, *_ in docs])


def test_op2_has_the_added_conversation(spark):
    said = "</s>[INST] ok [/INST]"
    (r,) = QUERIES["op2_chat"](spark, FOLDER).filter("conv_id = -1").collect()
    assert (r["n_turns"], r["loss_chars"]) == (2, len(said)) and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_op3_holds_out_its_fold(spark, docs):
    lang = {i: x for i, _, x, _ in docs}
    got = QUERIES["op3_language"](spark, FOLDER).collect()
    assert len(got) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in got)


def test_op4_equals_brute_force(spark, docs):
    got = sorted((tuple(r) for r in QUERIES["op4_fingerprint"](spark, FOLDER).collect()), key=str)
    assert got == test_fingerprint.brute([(i, t) for i, t, *_ in docs])


def test_op4_digests_equal_sql(spark, db):
    wanted = db.sql("""
        SELECT doc_id, length(t) AS n_chars, sha256(left(t, length(t) - length(t) // 3) || left(coalesce(lead(t) OVER w, first(t) OVER (ORDER BY doc_id DESC)), length(t) // 3)) AS edited_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (ORDER BY doc_id DESC)""").fetchall()
    assert sorted(wanted) == sorted(map(tuple, QUERIES["op4_fingerprint"](spark, FOLDER).select("doc_id", "n_chars", "edited_sha256").collect()))


def test_op5_equals_brute_force(spark, docs):
    files = [(i, f"{source or '-'}/{lang or '-'}/{i}", t) for i, t, lang, source in docs]
    got = sorted(((r["doc_id"], r["path"], r["license"], r["origin"], r["directory"]) for r in QUERIES["op5_licenses"](spark, FOLDER).collect()), key=str)
    assert got == test_licenses.brute(files)


def test_op7_finds_what_comparing_all_with_all_finds(spark, db, docs):
    """Every copy by runs of an item's words, and nothing without half of an item's words in order."""
    items = {i: decontaminate.words(t).tolist() for i, t in db.sql("SELECT item_id, text FROM benchmark").fetchall()}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op7_decontamination"](spark, FOLDER).collect()}
    for i, text, *_ in docs:
        said = decontaminate.words(text or "").tolist()
        at = {}
        for k, w in enumerate(said):
            at.setdefault(w, []).append(k)
        for item, words in items.items():
            copied = any(said[k : k + len(words)] == words for k in at.get(words[0], []))
            if copied:
                assert (i, item) in got
            elif (i, item) in got:
                known = set(words)
                assert test_decontaminate.lcs(words, [w for w in said if w in known]) >= decontaminate.LIKELY * len(words)


def test_op8_base_spans_equal_plain_expressions(spark, docs):
    for r in QUERIES["op8_pii"](spark, FOLDER).collect():
        base = test_pii.brute(next(t for i, t, *_ in docs if i == r["doc_id"]))
        kinds = [s.split(":")[0] for s in base.split(",")] if base else []
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [kinds.count(k) for k in ("email", "ip", "card", "phone")]
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(r["spans"].split(","))


def test_op9_holds_out_its_fold(spark, db):
    quality = dict(db.sql("SELECT doc_id, quality FROM labels").fetchall())
    got = QUERIES["op9_quality"](spark, FOLDER).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in quality]
    assert sum((r["score"] >= 0.5) == (quality[r["doc_id"]] == 1) for r in held) >= 0.85 * len(held)


def test_op10_pieces_are_those_of_the_tokenizer(spark, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_tokenizer())
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in docs}
    rows = QUERIES["op10_packing"](spark, FOLDER).collect()
    at = dict.fromkeys(ids, 0)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(ids[r["doc_id"]]) and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        at[r["doc_id"]] += r["length"]
    assert at == {i: len(x) for i, x in ids.items()}
    used = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    padded = sum(n if n & (n - 1) == 0 else 2048 for n in used.values())
    assert max(used.values()) <= 2048 and padded <= 1.01 * sum(used.values())


def test_op13_equals_the_library(spark, docs):
    import tiktoken
    from public_tokenizers import PATTERN

    from parallax.llm import bpe

    library = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_ranks()), special_tokens={})
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_bpe"](spark, FOLDER).collect()}
    for doc_id, text, *_ in docs:
        ids = library.encode_ordinary(text or "")
        assert got[doc_id] == (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), text or "")))
