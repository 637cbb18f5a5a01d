import hashlib

import xxhash
from hypothesis import given
from hypothesis import strategies as st

from parallax.llm import fingerprint as fp


def spark_hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - 2**64 if h >= 2**63 else h


def brute(rows):
    """By the definition: sort, take the next, parse everything anew."""
    rows = sorted(((2**63 if i is None else -i, spark_hash(t or ""), i, t or "") for i, t in rows), key=lambda r: r[:2])
    out = []
    for k, (_, _, i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][3]
        changed = fp.edited(text, following)
        a, b, c = fp.fingerprint(text), fp.fingerprint(changed), fp.fingerprint(following)
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), a, b, fp.likeness(a, b), fp.likeness(a, c)))
    return sorted(out, key=str)


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string")
    assert sorted((tuple(r) for r in fp.compare_with_edits(docs).collect()), key=str) == brute(rows)


def test_against_brute_force(spark):
    check(spark, [(i * 7 % 1009, "word%d is here " % (i % 13) * (i % 9)) for i in range(1009)])


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 10)
    check(spark, [(i, f"text {i} " * (i % 5)) for i in range(-40, 160)])


def test_hot_ids_are_split_by_text_and_equal_rows_stay(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 10)
    rows = [(7, f"text {i} " * 3) for i in range(150)] + [(None, f"no id {i}") for i in range(80)] + [(3, "the same")] * 60 + [(2**53 + 1, "a"), (2**53, "b"), (2**63 - 1, "c"), (-(2**63) + 1, "d")]
    check(spark, rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = [r["count"] for r in fp.in_ranges(docs).groupBy("_range").count().collect()]
    assert len(sizes) > 15 and sorted(sizes)[-2] < 80


def test_edge_cases(spark):
    check(spark, [(1, None), (2, ""), (None, "no id"), (3, "long " * 50_000), (4, "é\U0001f600ü"), (4, "é\U0001f600ü"), (4, "again")])
    check(spark, [(5, "alone")])
    assert fp.compare_with_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_likeness_of_empty_texts():
    empty, some = fp.fingerprint(""), fp.fingerprint("abc")
    assert fp.likeness(empty, empty) == 1 and fp.likeness(empty, some) == 0


@given(st.text(max_size=60), st.text(max_size=60))
def test_shared_parse_equals_a_new_one(text, following):
    changed, a, b = fp.fingerprints(text, following)
    assert (changed, a, b) == (fp.edited(text, following), fp.fingerprint(text), fp.fingerprint(changed))
    assert 0 <= fp.likeness(a, b) <= 1
