"""Exact quantiles against ``percentile``, with spans so small that every pass is met."""

import random
import re

import pytest
from pyspark.sql import functions as F

from parallax.operators import orderstat, screen

LEVELS = [0.0, 0.1, 0.25, 0.5, 0.5, 0.9, 1.0]


def table(spark, n=6000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = rng.choice(["hot"] * 6 + ["tied", "few", None])
        v = rng.choice([1.5, 1.5, 2.0]) if g == "tied" else rng.choice([rng.gauss(0, 1e6), float(rng.randrange(40)), -0.0, 3.25])
        rows.append((g, i % 2, None if i % 97 == 0 else v))
    rows += [("one", 0, 7.0), ("nulls", 0, None), ("inf", 0, float("inf")), ("inf", 0, 1.0), ("inf", 0, float("-inf"))]
    return spark.createDataFrame(rows, "g string, h int, v double")


def wanted(df, by):
    rows = df.groupBy(*by).agg(F.percentile("v", F.array(*map(F.lit, LEVELS))).alias("q")).filter("q IS NOT NULL")
    return {tuple(r)[:-1]: r["q"] for r in rows.collect()}


@pytest.mark.parametrize("few", [1, 40, 1 << 16])
@pytest.mark.parametrize("by", [["g", "h"], []])
def test_quantiles_equal_percentile(spark, few, by):
    df = table(spark)
    got = {tuple(r)[:-1]: r["q"] for r in orderstat.quantiles(df, "v", LEVELS, by, few).collect()}
    want = wanted(df, by)
    assert set(got) == set(want)
    for k, q in want.items():
        assert repr(got[k]) == repr(q) or [repr(x + 0.0) for x in got[k]] == [repr(x + 0.0) for x in q], k


def test_many_spans_are_joined_by_salts(spark, monkeypatch):
    monkeypatch.setattr(orderstat, "BROADCAST_ROWS", 0)
    df = table(spark, 1500, 2).filter("g <> 'inf'")
    got = {r["g"]: r["q"] for r in orderstat.quantiles(df, "v", LEVELS, ["g"], 5).collect()}
    assert got == {k[0]: q for k, q in wanted(df, ["g"]).items()}


def test_empty_tables_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert orderstat.quantiles(df, "v", [0.5], ["g"]).count() == 0 == orderstat.quantiles(df, "v", [0.5]).count()
    clash = spark.createDataFrame([(1, 2, 3.0, 4), (1, 2, 5.0, 4)], "n int, rank int, low double, first int")
    assert [tuple(r) for r in orderstat.quantiles(clash, "low", [0.5], ["rank", "first"]).collect()] == [(2, 4, [4.0])]
    assert screen.bar(df.select(F.lit(1.0).alias("score")).limit(0)).first()["threshold"] is None


def test_no_aggregate_holds_a_groups_values(spark):
    out = orderstat.quantiles(table(spark, 2000), "v", [0.5], ["g"], 10)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in text and "collect_list(v" not in text


def test_rows_that_are_sorted_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(orderstat, "TASK_ROWS", 100)
    df = table(spark, 1000)
    out = orderstat.quantiles(df, "v", LEVELS, ["g", "h"])
    assert re.search(r", 10\), REPARTITION_BY_NUM", out._jdf.queryExecution().executedPlan().toString())
    assert {tuple(r)[:-1]: pytest.approx(r["q"], nan_ok=True) for r in out.collect()} == wanted(df, ["g", "h"])
