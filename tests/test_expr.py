import pytest
from pyspark.sql import functions as F

from parallax.functions import expr


def one(spark, schema, row, *columns):
    return spark.createDataFrame([row], schema).select(*columns).first()


def test_batting_rates(spark):
    df = spark.createDataFrame([(600, 520, 180, 30, 5, 20, 60, 70, 5, 5, 280)], "PA int, AB int, H int, `2B` int, `3B` int, HR int, SO int, BB int, HBP int, SF int, TB int")
    r = expr.add_rates(df, "batting").first()
    assert r["k_pct"] == 60 / 600 and r["obp"] == pytest.approx(255 / 600) and r["babip"] == pytest.approx(160 / 445)
    assert r["iso"] == pytest.approx(280 / 520 - 180 / 520)


def test_zero_denominators_and_absent_columns(spark):
    r = expr.add_rates(spark.createDataFrame([(0, 0)], "PA int, AB int"), "batting").first()
    assert all(r[c] is None for c in expr.BATTING)
    r = one(spark, "n double, d double", (1.0, -2.0), expr.safe_ratio(F.col("n"), F.col("d")))
    assert r[0] is None


def test_pitching_rates(spark):
    r = expr.add_rates(spark.createDataFrame([(180.1, 40.0, 700, 150, 50, 10, 160)], "IP double, ER double, batters_faced int, SO int, BB int, HR int, H int"), "pitching").first()
    assert r["era"] == pytest.approx(40 * 27 / 541) and r["h_pct"] == pytest.approx(160 / 700)


@pytest.mark.parametrize(("ip", "outs"), [(5.0, 15), (5.1, 16), (5.2, 17), (180.1, 541), (5.5, 16.5), (0.0, 0), (None, None)])
def test_outs(spark, ip, outs):
    r = one(spark, "ip double", (ip,), expr.outs(F.col("ip"), 2), expr.innings(expr.outs(F.col("ip"), 2)))
    assert r[0] == (None if outs is None else pytest.approx(outs))
    if outs is not None and ip != 5.5:
        assert r[1] == pytest.approx(ip)


@pytest.mark.parametrize(("text", "value"), [("1,234", 1234.0), ("inf", None), ("nan", None), ("x", None), (None, None), (".300", 0.3)])
def test_number(spark, text, value):
    assert one(spark, "c string", (text,), expr.number(F.col("c")))[0] == value


def eligible(spark, seasons, age, season=2026):
    rules = expr.eligibility(F.col("s"), F.col("a"), F.lit(season))
    return one(spark, "s int, a double", (seasons, age), *[c.alias(n) for n, c in rules.items()])


def test_eligibility(spark):
    young = eligible(spark, 3, 22.0)
    assert (young["earliest_posting_season"], young["age_at_earliest_posting"], young["bonus_pool_exempt_if_posted_then"], young["note"]) == (2030, 26.0, True, "market contract")
    assert (young["domestic_fa_season"], young["overseas_fa_season"], young["acquisition_window_seasons"], young["window"]) == (2032, 2031, 2, "2030-2031")
    capped = eligible(spark, 7, 23.0)
    assert not capped["bonus_pool_exempt_if_posted_then"] and capped["extra_years_for_pool_exemption"] == 2.0 and capped["window"] == "2026-2027"
    veteran = eligible(spark, 11, 33.0)
    assert veteran["past_first_fa"] and veteran["window"] == "closed" and veteran["acquisition_window_seasons"] == 0


def test_labels(spark):
    said = lambda lo, hi: one(spark, "lo double, hi double", (lo, hi), expr.informative(F.col("lo"), F.col("hi")))[0]
    assert said(1.0, 2.9) and not said(1.0, 3.0) and not said(0.0, 1.0) and not said(None, 1.0)
    trust = lambda n, r: one(spark, "n boolean, r double", (n, r), expr.trust(F.col("n"), F.col("r")))[0]
    assert [trust(True, 0.2), trust(False, 0.2), trust(True, 0.05), trust(False, 0.05), trust(True, None)] == ["usable", "too wide", "league average regardless", "too wide", "league average regardless"]
    verdict = lambda *x: one(spark, "r double, s double, d double", x, expr.verdict(F.col("r"), F.col("s"), F.col("d")))[0]
    assert verdict(0.45, 0.5, 0.7) == "real pattern, too wide for one player" and verdict(0.45, 0.5, 0.1) == "usable signal"
    assert verdict(0.15, 0.5, 0.1) == "weak signal" and verdict(0.05, 0.9, 0.1) == "no usable signal"


def test_lookups(spark):
    rows = spark.createDataFrame([("era",), ("avg",), ("zzz",)], "stat string")
    assert [r[0] for r in rows.orderBy(expr.display_rank(F.col("stat"))).select(expr.pretty(F.col("stat"))).collect()] == ["Batting average", "Earned run average", "zzz"]
