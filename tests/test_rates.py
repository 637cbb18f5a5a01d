import pytest

from parallax.functions.expr import BATTING
from parallax.operators import rates

TOTALS = "season int, side string, PA double, AB double, H double, HR double, SO double, BB double, HBP double, SF double, TB double, IP double, ER double, batters_faced double"
LEAGUE = (2024, "batting", 57263.0, 50205.0, 13929.0, 1438.0, 10826.0, 5265.0, 783.0, 528.0, 21082.0, None, None, None)


def test_league_totals_as_a_player_are_average(spark):
    totals = spark.createDataFrame([LEAGUE], TOTALS)
    got = rates.relative_rates(totals.drop("side"), rates.league_rates(totals, "batting"), "batting").first()
    assert all(got[f"rel_{r}"] == pytest.approx(1.0) for r in BATTING)


def test_minimum_exposure_and_seasons_without_a_league_row(spark):
    totals = spark.createDataFrame([LEAGUE], TOTALS)
    players = spark.createDataFrame([("p1", 2024, 600.0, 100.0), ("p2", 2024, 12.0, 2.0), ("p3", 2023, 600.0, 90.0), ("p4", 2024, None, 1.0)], "p string, season int, PA double, SO double")
    got = {r["p"]: r["rel_k_pct"] for r in rates.relative_rates(players, rates.league_rates(totals, "batting"), "batting", 100).collect()}
    assert got == {"p1": pytest.approx((100 / 600) / (10826 / 57263)), "p3": None}
    assert rates.relative_rates(players, rates.league_rates(totals, "batting"), "batting", 0).count() == 4


def test_innings_are_summed_as_outs(spark):
    rows = [(2024, "pitching", *[None] * 9, ip, er, 10.0) for ip, er in ((5.2, 3.0), (3.2, 1.0))]
    got = rates.league_rates(spark.createDataFrame(rows, TOTALS), "pitching").first()
    assert got["lg_era"] == pytest.approx(4 * 27 / 28)


def test_empty_table(spark):
    assert rates.league_rates(spark.createDataFrame([], TOTALS), "batting").count() == 0
