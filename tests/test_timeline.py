from pyspark.sql import functions as F

from parallax.operators import timeline


def seasons(spark, years, id_="p"):
    return spark.createDataFrame([(id_, y, 1.0 + y % 3, 25, 500) for y in years], "player_register_id string, season int, rel_k_pct double, age int, PA int")


def crossed(spark, home, away):
    return sorted((r["direction"], r["kbo_season"], r["mlb_season"], r["gap_years"]) for r in timeline.build_pairs(seasons(spark, home), seasons(spark, away)).collect())


def test_crossings(spark):
    assert crossed(spark, [2011, 2012], [2013, 2014]) == [("kbo_to_mlb", 2012, 2013, 1)]
    assert crossed(spark, range(2008, 2013), range(2013, 2018)) == [("kbo_to_mlb", 2012, 2013, 1)]
    assert crossed(spark, [2000], [2010]) == []
    assert crossed(spark, [2020, 2021], [2018, 2023]) == [("kbo_to_mlb", 2021, 2023, 2), ("mlb_to_kbo", 2020, 2018, 2)]
    assert crossed(spark, [2020], [2020]) == [("kbo_to_mlb", 2020, 2020, 0)]
    assert crossed(spark, [], [2020]) == []


def test_pair_columns(spark):
    away = seasons(spark, [2013]).withColumn("name", F.lit("N")).withColumn("rel_other", F.lit(1.0))
    r = timeline.build_pairs(seasons(spark, [2012]), away).first()
    assert (r["kbo_rel_k_pct"], r["mlb_rel_k_pct"], r["kbo_PA"], r["player"]) == (1.0 + 2012 % 3, 1.0 + 2013 % 3, 500, "N") and "kbo_rel_other" not in r.asDict()


def test_cohorts(spark):
    home = seasons(spark, [2006, 2007, 2008], "a").union(seasons(spark, [2015, 2016], "b")).union(seasons(spark, [2015], "c"))
    away = seasons(spark, [2013, 2014], "a").union(seasons(spark, [2012, 2019], "b")).union(seasons(spark, [2010], "d"))
    got = {r["player_register_id"]: (r["cohort"], r["first_kbo"], r["n_mlb"]) for r in timeline.classify(home, away).collect()}
    assert got == {"a": ("posted_from_kbo", 2006, 2), "b": ("import_returnee", 2015, 2), "c": ("unknown", 2015, None), "d": ("unknown", None, 1)}


def test_recent_before_counts_rows(spark):
    rows = spark.createDataFrame([("a", 2020, "x"), ("a", 2021, "x"), ("a", 2021, "y"), ("a", 2022, "z")], "k string, season int, team string")
    pivots = spark.createDataFrame([("a", 2022)], "k string, pivot int")
    got = timeline.recent_before(rows, pivots, "k", "season", 2, ties=("team",)).collect()
    assert sorted((r["season"], r["team"]) for r in got) == [(2021, "x"), (2021, "y")]


def test_congestion(spark):
    rows = spark.createDataFrame([("a", "T", 2028), ("b", "T", 2028), ("c", "U", 2028), ("d", None, 2028), ("e", None, 2028)], "p string, team_name string, earliest_posting_season int")
    got = {r["p"]: (r["club_eligible_that_year"], r["posting_likely_delayed"]) for r in timeline.congestion(rows).collect()}
    assert got == {"a": (2, True), "b": (2, True), "c": (1, False), "d": (1, False), "e": (1, False)}
    assert timeline.congestion(rows.drop("team_name")).first()["club_eligible_that_year"] == 1


def test_duplicates_and_latest(spark):
    rows = spark.createDataFrame([("a", 2020, "T"), ("a", 2020, "U"), ("b", 2020, "T"), ("b", 2020, "T")], "k string, season int, team string")
    assert {r["k"] for r in timeline.duplicates(rows, ["k", "season", "team"]).collect()} == {"b"} and timeline.duplicates(rows, ["k", "season", "team"]).count() == 2
    assert timeline.latest(rows, "k", F.desc("season"), F.asc("team")).count() == 2
