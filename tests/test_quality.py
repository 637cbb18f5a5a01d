import pytest
from pyspark.sql import functions as F

from parallax.operators import quality, resolve

SCHEMA = "player_register_id string, player string, season int, team_bref_id string, PA double, AB double, H double, `2B` double, `3B` double, HR double, TB double, batting_avg double, G double, age double"
ROWS = [("a", "A", 2020, "T1", 500.0, 450.0, 150.0, 30.0, 3.0, 20.0, 246.0, 0.333, 140.0, 25.0), ("a", "A", 2020, "T2", 100.0, 90.0, 30.0, 5.0, 1.0, 5.0, 52.0, 0.333, 30.0, 25.0), ("b", "B", 2021, "T1", 10.0, 10.0, 2.0, 0.0, 0.0, 0.0, 2.0, 0.2, 5.0, 30.0)]


@pytest.fixture
def batting(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def verdicts(df):
    return {r["name"]: (r["passed"], r["n_bad"]) for r in df.collect()}


def test_clean_rows_pass(spark, batting):
    checks = quality.audit([quality.uniqueness(batting, ["player_register_id", "season", "team_bref_id"], "d"), quality.missing_ids(batting, "player_register_id", "m"), quality.value_ranges(batting, "b"), quality.negative_counts(batting, "b"), quality.batting_identities(batting), quality.season_coverage(batting, 2020, 2021), quality.non_empty(batting, "b"), quality.required_columns(batting, quality.REQUIRED["batting"], "b")])
    assert all(ok for ok, _ in verdicts(checks).values()) and not quality.has_errors(checks)


@pytest.mark.parametrize(
    ("column", "value", "name", "n"),
    [("batting_avg", 1.4, "b.range.batting_avg", 3), ("age", 9.0, "b.range.age", 3), ("HR", -1.0, "b.negative_counts", 3), ("AB", 9999.0, "batting.pa_ge_ab", 3), ("HR", 999.0, "batting.hits_ge_extra_base", 3), ("TB", 1.0, "batting.total_bases_identity", 2), ("AB", None, None, 0)],
)
def test_planted_defects(batting, column, value, name, n):
    df = batting.withColumn(column, F.lit(value).cast("double"))
    got = verdicts(quality.audit([quality.value_ranges(df, "b"), quality.negative_counts(df, "b"), quality.batting_identities(df)]))
    assert {k: v for k, v in got.items() if not v[0]}.get(name) == ((False, n) if name else None)


def test_duplicates_and_missing_ids(spark, batting):
    twice = batting.union(batting.limit(1))
    assert verdicts(quality.uniqueness(twice, ["player_register_id", "season", "team_bref_id"], "d")) == {"d": (False, 2)}
    blank = batting.withColumn("player_register_id", F.when(F.col("season") == 2021, " ").otherwise(F.col("player_register_id")))
    assert verdicts(quality.missing_ids(blank, "player_register_id", "m")) == {"m": (False, 1)}
    assert verdicts(quality.missing_ids(batting.drop("player_register_id"), "player_register_id", "m")) == {"m": (False, 0)}


@pytest.mark.parametrize(("published", "passed", "severity"), [(25.0, True, "error"), (1438.0, False, "warning"), (10.0, False, "error")])
def test_league_totals(spark, batting, published, passed, severity):
    totals = spark.createDataFrame([(2020, published)], "season int, HR double")
    r = quality.league_totals(batting, totals).first()
    assert (r["passed"], r["severity"]) == (passed, severity)
    assert quality.league_totals(batting, totals.filter("season = 1")).first()["severity"] == "warning"


def test_league_sides(spark):
    rows = [(2020, "batting", 100.0, 1000.0, None), (2020, "pitching", 100.0, None, 1000.0), (2021, "batting", 100.0, 1000.0, None), (2021, "pitching", 150.0, None, 1000.0)]
    totals = spark.createDataFrame(rows, "season int, side string, SO double, PA double, batters_faced double")
    assert verdicts(quality.league_sides(totals)) == {"cross_source.league_sides": (False, 1)}


def test_crosswalk_checks(spark):
    m = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "player_register_id string, key_mlbam long")
    assert verdicts(quality.crosswalk_uniqueness(m)) == {"crosswalk.uniqueness": (False, 1)}
    people = spark.createDataFrame([(str(i),) for i in range(200)], "player_register_id string")
    for n, ok in ((10, False), (60, True), (190, False)):
        some = people.limit(n).withColumns({"match_tier": F.lit("x"), "key_mlbam": F.lit(1).cast("long")})
        assert quality.crosswalk_size(resolve.statistics(people, people, some, some)).first()["passed"] == ok


def test_null_share_coverage_and_empty(spark, batting):
    born = spark.createDataFrame([(1, None)] + [(i, "x") for i in range(9)], "i int, dob string")
    assert verdicts(quality.null_share(born, "dob", "n")) == {"n": (False, 1)}
    assert verdicts(quality.season_coverage(batting, 2019, 2021)) == {"coverage.seasons": (False, 1)}
    assert verdicts(quality.non_empty(batting.limit(0), "e")) == {"e.non_empty": (False, 1)}


def test_checks_of_one_table_share_a_pass(spark, batting):
    keys = ["player_register_id", "season", "team_bref_id"]
    checks = lambda df: [quality.uniqueness(df, keys, "d"), quality.uniqueness(df, ["player"], "p"), quality.missing_ids(df, "player_register_id", "m"), quality.value_ranges(df, "b"), quality.null_share(df, "TB", "n"), quality.non_empty(df, "e"), quality.batting_identities(df)]
    for df in (batting.union(batting.limit(2)).withColumn("age", F.col("age") * 9), batting.limit(0), batting.withColumn("TB", F.lit(None).cast("double"))):
        alone = [r for c in checks(df) for r in c.collect()]
        assert sorted(map(tuple, quality.audit(checks(df)).collect())) == sorted(map(tuple, alone))
    assert verdicts(quality.uniqueness(batting.withColumn("team_bref_id", F.lit(None).cast("string")), keys, "d")) == {"d": (False, 2)}
