"""The commands, end to end, over a synthetic pair of leagues."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallax.plans import cli, pipelines
from parallax.sources import fetch, tables

FAMILY = ["Lee", "Kim", "Park", "Choi", "Kang", "Yoon", "Jang", "Hwang"]
GIVEN = ["Jung", "Ha", "Byung", "Seung", "Min", "Tae", "Dong", "Kwang"]


def season(rng, id_, name, year, age, team, skill, pa=400):
    so = int(pa * 0.2 * np.exp(skill + rng.normal(0, 0.05)))
    ab, h, hr = int(pa * 0.9), int(pa * 0.25), int(pa * 0.03)
    return (id_, name, year, team, f"t{team}", float(age), float(pa), float(ab), float(h), 20.0, 2.0, float(hr), float(so), float(pa - ab), 3.0, 4.0, h + 20.0 + 4 + 3 * hr, float(pa), None, None, 100.0, h / ab, 0.3, 0.4, None)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    home, away, roster, links = [], [], [], []
    for i in range(90):
        given = f"{GIVEN[i % 8]}-{GIVEN[(i // 8) % 8].lower()}"
        name = f"{given} {FAMILY[(i * 3) % 8]}" if i % 3 else f"Import Player{chr(97 + i % 26)}{chr(97 + i // 26)}"
        posted, skill = i % 4 == 1, rng.normal(0, 0.3)
        years_home, years_away = (range(2015, 2020), range(2020, 2022)) if posted else (range(2019, 2023), range(2016, 2019))
        home += [season(rng, f"h{i}", name, y, 22 + y - 2015, i % 10, skill) for y in years_home]
        rows = [season(rng, f"h{i}", name, y, 22 + y - 2015, 0, 0.5 * skill) for y in years_away] if i < 70 else []
        away += [(1000 + i, None, r[1], r[2], r[5], *r[6:21]) for r in rows]
        roster.append((f"h{i}", name, 2019, f"T{i % 10}", date(1993, 1 + i % 12, 1 + i % 28), "Seoul, KR" if i % 3 else None))
        links.append((f"h{i}", 1000 + i, None, "register_id", 1.0))
    out = pipelines.Store(spark, str(tmp_path_factory.mktemp("league")))
    counts = [c.split()[0].strip("`") for c in pipelines.COUNTS.split(", ")]
    home_df = spark.createDataFrame(home, pipelines.HOME)
    out.write(home_df, "kbo_batting")
    out.write(home_df.withColumn("IP", F.lit(50.0)), "kbo_pitching")
    away_df = spark.createDataFrame(away, pipelines.AWAY)
    out.write(away_df, "mlb_batting")
    out.write(spark.createDataFrame(roster, pipelines.ROSTER), "kbo_roster")
    out.write(spark.createDataFrame(links, pipelines.LINKS), "crosswalk")
    for league, df in (("kbo", home_df), ("mlb", away_df)):
        totals = df.groupBy("season").agg(*[F.sum(f"`{c}`").alias(c) for c in counts])
        out.write(totals.withColumn("side", F.lit("batting")).unionByName(totals.withColumn("side", F.lit("pitching"))), f"{league}_league_totals")
    return out


def test_model_command(store):
    got = pipelines.fit(store, "batting", direction="mlb_to_kbo", draws=30)
    k = got.fits.filter("stat = 'k_pct'").first()
    assert 0.2 < k["retention_slope"] < 0.8 and k["r_squared"] > 0.3
    assert got.cases.select("player_register_id").distinct().count() > 5 and got.scores.filter("stat = 'k_pct'").first()["beats_carry_over"]
    assert "## Fits" in got.report and tables.exists(store.spark, f"{store.folder}/translation_batting.csv")
    with pytest.raises(tables.MissingInput):
        pipelines.fit(store, "pitching")


def test_audit_command(store):
    results, text, code = pipelines.audit(store, 2015, 2022)
    got = {r["name"]: r["passed"] for r in results.collect()}
    assert {name for name, ok in got.items() if not ok} == {"crosswalk.size"} and code == 1  # everyone here is linked
    assert got["crosswalk.uniqueness"]
    assert text.startswith("# Data audit") and "## Passed" in text
    assert pipelines.audit(store, 2010, 2022)[0].filter("name = 'coverage.seasons'").first()["n_bad"] == 5


def test_bundle(store):
    bundle = pipelines.load(store, "batting", 2022, direction="mlb_to_kbo", draws=20)
    roster = bundle.roster().collect()
    assert roster and all(r["korean"] and not r["past_first_fa"] and r["clears_screen"] for r in roster)
    assert bundle.roster(False).count() > len(roster)
    counts = bundle.screen().first()
    assert counts["historical_total"] > 3 and 0 < counts["admitted"] <= counts["of_total"]
    player = bundle.top(1).first()["player_register_id"]
    out = bundle.project([player]).collect()
    assert out[0]["stat"] == "avg" and {"trust", "label", "window", "p10_rate"} <= set(out[0].asDict())
    name = bundle.home.filter("player_register_id = 'h1'").first()["player"]
    assert bundle.find(" ".join(reversed(name.split()))).filter("player_register_id = 'h1'").count() >= 5
    assert set(r["verdict"] for r in bundle.quality().collect())


def test_counts_and_link(store, tmp_path):
    n = pipelines.sample_sizes(store, "batting").first()
    assert n["all"] == n["qualified"] == 70
    copy = pipelines.Store(store.spark, str(tmp_path))
    copy.write(store.read("kbo_roster", pipelines.ROSTER), "kbo_roster")
    register = store.read("kbo_roster", pipelines.ROSTER).select(F.col("player_register_id").alias("key_bbref_minors"), (F.substring("player_register_id", 2, 9).cast("long") + 1000).alias("key_mlbam"), F.split_part("player", F.lit(" "), F.lit(1)).alias("name_first"), F.split_part("player", F.lit(" "), F.lit(2)).alias("name_last"), F.year("date_of_birth").alias("birth_year"), F.month("date_of_birth").alias("birth_month"), F.day("date_of_birth").alias("birth_day"), F.lit("2020").alias("mlb_played_first"))
    found = pipelines.link(copy, register.withColumn("key_bbref_minors", F.when(F.col("key_mlbam") < 1045, F.col("key_bbref_minors"))))
    tiers = {r["match_tier"]: r["n"] for r in found.matches.groupBy("match_tier").agg(F.count("*").alias("n")).collect()}
    assert tiers["register_id"] == 45 and tiers["name_dob"] >= 40
    assert found.matches.filter("key_mlbam - 1000 != cast(substring(player_register_id, 2) as long)").count() == 0


def test_projections_and_command_line(store, capsys):
    name = store.read("kbo_batting", pipelines.HOME).filter("player_register_id = 'h2'").first()["player"]
    got = pipelines.projections(store, "batting", 2022, [name.upper()], draws=20)
    assert "h2" in {r["player_register_id"] for r in got.collect()} and store.exists("projections_batting_2022")
    args = cli.parser().parse_args(["counts", "--side", "batting", "--data", store.folder])
    assert cli.run(args, store) == 0 and "qualified" in capsys.readouterr().out
    assert cli.parser().parse_args(["model", "--data", "x", "--offline", "-v"]).side == "pitching"
    assert cli.run(cli.parser().parse_args(["audit", "--data", store.folder, "--start", "2015", "--end", "2022"]), store) == 1


def test_scrape_of_cached_pages(spark, tmp_path):
    from tests.test_sources import INDEX, SEASON, TEAM

    sites, cache = pipelines.SITES, fetch.PageCache(f"{tmp_path}/cache", lambda url: (200, pages[url]), fetch.RateLimiter(0, 100))
    one = spark.range(1)
    urls = one.select(sites.league_index(), sites.season(F.lit("s2024")), sites.team(F.lit("t1"))).first()
    pages = dict(zip(urls, (INDEX, SEASON, TEAM), strict=True))
    for url in urls:
        cache.get(url)
    out = pipelines.Store(spark, str(tmp_path))
    pipelines.scrape_cached(out, f"{tmp_path}/cache", 2020, 2026)
    assert out.read("kbo_batting", pipelines.HOME).count() == 2 and out.read("kbo_league_totals", pipelines.TOTALS).first()["PA"] == 48112


def test_refuses_thin_league_totals(spark, store, tmp_path):
    docs = spark.createDataFrame([('{"stats":[{"splits":[{"season":"2020","stat":{"homeRuns":5}}]}]}',)], "body string")
    keyed = docs.withColumn("key_mlbam", F.lit(1).cast("long"))
    out = pipelines.Store(spark, str(tmp_path))
    with pytest.raises(pipelines.TooFewTeams):
        pipelines.fetch_away(out, {"batting": keyed}, {"batting": docs}, 2000, 2026)
    pipelines.fetch_away(out, {"batting": keyed}, {"batting": docs}, 2020, 2020)
    assert out.read("mlb_batting", pipelines.AWAY).first()["HR"] == 5
