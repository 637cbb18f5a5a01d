import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallax.operators import evaluate, model, screen
from parallax.plans.queries import DRAWS, draws_by_congruence

SCHEMA = "player_register_id string, player string, direction string, kbo_season int, mlb_season int, gap_years int, kbo_rel_k_pct double, mlb_rel_k_pct double, kbo_age double, kbo_PA double, mlb_PA double, cohort string"


def pairs(spark, n=180, noise=0.05, slope=0.6, level=-0.15, seed=7, forward=0.5, posted=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, age, fwd = rng.normal(0, 0.35), rng.uniform(22, 34), rng.random() < forward or i < posted
        y = level + slope * x + 0.02 * (age - 27) / 10 + 0.1 * fwd + rng.normal(0, noise)
        rows.append((f"p{i % max(1, n - 20)}", f"P{i}", "kbo_to_mlb" if fwd else "mlb_to_kbo", 2012, 2013, 1, float(np.exp(x)), float(np.exp(y)), float(age), 400.0 + i, 300.0, "posted_from_kbo" if i < posted else "import_returnee"))
    return spark.createDataFrame(rows, SCHEMA)


def least_squares(df):
    rows = df.collect()
    x = np.array([[1, np.log(r["kbo_rel_k_pct"]), (r["kbo_age"] - 27) / 10, r["direction"] == "kbo_to_mlb"] for r in rows], float)
    y, w = np.log([r["mlb_rel_k_pct"] for r in rows]), np.sqrt([min(r["kbo_PA"], r["mlb_PA"]) for r in rows])
    beta = np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
    e = y - x @ beta
    mean = (w * y).sum() / w.sum()
    return beta, np.sqrt((w * e * e).sum() / max(len(y) - 4, 1)), 1 - (w * e * e).sum() / (w * (y - mean) ** 2).sum()


def test_parameters_are_recovered(spark):
    df = pairs(spark)
    r = model.fit_pairs(df, "batting").first()
    beta, sd, r2 = least_squares(df)
    assert abs(r["retention_slope"] - 0.6) < 0.06 and r["r_squared"] > 0.8 and r["n_pairs"] == 180 and r["n_players"] == 160
    assert [r["intercept"], r["retention_slope"], r["age_coef"], r["direction_coef"]] == pytest.approx(beta.tolist(), abs=1e-6)
    assert r["residual_sd"] == pytest.approx(sd, rel=1e-6) and r["r_squared"] == pytest.approx(r2, rel=1e-6)


@pytest.mark.parametrize("forward", [0.0, 1.0])
def test_one_direction_gives_the_shortest_solution(spark, forward):
    r = model.fit_pairs(pairs(spark, forward=forward), "batting").first()
    assert r["direction_coef"] == pytest.approx(r["intercept"] if forward else 0.0, abs=1e-6)


def test_too_few_pairs_and_nothing_positive(spark):
    assert model.fit_pairs(pairs(spark, n=5), "batting").count() == 0
    assert model.fit_pairs(pairs(spark).withColumn("kbo_rel_k_pct", F.lit(0.0)), "batting").count() == 0
    assert model.fit_pairs(pairs(spark).drop("kbo_rel_k_pct"), "batting").count() == 0


def test_absent_age_is_27_and_absent_playing_time_weighs_one(spark):
    rows = model.design(pairs(spark, n=25).drop("kbo_age", "kbo_PA", "mlb_PA"), ["k_pct"])
    assert {(r["x2"], r["w"]) for r in rows.collect()} == {(0.0, 1.0)}


def test_bootstrap_equals_refits_on_resampled_rows(spark):
    df = pairs(spark, n=60).coalesce(1)
    rows = model.design(df, ["k_pct"], order=None).cache()
    own = rows.orderBy("key").collect()
    x, y, w = np.array([[r[c] for c in model.X] for r in own]), np.array([r["y"] for r in own]), np.array([r["w"] for r in own])
    first = {k: i for i, k in enumerate(dict.fromkeys(r["key"] for r in own))}
    codes = np.array([first[r["key"]] for r in own])
    n = len(first)
    for got in model.bootstrap(rows, 5, seed=4).orderBy("at").collect():
        players, k = model.picked((4, "k_pct", got["draw"]), 0, n, n)
        at = np.concatenate([np.flatnonzero(codes == p) for p in np.repeat(players, k)])
        root = np.sqrt(w[at])
        beta = np.linalg.lstsq(x[at] * root[:, None], y[at] * root, rcond=None)[0]
        e = y[at] - x[at] @ beta
        assert [got[f"b{i}"] for i in range(4)] == pytest.approx(beta.tolist(), abs=1e-6)
        assert got["sd"] == pytest.approx(np.sqrt((w[at] * e * e).sum() / (len(at) - 4)), rel=1e-6)


def test_players_are_numbered_by_key_in_every_partitioning(spark):
    keys = [f"{a}{i:03d}" for a in ("x", "pla", "player", "") for i in range(120)]
    rows = spark.createDataFrame([(s, k, -1) for s in ("k", "bb") for k in keys for _ in range(2)], "stat string, key string, o long")
    wanted = {(s, k): i for s in ("k", "bb") for i, k in enumerate(sorted(keys))}
    for df in (rows.coalesce(1), rows.repartition(5)):
        assert {(r["stat"], r["key"]): r["code"] for r in model.codes(df).collect()} == wanted
    ordered = spark.createDataFrame([("k", k, 70_000 * i) for i, k in enumerate(reversed(keys))], "stat string, key string, o long")
    assert {r["key"]: r["code"] for r in model.codes(ordered).collect()} == {k: i for i, k in enumerate(reversed(keys))}


def test_multiplicities_are_the_same_however_dealt(spark):
    sizes = [("a", 7), ("b", 3000), ("c", 64), ("d", 65), ("e", 1)]
    players = spark.createDataFrame(sizes, "stat string, players long")
    got = [sorted(map(tuple, model.multiplicities(df, 9, 3, block=64).collect())) for df in (players.coalesce(1), players.repartition(4))]
    assert got[0] == got[1] and len({r[:3] for r in got[0]}) == len(got[0])
    total = {}
    for stat, draw, code, k in got[0]:
        assert 0 <= code < dict(sizes)[stat] and k >= 1
        total[stat, draw] = total.get((stat, draw), 0) + k
    assert total == {(s, d): n for s, n in sizes for d in range(9)}
    assert sorted(map(tuple, model.multiplicities(players, 9, 3).filter("draw = 8 AND stat = 'a'").collect())) == [r for r in got[0] if r[:2] == ("a", 8)]
    assert model.multiplicities(players, 0, 3).count() == 0 == model.multiplicities(players.limit(0), 5, 3).count()


def test_splits_and_picks_are_multinomial():
    blocks, players = np.zeros((400, 5)), np.zeros((400, 300))
    for d in range(400):
        for low, size, picks in model.blocks_of((1, "s", d), 300, 64):
            blocks[d, low // 64] = picks
            code, k = model.picked((1, "s", d), low, size, picks)
            players[d, code] += k
    assert (blocks.sum(1) == 300).all() and (players.sum(1) == 300).all()
    assert blocks.mean(0) == pytest.approx([64, 64, 64, 64, 44], abs=1.5) and blocks.var(0) == pytest.approx([300 * p * (1 - p) for p in (64 / 300,) * 4 + (44 / 300,)], rel=0.35)
    assert players.mean() == 1 and players.var() == pytest.approx(1 - 1 / 300, rel=0.03) and (players == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)
    assert abs(np.corrcoef(players[:, 0], players[:, 1])[0, 1]) < 0.15


def test_draws_do_not_depend_on_the_size_of_blocks(spark):
    players = spark.createDataFrame([("b", 3000)], "stat string, players long")
    wanted = [("b", d, int(c), float(k)) for d in range(3) for c, k in zip(*model.picked((3, "b", d), 0, 3000, 3000), strict=True)]
    for block in (64, 1000, 3000):
        assert sorted(map(tuple, model.multiplicities(players, 3, 3, block=block).collect())) == wanted


def test_picks_are_not_broadcast(spark):
    rows = model.design(pairs(spark, n=60), ["k_pct"])
    few = spark.createDataFrame([("k_pct", 0, 1, 2.0)], "stat string, draw int, code long, k double")
    for drawn in (None, few, draws_by_congruence(rows)):
        plan = model.bootstrap(rows, 3, drawn=drawn)._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"SortMergeJoin .*code", plan) and not re.search(r"BroadcastHashJoin .*code", plan)


def test_picks_of_one_statistic_are_dealt(spark):
    sizes = spark.createDataFrame([("a", i) for i in range(model.BLOCK + 10)], "stat string, key int").coalesce(1)
    assert draws_by_congruence(sizes).agg(F.sum("k")).first()[0] == DRAWS * (model.BLOCK + 10)
    players = spark.createDataFrame([("a", 2000)], "stat string, players long")
    assert model.dealt(players.select(F.explode(F.sequence(F.lit(1), F.lit(40))).alias("i")), "i").select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_cases_of_intervals_stay_where_they_are(spark):
    drawn = spark.createDataFrame([("a", 0.1, 1.0, 0.0, 0.0, 0.1), ("a", None, 1.0, 0.0, 0.0, 0.0), ("a", 0.3, 1.0, 0.0, 0.0, -0.1)], "stat string, b0 double, b1 double, b2 double, b3 double, noise double")
    cases = spark.createDataFrame([(1, "a", 2.0, 27.0), (2, "b", 1.0, 27.0), (3, "a", 0.0, 27.0)], "case int, stat string, rate double, age double")
    out = model.intervals(cases, drawn, "case")
    assert "hashpartitioning(case" not in out._jdf.queryExecution().executedPlan().toString()
    (r,) = out.collect()
    assert (r["case"], r["n_draws"]) == (1, 3) and r["point"] == pytest.approx(2 * np.exp(0.2)) and r["p10"] == pytest.approx(2 * np.exp(0.2)) == r["p90"]


def test_noise_is_normal_and_shared_by_statistics(spark):
    drawn = spark.range(6000).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("stat"), F.col("id").cast("int").alias("at"), F.lit(2.0).alias("sd"))
    rows = model.with_noise(drawn, 5).collect()
    z = np.array([r["noise"] for r in rows if r["stat"] == "a"]) / 2
    assert {(r["at"], r["noise"]) for r in rows if r["stat"] == "a"} == {(r["at"], r["noise"]) for r in rows if r["stat"] == "b"}
    assert abs(z.mean()) < 0.05 and z.std() == pytest.approx(1, abs=0.03) and (np.abs(z) < 1.96).mean() == pytest.approx(0.95, abs=0.01)


def test_solves_of_empty_and_constant_sums(spark):
    rows = model.design(pairs(spark, n=30).withColumn("mlb_rel_k_pct", F.lit(1.5)), ["k_pct"])
    r = model.fit(rows).first()
    assert r["r_squared"] is None and r["residual_sd"] == pytest.approx(0.0, abs=1e-6)
    assert model.solve(model.fit_sums(rows.limit(0))).count() == 0 == model.bootstrap(rows.limit(0), 3).count()


def test_intervals(spark):
    case = spark.createDataFrame([(1, "k_pct", 1.2, 27.0)], "case int, stat string, rate double, age double")
    wide = []
    for noise in (0.03, 0.30):
        drawn = model.with_noise(model.bootstrap(model.design(pairs(spark, n=120, noise=noise), ["k_pct"]), 40))
        r = model.intervals(case, drawn, "case").first()
        rows = sorted(drawn.collect(), key=lambda r: r["at"])
        centre = np.array([r["b0"] + r["b1"] * np.log(1.2) + r["b3"] for r in rows])
        sample = np.exp(centre + [r["noise"] for r in rows])
        assert [r["p10"], r["p50"], r["p90"]] == pytest.approx(np.percentile(sample, [10, 50, 90]).tolist()) and r["point"] == pytest.approx(np.exp(centre.mean()))
        wide.append(r["p90"] / r["p10"])
    assert wide[1] > wide[0]


def test_inversion(spark):
    r = model.inversion(model.design(pairs(spark), ["k_pct"])).first()
    assert r["slope_product_equals_r2"] == pytest.approx(r["r_squared"]) and r["naive_inverted_slope"] > r["slope_mlb_on_kbo"]


def test_holdout(spark):
    df = pairs(spark, posted=12)
    cases = evaluate.holdout(df, "batting", draws=60)
    assert cases.count() == 12
    r = evaluate.scorecard(cases).first()
    assert r["n"] == 12 and r["beats_league_average"] and r["beats_carry_over"] and r["interval_coverage"] >= 0.5
    with pytest.raises(ValueError):
        evaluate.split(df.drop("cohort"))
    assert evaluate.split(df.withColumn("cohort", F.lit(None).cast("string")))[0].count() == 180


def test_scorecard_of_perfect_and_bad(spark):
    schema = "stat string, predicted double, actual double, kbo_relative double, in_interval boolean"
    r = evaluate.scorecard(spark.createDataFrame([("a", 1.2, 1.2, 1.5, True), ("b", 3.0, 1.0, 1.0, None)], schema)).collect()
    assert (r[0]["mae_model"], r[0]["beats_league_average"], r[0]["interval_coverage"]) == (0.0, True, 1.0)
    assert not r[1]["beats_league_average"] and r[1]["interval_coverage"] is None


def test_projection(spark):
    drawn = model.with_noise(model.bootstrap(model.design(pairs(spark), ["k_pct"]), 30))
    rows = spark.createDataFrame([("p", 2019, 9.0, 24, 900.0), ("p", 2020, 1.0, 25, 100.0), ("p", 2021, 2.0, 26, 300.0), ("p", 2022, None, 27, 500.0)], "player_register_id string, season int, rel_k_pct double, age int, PA double")
    league = spark.createDataFrame([(2021, 0.2), (2022, 0.25)], "season int, lg_k_pct double")
    r = evaluate.project(rows, drawn, league, "batting", ["k_pct"]).first()
    assert r["kbo_relative"] == pytest.approx((1.0 * 100 + 2.0 * 300) / 400, abs=1e-3) and r["age"] == 27 and r["mlb_league_rate"] == 0.25
    assert r["proj_mlb_rate"] == pytest.approx(r["proj_mlb_relative"] * 0.25, abs=2e-3) and r["p10_rate"] < r["p90_rate"]


ROWS = "player_register_id string, player string, season int, age int, PA double, batters_faced double, obp double, slg double, lg_obp double, lg_slg double, rel_k_pct double"


def test_scores(spark):
    def score(side, *rows):
        df = spark.createDataFrame([("p", "P", *r) for r in rows], ROWS)
        return screen.score(df, side, ["player_register_id"]).first()["score"]

    assert score("batting", (2020, 25, 100.0, None, 0.4, 0.6, 0.35, 0.4, None)) == pytest.approx(1.0 / 0.75)
    assert 1.0 < score("batting", (2020, 25, 600.0, None, 0.35, 0.4, 0.35, 0.4, None), (2021, 26, 60.0, None, 0.7, 0.8, 0.35, 0.4, None)) < 1.10
    assert score("batting", (2020, 25, 0.0, None, 0.4, 0.6, 0.35, 0.4, None)) == pytest.approx(1.0 / 0.75)
    assert score("batting", (2020, 25, 100.0, None, None, 0.6, 0.35, 0.4, None)) is None
    assert score("pitching", (2020, 25, None, 300.0, None, None, None, None, 1.2), (2021, 26, None, 100.0, None, None, None, None, None)) == pytest.approx(0.9)


def test_screen_and_profile(spark):
    home = spark.createDataFrame([("star", "Star", y, 25, 500.0, None, 0.4, 0.6, 0.35, 0.4, None) for y in (2021, 2022, 2023)] + [("imp", "Imp", 2019, 30, 500.0, None, 0.3, 0.4, 0.35, 0.4, None)], ROWS)
    posted = spark.createDataFrame([("star", 2023), ("imp", 2020), ("none", None)], "player_register_id string, first_mlb int")
    profile = screen.profile(home, posted, "batting", lambda name, key: name != "Imp")
    assert [tuple(r) for r in profile.collect()] == [("Star", "star", 2023, 1.333, 25.0)]
    now = spark.createDataFrame([("a", 1.4), ("b", 1.0), ("c", None)], "player string, score double")
    r = screen.screen_counts(now, profile.select("player", "score"), "no such setting").first()
    assert (r["threshold"], r["admitted"], r["of_total"], r["historical_caught"], r["historical_total"], r["historical_missed"]) == (1.333, 1, 3, 1, 1, 0)
    cohort = spark.createDataFrame([("x", 1.0), ("y", 1.2), ("z", 1.4), ("n", None)], "player string, score double")
    assert sorted(r["player"] for r in screen.missed(cohort).collect()) == ["n", "x"] and screen.missed(cohort.limit(0)).count() == 0
    r = screen.screen_counts(now, profile.select("player", "score").limit(0)).first()
    assert (r["threshold"], r["admitted"], r["historical_total"]) == (None, 3, 0)
