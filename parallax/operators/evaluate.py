"""Hold-out validation against two do-nothing baselines, and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallax.functions.expr import PLAYING_TIME, RATE_SETS
from parallax.operators import model
from parallax.operators.timeline import LEAGUES, POSTED
from parallax.sources.stored import stored


def split(pairs: DataFrame, cohort: str = POSTED, direction: str | None = None, leagues: tuple[str, str] = LEAGUES) -> tuple[DataFrame, DataFrame]:
    """(train, test): all but a cohort, perhaps of one direction; the cohort's forward crossings. Null cohorts train."""
    if "cohort" not in pairs.columns:
        raise ValueError("pairs have no column cohort: attach cohorts first")
    train = pairs.filter(~F.col("cohort").eqNullSafe(cohort))
    train = train.filter(F.col("direction") == direction) if direction else train
    return train, pairs.filter((F.col("cohort") == cohort) & (F.col("direction") == f"{leagues[0]}_to_{leagues[1]}"))


def holdout(pairs: DataFrame, side: str, cohort: str = POSTED, stats: list[str] | None = None, draws: int = 200, key: str = "player_register_id", direction: str | None = None, order: str | None = None, leagues: tuple[str, str] = LEAGUES) -> DataFrame:
    """Fit without a cohort and predict it: a row for each held-out crossing and fitted statistic.

    Values are rounded to three decimals; in_interval is decided before, ends included.
    """
    a, b = leagues
    train, test = split(pairs, cohort, direction, leagues)
    stats = stats or list(RATE_SETS[side])
    rows = stored(model.design(train, stats, key, leagues, order), "design")  # fits, sizes, numbers and draws read it
    fits = model.fit(rows)
    drawn = model.with_noise(model.bootstrap(rows, draws))
    stats = [s for s in stats if f"{a}_rel_{s}" in pairs.columns and f"{b}_rel_{s}" in pairs.columns]
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(f"{a}_rel_{s}").cast("double").alias("rate"), F.col(f"{b}_rel_{s}").cast("double").alias("actual")) for s in stats]))
    age = F.coalesce(F.col(f"{a}_age").cast("double"), F.lit(model.AGE_CENTRE)) if f"{a}_age" in pairs.columns else F.lit(model.AGE_CENTRE)
    cases = test.select(F.col("player"), key, F.col(f"{a}_season"), F.col(f"{b}_season"), age.alias("age"), each.alias("s"))
    cases = cases.select("player", key, f"{a}_season", f"{b}_season", "age", "s.*").filter((F.col("rate") > 0) & F.col("actual").isNotNull() & ~F.isnan("actual"))
    out = model.with_intervals(cases.join(F.broadcast(fits), "stat"), drawn)  # fits: a row for each statistic
    inside = F.when(F.col("n_draws").isNotNull(), F.col("actual").between(F.col("p10"), F.col("p90")))
    third = lambda c: F.bround(c, 3)
    return out.select(
        "player", key, "stat", f"{a}_season", f"{b}_season", "age", third("rate").alias("kbo_relative"), third(model.predicted(F.col("rate"), F.col("age"))).alias("predicted"),
        third("actual").alias("actual"), third("p10").alias("p10"), third("p90").alias("p90"), inside.alias("in_interval"),
    )


def scorecard(cases: DataFrame, by: str = "stat") -> DataFrame:
    """Mean absolute errors by statistic of the model, of "league average" (1) and of "stays as he is"."""
    errors = {"mae_model": F.abs(F.col("predicted") - F.col("actual")), "mae_league_average": F.abs(1.0 - F.col("actual")), "mae_carry_over": F.abs(F.col("kbo_relative") - F.col("actual"))}
    means = cases.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(e).alias(c) for c, e in errors.items()], F.avg(F.col("in_interval").cast("double")).alias("interval_coverage"))
    return means.select(
        by, "n", *[F.bround(c, 3).alias(c) for c in errors], (F.col("mae_model") < F.col("mae_league_average")).alias("beats_league_average"),
        (F.col("mae_model") < F.col("mae_carry_over")).alias("beats_carry_over"), F.bround("interval_coverage", 3).alias("interval_coverage"),
    ).orderBy(by)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Of positive values; null where none is."""
    counts = (value > 0) & ~F.isnan(value)
    total = F.sum(F.when(counts, weight))
    return F.when(total > 0, F.sum(F.when(counts, value * weight)) / F.when(total > 0, total))


def project(rows: DataFrame, drawn: DataFrame, league: DataFrame, side: str, stats: list[str], key: str = "player_register_id", recent: int = 3) -> DataFrame:
    """Projections of players' last ``recent`` rows: by player and statistic, relative and as rates of the latest league row.

    Rates are averaged by playing time, equally where there is none. ``drawn``: draws with noise.
    """
    last = Window.partitionBy(key).orderBy(F.desc("season"))
    kept = rows.withColumn("_k", F.row_number().over(last)).filter(F.col("_k") <= recent)
    pt = next((c for c in (PLAYING_TIME[side], "PA", "batters_faced") if c in rows.columns), None)
    played = F.coalesce(F.col(pt).cast("double"), F.lit(0.0)) if pt else F.lit(0.0)
    total = F.sum(played).over(Window.partitionBy(key))
    kept = kept.withColumn("_w", F.when(total > 0, played).otherwise(1.0))
    stats = [s for s in stats if f"rel_{s}" in rows.columns]
    means = kept.groupBy(key).agg(F.max_by("age", F.col("season")).cast("double").alias("age"), *[weighted_mean(F.col(f"rel_{s}").cast("double"), F.col("_w")).alias(s) for s in stats])
    cases = means.select(key, "age", F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("rate")) for s in stats])).alias("s")).select(key, "age", "s.*").filter("rate > 0")
    cases = cases.withColumn("age", F.coalesce("age", F.lit(model.AGE_CENTRE)))
    said = model.with_intervals(cases, drawn).filter("n_draws IS NOT NULL")
    newest = league.agg(*[F.max_by(f"lg_{s}", F.col("season")).alias(s) for s in stats])
    rates = newest.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("lg")) for s in stats])).alias("l")).select("l.*")
    out = said.join(F.broadcast(rates), "stat")  # rates: a row for each statistic
    return out.select(
        key, "stat", "age", F.bround("rate", 3).alias("kbo_relative"), F.bround("point", 3).alias("proj_mlb_relative"), F.bround("p10", 3).alias("p10_relative"), F.bround("p90", 3).alias("p90_relative"),
        F.bround("lg", 4).alias("mlb_league_rate"), *[F.bround(F.col(c) * F.col("lg"), 4).alias(n) for c, n in (("point", "proj_mlb_rate"), ("p10", "p10_rate"), ("p90", "p90_rate"))],
    )
