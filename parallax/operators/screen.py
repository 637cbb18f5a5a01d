"""Screening against a historical cohort: scores, profile, bar, and what the bar costs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.operators.orderstat import quantiles
from parallax.operators.timeline import recent_before

# The share of the historical cohort that a setting leaves under the bar.
STRICTNESS = {"permissive": 0.0, "balanced": 0.25, "strict": 0.50}


def ratio_of_weighted(num: Column, den: Column, weight: Column) -> Column:
    """sum(num * w) / sum(den * w); all weigh 1 where the weights add up to nothing."""
    w = F.coalesce(weight, F.lit(0.0))
    weighed = F.sum(w) > 0
    n = F.when(weighed, F.sum(num * w)).otherwise(F.sum(num))
    d = F.when(weighed, F.sum(den * w)).otherwise(F.sum(den))
    return F.when(d > 0, n / F.when(d > 0, d))


def score(rows: DataFrame, side: str, by: list[str]) -> DataFrame:
    """(by, score) of each group's rows: batters' OPS over their leagues', pitchers' relative strikeout rate.

    A row without OPS still counts in the leagues' sum, a null strikeout rate as 0; nothing to score is null.
    """

    def col(c: str) -> Column:
        return F.col(c).cast("double") if c in rows.columns else F.lit(None).cast("double")

    if side == "batting":
        ops = col("obp") + col("slg")
        found = ratio_of_weighted(ops, col("lg_obp") + col("lg_slg"), col("PA"))
        return rows.groupBy(*by).agg(F.when(F.count(ops) > 0, found).alias("score"))
    found = ratio_of_weighted(F.coalesce(col("rel_k_pct"), F.lit(0.0)), F.lit(1.0), col("batters_faced"))
    return rows.groupBy(*by).agg(F.when(F.count(col("rel_k_pct")) > 0, found).alias("score"))


def profile(home: DataFrame, posted: DataFrame, side: str, is_korean: Callable[[Column, Column], Column] | None = None, seasons: int = 2, key: str = "player_register_id", first: str = "first_mlb") -> DataFrame:
    """(player, key, first_mlb, score, age_last_kbo) of those who crossed, from their last rows before; best first."""
    pivots = posted.filter(F.col(first).isNotNull()).select(key, F.col(first).cast("int").alias("pivot")).dropDuplicates([key])
    rows = recent_before(home, pivots, key, "season", seasons)
    last = rows.groupBy(key).agg(F.min("pivot").alias(first), F.max_by("player", -F.col("recency")).alias("player"), F.max_by(F.col("age").cast("double"), -F.col("recency")).alias("age_last_kbo"))
    if is_korean is not None:
        last = last.filter(is_korean(F.col("player"), F.col(key)))
    out = last.join(score(rows, side, [key]), key).filter(F.col("score").isNotNull())
    return out.select("player", key, first, F.bround("score", 3).alias("score"), "age_last_kbo").orderBy(F.desc("score"), key)


def bar(scores: DataFrame, strictness: str = "balanced", column: str = "score") -> DataFrame:
    """One row: the exact quantile of a setting (unknown ones are balanced); null without scores."""
    found = quantiles(scores, column, [STRICTNESS.get(strictness, STRICTNESS["balanced"])])
    return found.agg(F.max(F.get("q", F.lit(0))).alias("threshold"))


def screened(candidates: DataFrame, threshold: DataFrame, column: str = "score") -> DataFrame:
    """Candidates with ``admitted``: at or over the bar; everyone where there is none, no one without a score."""
    admitted = F.when(F.col("threshold").isNull(), True).otherwise(F.coalesce(F.col(column) >= F.col("threshold"), F.lit(False)))
    return candidates.crossJoin(F.broadcast(threshold)).withColumn("admitted", admitted)  # the bar is one row


def screen_counts(candidates: DataFrame, cohort: DataFrame, strictness: str = "balanced") -> DataFrame:
    """One row: the bar, how many candidates it admits, and how many of the cohort it would have caught; ``missed`` names the others."""
    threshold = bar(cohort, strictness)
    now = screened(candidates, threshold).agg(F.count_if("admitted").alias("admitted"), F.count(F.lit(1)).alias("of_total"))
    over = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False))
    then = cohort.crossJoin(F.broadcast(threshold)).agg(
        F.count_if(over).alias("historical_caught"), F.count(F.lit(1)).alias("historical_total"), F.count_if(~over).alias("historical_missed")
    )
    return threshold.select(F.bround("threshold", 3).alias("threshold")).crossJoin(now).crossJoin(then)


def missed(cohort: DataFrame, strictness: str = "balanced") -> DataFrame:
    """The rows of the cohort that the bar would have missed; a null score is one."""
    return screened(cohort, bar(cohort, strictness)).filter(F.col("threshold").isNotNull() & ~F.col("admitted")).drop("admitted", "threshold")
