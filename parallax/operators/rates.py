"""Group-normalised rates: a group's rate in a season divided by the rate of all in that season."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from parallax.functions.expr import PLAYING_TIME, RATE_SETS, add_rates, innings, outs, safe_ratio


def at_least(df: DataFrame, column: str, n: float) -> DataFrame:
    """Minimum exposure, null counts as 0; no filter where ``n`` is 0 or less, or the column is absent.

    A plain comparison drops nulls by itself, and unlike one on coalesce it reaches the scan.
    """
    return df.filter(F.col(column) >= n) if n > 0 and column in df.columns else df


def ratio_of_sums(df: DataFrame, by: list[str], rates: Mapping[str, tuple[Column, Column]], prefix: str = "") -> DataFrame:
    """Rates of grouped sums: safe_ratio(sum(num), sum(den)) for each name."""
    sums = df.groupBy(*by).agg(*[F.sum(c).alias(f"_{k}_{name}") for name, pair in rates.items() for k, c in zip("nd", pair, strict=True)])
    return sums.select(*by, *[safe_ratio(F.col(f"_n_{name}"), F.col(f"_d_{name}")).alias(f"{prefix}{name}") for name in rates])


def league_rates(totals: DataFrame, side: str) -> DataFrame:
    """(season, lg_*): rates of a side's summed rows of each season.

    Sums skip nulls, and are zero where all are null; innings are summed as outs.
    """
    own = totals.filter(F.col("side") == side) if "side" in totals.columns else totals
    numeric = [f.name for f in own.schema if isinstance(f.dataType, NumericType) and f.name != "season"]
    sums = [(innings(F.sum(outs(F.col(c)))) if c == "IP" else F.coalesce(F.sum(f"`{c}`"), F.lit(0))).alias(c) for c in numeric]
    summed = own.filter("season IS NOT NULL").groupBy("season").agg(*sums) if sums else own.select("season").distinct()
    return add_rates(summed, side, "lg_").select(F.col("season").cast("int").alias("season"), *[f"lg_{r}" for r in RATE_SETS[side]])


def relative_rates(players: DataFrame, league: DataFrame, side: str, min_playing_time: float = 0) -> DataFrame:
    """Players with their rates, their league's and rel_*; seasons without a league row get null rel_*.

    The league has a row a season, so Catalyst may broadcast it by its measured size.
    """
    own = add_rates(at_least(players, PLAYING_TIME[side], min_playing_time), side)
    joined = own.withColumn("season", F.col("season").cast("int")).join(league, "season", "left")
    return joined.withColumns({f"rel_{r}": safe_ratio(F.col(r), F.col(f"lg_{r}")) for r in RATE_SETS[side]})
