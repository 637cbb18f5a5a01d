"""Weighted translation models, their bootstrap and prediction intervals.

Fits need only sums of weighted products by statistic (a 4 x 4 matrix each), which Spark makes with
partial aggregation; the solves run where the sums are, many at a time. The same holds for each bootstrap draw.

A draw picks as many players as there are, with replacement. A pick is a number hashed from the draw's name and a
counter, scaled to the players. So any task can make any block of picks alone, and a player's picks are added.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parallax.functions.expr import RATE_SETS
from parallax.operators.timeline import LEAGUES
from parallax.sources.stored import stored

MIN_PAIRS = 20
AGE_CENTRE = 27.0
TERMS = 4
#: Picks that are made at once.
BLOCK = 1 << 16
X = [f"x{i}" for i in range(TERMS)]
UPPER = [(i, j) for i in range(TERMS) for j in range(i, TERMS)]
SUMS = ["n", *(f"s{i}{j}" for i, j in UPPER), *(f"t{i}" for i in range(TERMS)), "yy"]
SOLVED = [*(f"b{i}" for i in range(TERMS)), "sd", "r2"]


def design(pairs: DataFrame, stats: list[str], key: str = "player_register_id", leagues: tuple[str, str] = LEAGUES, order: str | None = None) -> DataFrame:
    """A row for each pair and statistic with both rates positive: (stat, key, o, x0..x3, y, w).

    x: 1, log of the first league's rate, (age - 27) / 10, whether forward; y: log of the second's; w: root of the
    lesser playing time. Absent or null ages are 27, absent or null playing times weigh 1. ``order``: a column of ordinals by
    which players are numbered for the bootstrap, by default they go by their keys; without keys it names the rows.
    """
    a, b = leagues
    have = pairs.columns
    age = F.coalesce(F.col(f"{a}_age").cast("double"), F.lit(AGE_CENTRE)) if f"{a}_age" in have else F.lit(AGE_CENTRE)
    times = [F.col(c).cast("double") for lg in (a, b) for c in (f"{lg}_PA", f"{lg}_batters_faced") if c in have]
    least = F.coalesce(F.least(*times) if len(times) > 1 else times[0], F.lit(1.0)) if times else F.lit(1.0)
    stats = [s for s in stats if f"{a}_rel_{s}" in have and f"{b}_rel_{s}" in have]
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(f"{a}_rel_{s}").cast("double").alias("u"), F.col(f"{b}_rel_{s}").cast("double").alias("v")) for s in stats])) if stats else F.explode(F.array().cast("array<struct<stat:string,u:double,v:double>>"))
    if key not in have and order is None:
        raise ValueError(f"pairs have neither {key} nor an order")
    who = F.col(key) if key in have else F.col(order).cast("string")
    rows = pairs.select(
        who.alias("key"), (F.col(order) if order else F.lit(-1).cast("long")).alias("o"), age.alias("age"), F.sqrt(F.greatest(F.lit(1.0), least)).alias("w"),
        F.when(F.col("direction") == f"{a}_to_{b}", 1.0).otherwise(0.0).alias("x3"), each.alias("s"),
    )
    rows = rows.filter((F.col("s.u") > 0) & (F.col("s.v") > 0) & ~F.isnan("s.u") & ~F.isnan("s.v"))
    return rows.select(F.col("s.stat").alias("stat"), "key", "o", F.lit(1.0).alias("x0"), F.log("s.u").alias("x1"), ((F.col("age") - AGE_CENTRE) / 10).alias("x2"), "x3", F.log("s.v").alias("y"), "w")


def moments(times: Column | None = None) -> list[Column]:
    """Sums that a weighted fit needs; ``times``: how often each row counts."""
    k = F.lit(1.0) if times is None else times
    w = F.col("w") * k
    return [
        F.sum(k).alias("n"),
        *[F.sum(w * F.col(X[i]) * F.col(X[j])).alias(f"s{i}{j}") for i, j in UPPER],
        *[F.sum(w * F.col(X[i]) * F.col("y")).alias(f"t{i}") for i in range(TERMS)],
        F.sum(w * F.col("y") * F.col("y")).alias("yy"),
    ]


def solve(sums: DataFrame) -> DataFrame:
    """Rows of sums to minimum-norm coefficients b0.., residual deviation sd and r2 (null without spread); other columns stay."""
    rest = [f for f in sums.schema if f.name not in SUMS or f.name == "n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = np.zeros((len(pdf), TERMS, TERMS))
            for i, j in UPPER:
                s[:, i, j] = s[:, j, i] = pdf[f"s{i}{j}"]
            t, yy = pdf[[f"t{i}" for i in range(TERMS)]].to_numpy(), pdf["yy"].to_numpy()
            beta = np.einsum("kij,kj->ki", np.linalg.pinv(s, rcond=1e-12, hermitian=True), t) if len(pdf) else t
            residual = np.maximum(0.0, yy - 2 * (beta * t).sum(1) + np.einsum("ki,kij,kj->k", beta, s, beta))
            total = yy - t[:, 0] ** 2 / s[:, 0, 0]
            spread = total > 1e-15
            out = pdf[[f.name for f in rest]].copy()
            out[SOLVED[:TERMS]] = beta
            out["sd"] = np.sqrt(residual / np.maximum(pdf["n"].to_numpy() - TERMS, 1))
            out["r2"] = np.where(spread, 1 - residual / np.where(spread, total, 1.0), np.nan)
            yield out

    return sums.mapInPandas(run, T.StructType([*rest, *[T.StructField(c, T.DoubleType()) for c in SOLVED]]))


def fit_sums(rows: DataFrame) -> DataFrame:
    """A row for each statistic of a design with enough pairs: what ``solve`` needs, in one aggregation."""
    return rows.groupBy("stat").agg(*moments(), F.countDistinct("key").alias("players")).filter(F.col("n") >= MIN_PAIRS)


def fit(rows: DataFrame) -> DataFrame:
    """Fits by statistic of a design; statistics with under 20 pairs are left out."""
    named = {"retention_slope": "b1", "intercept": "b0", "level_ratio": F.exp("b0"), "age_coef": "b2", "direction_coef": "b3", "n_pairs": F.col("n").cast("long"), "n_players": "players", "residual_sd": "sd", "r_squared": "r2"}
    return solve(fit_sums(rows)).select("stat", *[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in named.items()])


def fit_pairs(pairs: DataFrame, side: str, stats: list[str] | None = None, **options) -> DataFrame:
    return fit(design(pairs, stats or list(RATE_SETS[side]), **options))


def summary(fits: DataFrame) -> DataFrame:
    """The fits at three decimals."""
    return fits.select(*[F.bround(c, 3).alias(c) if kind == "double" else F.col(c) for c, kind in fits.dtypes])


def predicted(rate: Column, age: Column, forward: Column | float = 1.0) -> Column:
    """The second league's rate by a row's fit, for a rate and an age of the first."""
    f = F.lit(forward) if isinstance(forward, float) else forward
    return F.exp(F.col("intercept") + F.col("retention_slope") * F.log(rate) + F.col("age_coef") * (age - AGE_CENTRE) / 10 + F.col("direction_coef") * f)


# Bootstrap


def codes(rows: DataFrame) -> DataFrame:
    """(stat, key, code): players of each statistic numbered from 0 by their least order, then key.

    Players are dealt to ranges of about one size by what they are sorted by, numbered there, and the sizes of the ranges
    before are added; the dealt players are stored, so that ranges are the same for both.
    """
    first = rows.groupBy("stat", "key").agg(F.min("o").alias("o"))
    placed = stored(first.repartitionByRange("stat", "o", "key").withColumn("range", F.spark_partition_id()), "players")
    sizes = placed.groupBy("stat", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("stat").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("stat", "range", F.coalesce(before, F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("stat", "range").orderBy("o", "key")) - 1
    return placed.withColumn("own", own).join(F.broadcast(starts), ["stat", "range"]).select("stat", "key", (F.col("start") + F.col("own")).alias("code"))  # starts: a row for each range


def name_key(*parts: object, digits: int = 8) -> int:
    """A whole number from the first hexadecimal digits of the MD5 of a name."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:digits], 16)


def mixed(x: np.ndarray) -> np.ndarray:
    """32-bit numbers, mixed one to one (shifts and odd multipliers), held in 64 bits."""
    low = np.uint64(0xFFFFFFFF)
    for multiplier, shift in ((0x85EBCA6B, 16), (0xC2B2AE35, 13)):
        x = ((x ^ (x >> np.uint64(shift))) * np.uint64(multiplier)) & low
    return x ^ (x >> np.uint64(16))


def blocks_of(name: tuple, n: int, block: int) -> Iterator[tuple[int, int, int]]:
    """(first player, players, picks) of each block of a draw of n from n players: picks are split binomially, by halves."""
    todo = [(0, n, n)]
    while todo:
        low, high, picks = todo.pop()
        if high - low <= block:
            if picks:
                yield low, high - low, picks
            continue
        mid = low + -(-(high - low) // block) // 2 * block
        left = int(np.random.Generator(np.random.Philox(key=name_key(*name, low, high, digits=32))).binomial(picks, (mid - low) / (high - low)))
        todo += [(low, mid, left), (mid, high, picks - left)]


def picked(name: tuple, low: int, size: int, picks: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Players of a block and how often each was picked; the j-th pick is ``mixed(key ^ mixed(j))`` of 2^32, scaled to the block, j from ``first`` on."""
    u = mixed(np.uint64(name_key(*name, low)) ^ mixed(np.arange(first, first + picks, dtype=np.uint64)))
    at, k = np.unique(((u * np.uint64(size)) >> np.uint64(32)).astype(np.int64), return_counts=True)
    return low + at, k


def dealt(few: DataFrame, *by: str) -> DataFrame:
    """Few rows that each stand for much work, dealt to as many tasks as a shuffle has: adaptive plans merge no partitions of a given number."""
    return few.repartition(int(few.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def multiplicities(players: DataFrame, draws: int, seed: int, block: int = BLOCK) -> DataFrame:
    """(stat, draw, code, k): how often each draw of each statistic of ``players`` (stat, players) picks each player.

    The same however dealt: a draw's picks are numbered, and any ``block`` of them can be made alone.
    """
    roots = players.select("stat", F.col("players").cast("long").alias("players"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")) if draws else players.select("stat", F.col("players").cast("long").alias("players"), F.lit(0).alias("draw")).limit(0)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for stat, n, draw, first in zip(*(pdf[c] for c in ("stat", "players", "draw", "first")), strict=True):
                code, k = picked((seed, stat, draw), 0, int(n), int(min(block, n - first)), int(first))
                yield pd.DataFrame({"stat": stat, "draw": draw, "code": code, "k": k.astype(float)})

    blocks = roots.filter("players > 0").withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("players") - 1, F.lit(block).cast("long"))))
    made = dealt(blocks, "stat", "draw", "first").mapInPandas(pick, "stat string, draw int, code long, k double")
    return made.repartition("stat", "code").groupBy("stat", "draw", "code").agg(F.sum("k").alias("k"))  # joined by the same columns


def bootstrap(rows: DataFrame, draws: int = 500, seed: int = 0, drawn: DataFrame | None = None) -> DataFrame:
    """(stat, draw, at, b0..b3, sd): refits on players drawn with replacement; ``at`` numbers a statistic's draws.

    Statistics with under 20 pairs are left out, and draws of 4 rows or less. ``drawn``: other multiplicities
    (stat, draw, code, k) than those of ``multiplicities``. ``rows`` is read several times and should be cheap or stored.
    """
    enough = rows.groupBy("stat").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("players")).filter(F.col("n") >= MIN_PAIRS)
    enough = stored(enough, "statistics")  # a row for each statistic
    rows = rows.join(F.broadcast(enough.select("stat")), "stat", "left_semi")
    if drawn is None:
        drawn = multiplicities(enough, draws, seed)
    # What stands for picks looks small to the planner until it is made, and must not be broadcast: n rows a draw.
    coded = rows.join(codes(rows).hint("merge"), ["stat", "key"])
    found = coded.join(drawn.hint("merge"), ["stat", "code"]).groupBy("stat", "draw").agg(*moments(F.col("k"))).filter(F.col("n") > TERMS)
    at = F.row_number().over(Window.partitionBy("stat").orderBy("draw")) - 1  # of the draws
    return solve(found).select("stat", "draw", at.alias("at"), *SOLVED[:TERMS], "sd")


def uniform(*parts: Column) -> Column:
    """A number between 0 and 1 from the first eight hexadecimal digits of the MD5 of a name."""
    digits = F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 32)


def with_noise(drawn: DataFrame, seed: int = 0) -> DataFrame:
    """Draws with predictive noise of their deviation, the same for every case and statistic (common random numbers).

    Normal numbers from two uniform ones, which the seed and the number of the draw name.
    """
    size, angle = uniform(F.lit(seed), F.col("at"), F.lit("size")), uniform(F.lit(seed), F.col("at"), F.lit("angle"))
    return drawn.withColumn("noise", F.col("sd") * F.sqrt(-2.0 * F.log(size)) * F.cos(2 * math.pi * angle))


LEVELS = (0.10, 0.25, 0.50, 0.75, 0.90)


def with_intervals(cases: DataFrame, drawn: DataFrame, rate: str = "rate", age: str = "age") -> DataFrame:
    """``cases`` (stat, rate, age, others) with point, p10, p25, p50, p75, p90 and n_draws, forward; null where a statistic has no draws.

    Covers the uncertainty of the fit and the residual spread; point is exp of the mean draw. A statistic's draws are an
    array beside each of its cases, so that cases are neither moved nor multiplied.
    """
    one = [F.col(f"b{i}") for i in range(TERMS)] + [F.col("noise")]
    beside = drawn.groupBy("stat").agg(F.sort_array(F.collect_list(F.struct(*one))).alias("_d"))

    def centre(d: Column) -> Column:
        return d["b0"] + d["b1"] * F.log(rate) + d["b2"] * (F.col(age) - AGE_CENTRE) / 10 + d["b3"]

    def known(of) -> Column:
        return F.filter(F.transform("_d", of), lambda x: x.isNotNull())

    def level(q: float) -> Column:  # as ``percentile`` does
        at = F.lit(q) * (F.size("_s") - 1)
        low, high = F.get("_s", F.floor(at).cast("int")), F.get("_s", F.ceil(at).cast("int"))
        return F.when((F.floor(at) == F.ceil(at)) | (low == high), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    sampled = cases.join(F.broadcast(beside), "stat", "left").withColumns({"_c": known(centre), "_s": F.array_sort(known(lambda d: F.exp(centre(d) + d["noise"])))})  # beside: a row for each statistic
    point = F.exp(F.aggregate("_c", F.lit(0.0), lambda t, x: t + x) / F.nullif(F.size("_c"), F.lit(0)))
    return sampled.withColumns({"point": point, **{f"p{round(q * 100)}": level(q) for q in LEVELS}, "n_draws": F.when(F.col("_d").isNotNull(), F.size("_d")).cast("long")}).drop("_d", "_c", "_s")


def intervals(cases: DataFrame, drawn: DataFrame, case: str, rate: str = "rate", age: str = "age") -> DataFrame:
    """(case, stat, point, p10, p25, p50, p75, p90, n_draws) of ``cases`` (case, stat, rate, age), each once, with draws."""
    said = with_intervals(cases.filter(F.col(rate) > 0), drawn, rate, age).filter("n_draws IS NOT NULL")
    return said.select(case, "stat", "point", *[f"p{round(q * 100)}" for q in LEVELS], "n_draws")


def inversion(rows: DataFrame) -> DataFrame:
    """Why a fitted slope must not be inverted: both slopes, r² and their product, by statistic (unweighted)."""
    out = rows.groupBy("stat").agg(F.count(F.lit(1)).alias("n"), F.regr_r2("y", "x1").alias("r_squared"), F.regr_slope("y", "x1").alias("slope_mlb_on_kbo"), F.regr_slope("x1", "y").alias("slope_kbo_on_mlb"))
    back = F.col("slope_kbo_on_mlb")
    naive = F.when(F.abs(back) > 1e-9, 1 / F.when(F.abs(back) > 1e-9, back)).otherwise(F.lit(float("inf")))
    return out.filter(F.col("n") >= MIN_PAIRS).select("stat", "n", "r_squared", "slope_mlb_on_kbo", "slope_kbo_on_mlb", naive.alias("naive_inverted_slope"), (F.col("slope_mlb_on_kbo") * back).alias("slope_product_equals_r2"))


def weighted_line(rows: DataFrame, x: Column, y: Column, w: Column, by: list[str]) -> DataFrame:
    """Weighted least squares of y on x in closed form: (by, n, slope, intercept, residual_sd, r_squared)."""
    s = rows.select(*by, x.alias("x"), y.alias("y"), w.alias("w")).dropna()
    sums = s.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("wx"), F.sum(F.col("w") * F.col("y")).alias("wy"),
        F.sum(F.expr("w * x * x")).alias("wxx"), F.sum(F.expr("w * x * y")).alias("wxy"), F.sum(F.expr("w * y * y")).alias("wyy"),
    )
    sxx, sxy, syy = (F.col(a) - F.col(b) * F.col(c) / F.col("w") for a, b, c in (("wxx", "wx", "wx"), ("wxy", "wx", "wy"), ("wyy", "wy", "wy")))
    slope = F.when(sxx > 1e-12, sxy / F.when(sxx > 1e-12, sxx))
    out = sums.withColumns({"slope": slope, "_sxy": sxy, "_syy": syy})
    rest = F.greatest(F.col("_syy") - F.col("slope") * F.col("_sxy"), F.lit(0.0))
    return out.select(
        *by, "n", "slope", ((F.col("wy") - F.col("slope") * F.col("wx")) / F.col("w")).alias("intercept"),
        F.sqrt(rest / F.greatest(F.col("n") - 2, F.lit(1))).alias("residual_sd"), F.when(F.col("_syy") > 0, 1 - rest / F.when(F.col("_syy") > 0, F.col("_syy"))).alias("r_squared"),
    )
