"""Data-quality checks: each gives a row of one common schema, (name, passed, severity, n_bad, message).

No check raises: what cannot be checked, for want of a column, is a failed row that says so. A check of rows is a set of
counters and how to judge them; ``audit`` counts all checks of one table in one pass over it. Where one of
them asks for unique keys, the pass groups by these keys, which that check needs anyway, and sums up the other counters
of the groups.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.operators.rates import league_rates

ERROR, WARNING, INFO = "error", "warning", "info"
RESULT = "name string, passed boolean, severity string, n_bad long, message string"

# Bounds that cannot be crossed, counts that cannot be negative, columns each side needs.
RANGES = {"batting_avg": (0, 1), "onbase_perc": (0, 1), "slugging_perc": (0, 4), "fielding_perc": (0, 1), "age": (15, 55), "earned_run_avg": (0, 200), "G": (0, 200)}
COUNTS = ("G", "PA", "AB", "R", "H", "2B", "3B", "HR", "RBI", "BB", "SO", "TB", "ER", "W", "L")
REQUIRED = {"batting": ("player", "season", "player_register_id", "PA"), "pitching": ("player", "season", "player_register_id", "IP")}


def result(spark: SparkSession, name: str, passed: bool, severity: str, message: str, n_bad: int = 0) -> DataFrame:
    return spark.createDataFrame([(name, passed, severity, n_bad, message)], RESULT)


@dataclass
class Counters:
    """What a check counts in a table: rows that fulfil conditions and, with ``keys``, rows that share these with another row.

    ``judge`` makes an array of results of the counts, of which that of shared keys is the last.
    """

    table: DataFrame
    conditions: list[Column]
    judge: Callable[[list[Column]], Column]
    keys: tuple[str, ...] = ()

    def frame(self) -> DataFrame:
        """The results of this check alone; ``audit`` finds the counters again."""
        out = one_pass([self])
        out._counters = self
        return out


def one_pass(checks: list[Counters]) -> DataFrame:
    """Results of checks of one table, of which the keyed ones have the same keys."""
    keys = next((c.keys for c in checks if c.keys), ())
    conditions = [x for c in checks for x in c.conditions]
    counts = [F.count_if(F.coalesce(x, F.lit(False))).alias(f"_{i}") for i, x in enumerate(conditions)]
    if keys:
        groups = checks[0].table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *counts)
        counts = [F.coalesce(F.sum(f"_{i}"), F.lit(0)).cast("long").alias(f"_{i}") for i in range(len(conditions))]
        sums = groups.agg(*counts, F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("_shared"))
    else:
        sums = checks[0].table.agg(*counts)
    at, judged = 0, []
    for c in checks:
        own = [F.col(f"_{i}") for i in range(at, at + len(c.conditions))]
        judged.append(c.judge([*own, *([F.col("_shared")] if c.keys else [])]))
        at += len(c.conditions)
    return sums.select(F.explode(F.concat(*judged)).alias("c")).select("c.*")


def outcome(name: str, passed: Column, severity: str, n_bad: Column, message: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), passed.alias("passed"), F.lit(severity).alias("severity"), n_bad.cast("long").alias("n_bad"), message.alias("message"))


def counted_as(name: str, n: Column, good: str, what: str, severity: str = ERROR) -> Column:
    """The result of a count that should be nothing."""
    return outcome(name, n == 0, severity, n, F.when(n == 0, good).otherwise(F.concat_ws(" ", n.cast("string"), F.lit(what))))


def counted(df: DataFrame, name: str, bad: Column, good: str, what: str, severity: str = ERROR) -> DataFrame:
    """A check that no row is bad; nulls are not."""
    return several(df, [(name, bad, good, what)], severity)


def several(df: DataFrame, checks: list[tuple[str, Column, str, str]], severity: str = ERROR) -> DataFrame:
    """Checks of single rows, all in one pass over ``df``."""
    return Counters(df, [bad for _, bad, _, _ in checks], lambda n: F.array(*[counted_as(name, k, good, what, severity) for k, (name, _, good, what) in zip(n, checks, strict=True)])).frame()


def judged(counts: DataFrame, severity: str = ERROR) -> DataFrame:
    """Results of (name, n_bad, good, what)."""
    fine = F.col("n_bad") == 0
    return counts.select("name", fine.alias("passed"), F.lit(severity).alias("severity"), F.col("n_bad").cast("long").alias("n_bad"), F.when(fine, F.col("good")).otherwise(F.concat_ws(" ", F.col("n_bad").cast("string"), "what")).alias("message"))


def required_columns(df: DataFrame, columns: tuple[str, ...], label: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    return result(df.sparkSession, f"{label}.required_columns", not missing, ERROR, f"missing columns: {missing}" if missing else "all required columns present", len(missing))


def uniqueness(df: DataFrame, keys: list[str], name: str, what: str = "duplicated rows") -> DataFrame:
    """Rows that share their keys with another row; counts groups, so nothing is windowed."""
    if not set(keys) <= set(df.columns):
        return result(df.sparkSession, name, False, ERROR, "key columns unavailable")
    return Counters(df, [], lambda n: F.array(counted_as(name, n[0], "no duplicates", what)), tuple(keys)).frame()


def missing_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    if column not in df.columns:
        return result(df.sparkSession, name, False, ERROR, f"{column} column absent")
    c = F.col(column)
    return counted(df, name, c.isNull() | (F.btrim(c.cast("string")) == ""), "every row has an id", "rows without an id")


def outside(c: Column, low: float, high: float) -> Column:
    return c.isNotNull() & ~F.isnan(c.cast("double")) & ~c.cast("double").between(low, high)


def value_ranges(df: DataFrame, label: str, ranges: dict[str, tuple[float, float]] = RANGES) -> DataFrame | None:
    have = {c: b for c, b in ranges.items() if c in df.columns}
    checks = [(f"{label}.range.{c}", outside(F.col(c).try_cast("double"), lo, hi), f"{c} within [{lo}, {hi}]", f"rows where {c} is outside [{lo}, {hi}]") for c, (lo, hi) in have.items()]
    return several(df, checks) if checks else None


def negative_counts(df: DataFrame, label: str, columns: tuple[str, ...] = COUNTS) -> DataFrame:
    bad = reduce(lambda a, c: a | F.coalesce(F.col(f"`{c}`").try_cast("double") < 0, F.lit(False)), [c for c in columns if c in df.columns], F.lit(False))
    return counted(df, f"{label}.negative_counts", bad, "no negative counts", "rows with a negative count")


def batting_identities(df: DataFrame, tolerance: float = 1, columns: dict[str, Column] | None = None) -> DataFrame | None:
    """PA >= AB, H >= 2B + 3B + HR, TB = H + 2B + 2 3B + 3 HR; rows with nulls pass. ``columns``: what the counts are, else their columns."""
    known = {c: F.col(f"`{c}`") for c in df.columns} if columns is None else columns
    n = {c: known[c].try_cast("double") for c in ("PA", "AB", "H", "2B", "3B", "HR", "TB") if c in known}
    checks = []
    if {"PA", "AB"} <= n.keys():
        checks.append(("batting.pa_ge_ab", n["AB"] > n["PA"], "PA >= AB holds", "rows where AB exceeds PA"))
    if {"H", "2B", "3B", "HR"} <= n.keys():
        checks.append(("batting.hits_ge_extra_base", n["2B"] + n["3B"] + n["HR"] > n["H"], "H >= 2B+3B+HR holds", "rows where extra-base hits exceed hits"))
        if "TB" in n:
            gap = F.abs(n["TB"] - (n["H"] + n["2B"] + 2 * n["3B"] + 3 * n["HR"]))
            checks.append(("batting.total_bases_identity", gap > tolerance, "TB matches H+2B+2*3B+3*HR", "rows where total bases do not reconcile"))
    return several(df, checks) if checks else None


def reconciled(ours: DataFrame, published: DataFrame, column: str, by: str = "season", theirs: str | None = None) -> DataFrame:
    """(by, scraped, published, pct_diff, coverage) of sums that both tables have."""
    a = ours.groupBy(by).agg(F.sum(F.col(column).try_cast("double")).alias("scraped"))
    b = published.groupBy(by).agg(F.sum(F.col(theirs or column).try_cast("double")).alias("published"))
    both = a.join(b, by).dropna(subset=["scraped", "published"])
    den = F.nullif(F.col("published"), F.lit(0.0))
    return both.withColumns({"pct_diff": F.try_divide(F.col("scraped") - F.col("published"), den), "coverage": F.try_divide(F.col("scraped"), den)})


def league_totals(players: DataFrame, totals: DataFrame, column: str = "HR", tolerance: float = 0.02) -> DataFrame:
    """More than published is our error; less is a limit of the source, a warning."""
    name = "cross_source.league_totals"
    if column not in players.columns or "season" not in players.columns:
        return result(players.sparkSession, name, False, ERROR, f"cannot reconcile: {column} or season missing")
    if column not in totals.columns:
        return result(players.sparkSession, name, False, WARNING, "no league totals available to reconcile against")
    n = reconciled(players, totals, column).agg(F.count_if(F.col("pct_diff") > tolerance).alias("over"), F.count_if(F.col("pct_diff") < -tolerance).alias("under"), F.count(F.lit(1)).alias("all"), F.min("coverage").alias("worst"))
    over, under, none = F.col("over") > 0, F.col("under") > 0, F.col("all") == 0
    return n.select(
        F.lit(name).alias("name"), (~over & ~under & ~none).alias("passed"), F.when(over, ERROR).when(under | none, WARNING).otherwise(ERROR).alias("severity"), F.when(over, F.col("over")).otherwise(F.col("under")).alias("n_bad"),
        F.when(none, "no overlapping seasons to reconcile").when(over, F.format_string(f"%d seasons where scraped {column} exceeds the published total", "over"))
        .when(under, F.format_string(f"%d of %d seasons are short of the published {column} total (worst season captures %.1f%%)", "under", "all", F.col("worst") * 100))
        .otherwise(f"season {column} totals reconcile").alias("message"),
    )


def league_sides(totals: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """The strikeout rate of a season must be the same from either side."""
    name = "cross_source.league_sides"
    if "side" not in totals.columns:
        return result(totals.sparkSession, name, False, WARNING, "league totals unavailable for the two-sided check")
    sides = [league_rates(totals, s).select("season", F.col("lg_k_pct").alias(s)) for s in ("batting", "pitching")]
    gap = sides[0].join(sides[1], "season").dropna().agg(F.count_if(F.abs(F.col("batting") - F.col("pitching")) > tolerance).alias("n_bad"), F.count(F.lit(1)).alias("all"))
    out = judged(gap.select(F.lit(name).alias("name"), "n_bad", F.lit("league K% agrees between the sides").alias("good"), F.lit("seasons where league K% differs between the sides").alias("what"), "all"))
    return out.withColumn("severity", F.lit(ERROR))


def missing_seasons(df: DataFrame, start: int, end: int, season: str = "season") -> DataFrame:
    """Seasons of the range without a row."""
    expected = df.sparkSession.range(start, end + 1).select(F.col("id").cast("int").alias(season))
    return expected.join(df.select(F.col(season).try_cast("int").alias(season)).distinct(), season, "left_anti")


def season_coverage(df: DataFrame, start: int, end: int) -> DataFrame:
    if "season" not in df.columns:
        return result(df.sparkSession, "coverage.seasons", False, ERROR, "season column absent")
    n = missing_seasons(df, start, end).agg(F.count(F.lit(1)).alias("n_bad"))
    return judged(n.select(F.lit("coverage.seasons").alias("name"), "n_bad", F.lit(f"all {end - start + 1} seasons present").alias("good"), F.lit("seasons returned no rows").alias("what")), WARNING)


def crosswalk_size(stats: DataFrame, least: int = 50, most: float = 0.75) -> DataFrame:
    """Too few links say that a join is broken, too many that it matches what it should not."""
    rate = F.col("matched") / F.greatest(F.col("kbo_players"), F.lit(1))
    few, many = F.col("matched") < least, rate > most
    message = F.when(few, F.format_string("only %d players linked", "matched")).when(many, F.format_string("%.1f%% of players linked, implausibly many", rate * 100)).otherwise(F.format_string("%d players linked (%.1f%%)", F.col("matched"), rate * 100))
    return stats.select(F.lit("crosswalk.size").alias("name"), (~few & ~many).alias("passed"), F.when(few | many, ERROR).otherwise(INFO).alias("severity"), F.lit(0).cast("long").alias("n_bad"), message.alias("message"))


def crosswalk_uniqueness(matches: DataFrame, key: str = "player_register_id") -> DataFrame:
    if key not in matches.columns:
        return result(matches.sparkSession, "crosswalk.uniqueness", False, WARNING, "no crosswalk available to check")
    n = matches.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_bad"))
    return judged(n.select(F.lit("crosswalk.uniqueness").alias("name"), "n_bad", F.lit("each player links to at most one record").alias("good"), F.lit("players link to several records").alias("what")))


def null_share(df: DataFrame, column: str, name: str, most: float = 0.10) -> DataFrame:
    """A warning where at least ``most`` of the rows lack a value."""
    def judge(n: list[Column]) -> Column:
        bad, all = n
        return F.array(outcome(name, (all == 0) | (bad < most * all), WARNING, bad, F.format_string(f"%d of %d rows lack {column}", bad, all)))

    return Counters(df, [F.col(column).isNull(), F.lit(True)], judge).frame()


def non_empty(df: DataFrame, label: str) -> DataFrame:
    def judge(n: list[Column]) -> Column:
        some = n[0] > 0
        return F.array(outcome(f"{label}.non_empty", some, ERROR, F.when(some, 0).otherwise(1), F.when(some, "rows present").otherwise("no rows")))

    return Counters(df, [F.lit(True)], judge).frame()


def audit(checks: list[DataFrame | None]) -> DataFrame:
    """All results; checks that count in the same table do so in one pass, in their order within it."""
    tables: list[list[Counters]] = []
    others = []
    for c in checks:
        if c is None:
            continue
        own = getattr(c, "_counters", None)
        if own is None:
            others.append(c)
            continue
        for group in tables:
            keys = next((x.keys for x in group if x.keys), ())
            if group[0].table.sameSemantics(own.table) and not (keys and own.keys and keys != own.keys):
                group.append(Counters(group[0].table, own.conditions, own.judge, own.keys))
                break
        else:
            tables.append([own])
    return reduce(DataFrame.unionByName, [*map(one_pass, tables), *others])


def has_errors(results: DataFrame) -> bool:
    return not results.filter((F.col("severity") == ERROR) & ~F.col("passed")).isEmpty()


def run_all(batting: DataFrame, pitching: DataFrame, roster: DataFrame, totals: DataFrame, start: int, end: int, crosswalk=None) -> DataFrame:
    """The whole audit of a scrape."""
    checks: list[DataFrame | None] = []
    for label, df in (("batting", batting), ("pitching", pitching)):
        checks += [non_empty(df, label), required_columns(df, REQUIRED[label], label), uniqueness(df, ["player_register_id", "season", "team_bref_id"], f"{label}.duplicate_player_seasons", "duplicated player-team-season rows")]
        checks += [missing_ids(df, "player_register_id", f"{label}.missing_ids"), value_ranges(df, label), negative_counts(df, label)]
    checks += [batting_identities(batting), league_totals(batting, totals.filter("side = 'batting'") if "side" in totals.columns else totals), league_sides(totals), season_coverage(batting, start, end)]
    if "date_of_birth" in roster.columns:
        checks.append(null_share(roster, "date_of_birth", "roster.dob_coverage"))
    if crosswalk is not None:
        checks += [crosswalk_size(crosswalk.stats), crosswalk_uniqueness(crosswalk.matches)]
    return audit(checks)
