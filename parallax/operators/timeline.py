"""Sequences: crossings between leagues, spans and cohorts, latest and recent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType

LEAGUES = ("kbo", "mlb")
POSTED, IMPORT, UNKNOWN = "posted_from_kbo", "import_returnee", "unknown"
SIDE_COLUMNS = ("age", "PA", "batters_faced")


def switches(timeline: DataFrame, key: str, time: str, label: str, ordinal: Column, gap: Column | None, most: int) -> DataFrame:
    """Adjacent rows of a key with different labels and a gap of 0 to ``most``: structs ``before`` and ``after``.

    Of rows with one key, time and label the last by ``ordinal`` counts; rows go by time, then label. ``gap``: an
    expression on ``before`` and ``after``; by default the difference of times.
    """
    last = Window.partitionBy(key, time, label).orderBy(ordinal.desc())
    once = timeline.dropna(subset=[key, time, label]).withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")
    now = F.struct(*[F.col(c) for c in once.columns])
    following = F.lead(now).over(Window.partitionBy(key).orderBy(time, label))
    pairs = once.select(F.col(key), now.alias("before"), following.alias("after")).filter(F.col("after").isNotNull())
    pairs = pairs.withColumn("gap", gap if gap is not None else F.col(f"after.{time}") - F.col(f"before.{time}"))
    return pairs.filter((F.col(f"before.{label}") != F.col(f"after.{label}")) & F.col("gap").between(0, most))


def build_pairs(home: DataFrame, away: DataFrame, key: str = "player_register_id", max_gap: int = 2, leagues: tuple[str, str] = LEAGUES, order: str = "ordinal") -> DataFrame:
    """One row for each crossing between two season tables, with either side's relative rates.

    Only rel_* columns of both tables come along; names are the first league's, else the other's. Of several rows of a
    season the last by ``order`` counts (``tables.ordinal``), or by a hash of the row in a table without that column.
    """
    a, b = leagues
    rel = [c for c in home.columns if c.startswith("rel_") and c in away.columns]
    extra = [c for c in ("player", "name", *SIDE_COLUMNS) if c in home.columns or c in away.columns]

    kinds = {df.schema[order].dataType.simpleString() for df in (home, away) if order in df.columns}
    kind = kinds.pop() if len(kinds) == 1 else None  # places of both tables are of one type

    def placed(df: DataFrame) -> Column:
        by_hash = F.xxhash64(*[c for c in df.columns if c != order])
        return F.struct((F.col(order) if kind and order in df.columns else F.lit(None).cast(kind or "long")).alias("place"), by_hash.alias("hash"))

    def slim(df: DataFrame, league: str) -> DataFrame:
        cols = [(F.col(c) if c in df.columns else F.lit(None).cast("string" if c in ("player", "name") else "double")).alias(c) for c in [*rel, *extra]]
        return df.select(key, F.col("season").cast("int").alias("season"), F.lit(league).alias("league"), *cols, placed(df).alias("_o"))

    timeline = slim(home, a).unionByName(slim(away, b))
    found = switches(timeline, key, "season", "league", F.col("_o"), None, max_gap)
    forward = F.col("before.league") == a

    def side(league: str, c: str) -> Column:
        first, second = (F.col(f"before.{c}"), F.col(f"after.{c}")) if league == a else (F.col(f"after.{c}"), F.col(f"before.{c}"))
        return F.when(forward, first).otherwise(second)

    said = [side(lg, c) for lg in (a, b) for c in ("player", "name") if c in extra]
    sides = [c for c in SIDE_COLUMNS if c in extra]
    return found.select(
        key,
        F.when(forward, f"{a}_to_{b}").otherwise(f"{b}_to_{a}").alias("direction"),
        F.col("gap").alias("gap_years"),
        side(a, "season").alias(f"{a}_season"),
        side(b, "season").alias(f"{b}_season"),
        (F.coalesce(*said) if said else F.lit(None).cast("string")).alias("player"),
        *[side(lg, c).alias(f"{lg}_{c}") for c in rel for lg in (a, b)],
        *[side(lg, c).alias(f"{lg}_{c}") for c in sides for lg in (a, b)],
    )


#: Numbers that one word of bits stands for.
WORD = 64


def number_words(df: DataFrame, key: str, number: str) -> DataFrame:
    """(key, word, bits, low, high): the distinct whole numbers or days of each key as words of bits, which merge before the shuffle.

    A key's null numbers are a word without bits.
    """
    c = F.unix_date(number) if isinstance(df.schema[number].dataType, DateType) else F.col(number)
    bit = F.expr("shiftleft(1L, cast(pmod(_c, 64) AS int))")
    words = df.select(F.col(key), F.col(number), c.cast("long").alias("_c")).withColumn("word", F.floor(F.col("_c") / WORD))
    return words.groupBy(key, "word").agg(F.bit_or(bit).alias("bits"), F.min(number).alias("low"), F.max(number).alias("high"))


def whole(df: DataFrame, number: str) -> bool:
    return isinstance(df.schema[number].dataType, (IntegralType, DateType))


def spans(df: DataFrame, key: str, time: str, name: str) -> DataFrame:
    """(key, first_name, last_name, n_name): first, last and number of distinct times."""
    df = df.dropna(subset=[key, time])
    if not whole(df, time):
        return df.groupBy(key).agg(F.min(time).alias(f"first_{name}"), F.max(time).alias(f"last_{name}"), F.countDistinct(time).alias(f"n_{name}"))
    n = F.sum(F.bit_count("bits")).alias(f"n_{name}")
    return number_words(df, key, time).groupBy(key).agg(F.min("low").alias(f"first_{name}"), F.max("high").alias(f"last_{name}"), n)


def classify(home: DataFrame, away: DataFrame, key: str = "player_register_id", time: str = "season", leagues: tuple[str, str] = LEAGUES) -> DataFrame:
    """Cohorts by where someone appears first; those with only one league are unknown."""
    a, b = leagues
    both = spans(home, key, time, a).join(spans(away, key, time, b), key, "full")
    first_a, first_b = F.col(f"first_{a}"), F.col(f"first_{b}")
    return both.withColumn("cohort", F.when(first_a < first_b, POSTED).when(first_b < first_a, IMPORT).otherwise(UNKNOWN))


def attach(pairs: DataFrame, cohorts: DataFrame, key: str = "player_register_id") -> DataFrame:
    columns = [c for c in ("cohort", "first_kbo", "first_mlb", "n_kbo", "n_mlb") if c in cohorts.columns]
    return pairs.join(cohorts.select(key, *columns), key, "left").withColumn("cohort", F.coalesce("cohort", F.lit(UNKNOWN)))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def recent_before(rows: DataFrame, pivots: DataFrame | None, key: str, time: str, n: int, pivot: str = "pivot", ties: tuple[str, ...] = ()) -> DataFrame:
    """The last ``n`` rows (not times) of each key; with ``pivots`` (key, pivot) only rows before the pivot."""
    if pivots is not None:
        rows = rows.join(pivots.select(key, pivot), key).filter(F.col(time) < F.col(pivot))
    last = Window.partitionBy(key).orderBy(F.desc(time), *[F.desc(t) for t in ties])
    return rows.withColumn("recency", F.row_number().over(last)).filter(F.col("recency") <= n)


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row for each key: the first by ``order``."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_k = 1").drop("_k")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose keys occur more than once."""
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("_n > 1").drop("_n")


def congestion(df: DataFrame, team: str = "team_name", season: str = "earliest_posting_season") -> DataFrame:
    """How many of a team's share a season, and whether that delays some; rows without a team stand alone."""
    if team not in df.columns or season not in df.columns:
        return df.withColumns({"club_eligible_that_year": F.lit(1).cast("long"), "posting_likely_delayed": F.lit(False)})
    n = F.count(F.lit(1)).over(Window.partitionBy(team, season))
    known = F.col(team).isNotNull() & F.col(season).isNotNull()
    out = df.withColumn("club_eligible_that_year", F.when(known, n).otherwise(F.lit(1)).cast("long"))
    return out.withColumn("posting_likely_delayed", F.col("club_eligible_that_year") > 1)


def seasons_by_player(rows: DataFrame, key: str = "player_register_id", season: str = "season") -> DataFrame:
    """How many seasons each player has rows in; none where all are unknown."""
    rows = rows.dropna(subset=[key])
    if not whole(rows, season):
        return rows.groupBy(key).agg(F.countDistinct(season).alias("seasons"))
    return number_words(rows, key, season).groupBy(key).agg(F.sum(F.coalesce(F.bit_count("bits"), F.lit(0))).alias("seasons"))


def sample_sizes(seasons: DataFrame, key: str, playing: str, least: float) -> DataFrame:
    """One row: players and seasons, all and with at least so much playing time, from one row for each player."""
    enough = F.coalesce(F.col(playing) >= least, F.lit(False))
    players = seasons.dropna(subset=[key]).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(enough).alias("q"))
    sums = {"players": F.count(F.lit(1)), "qualified": F.count_if(F.col("q") > 0), "player_seasons": F.sum("n"), "qualified_seasons": F.sum("q")}
    return players.agg(*[F.coalesce(x, F.lit(0)).alias(c) for c, x in sums.items()])
