"""Player and league records from parsed pages and JSON documents, as typed tables.

Every reader takes a table of pages or documents and returns rows; what cannot be read becomes a
row of failures, never an exception.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from parallax.functions import names
from parallax.functions.expr import innings, number, outs
from parallax.sources import html

# Spellings of columns on pages of different years, by canonical name.
SPELLINGS = {
    "season": "year_id year_ID", "team": "team_name_abbr team_ID team_id", "league": "comp_name_abbr lg_ID comp_id", "age": "b_age p_age",
    "G": "b_games p_g", "PA": "b_pa", "AB": "b_ab", "R": "b_r", "H": "b_h p_h", "2B": "b_doubles", "3B": "b_triples", "HR": "b_hr p_hr", "RBI": "b_rbi", "BB": "b_bb p_bb", "SO": "b_so p_so",
    "TB": "b_tb", "HBP": "b_hbp", "SF": "b_sf", "SH": "b_sh", "batting_avg": "b_batting_avg", "onbase_perc": "b_onbase_perc", "slugging_perc": "b_slugging_perc",
    "W": "p_w", "L": "p_l", "earned_run_avg": "p_earned_run_avg", "GS": "p_gs", "IP": "p_ip", "ER": "p_er", "batters_faced": "p_bfp BF",
}
CANONICAL = {old: new for new, olds in SPELLINGS.items() for old in olds.split()}
SIGNATURES = {"batting": ("season", "PA", "AB", "HR"), "pitching": ("season", "IP", "ER")}
TOTALS_LABELS = ("league average", "mlb totals", "major league totals", "lg average", "league totals", "totals", "average", "162 game avg", "career")

# Numeric columns of season tables, and fields of the JSON statistics by our names.
NUMERIC = (
    "G PA AB R H 2B 3B HR RBI SB CS BB SO batting_avg onbase_perc slugging_perc onbase_plus_slugging TB GIDP HBP SH SF IBB age "
    "W L earned_run_avg GS GF CG SHO SV IP ER BK WP batters_faced whip win_loss_perc"
).split()
JSON_FIELDS = {
    "batting": {
        "PA": "plateAppearances", "AB": "atBats", "H": "hits", "2B": "doubles", "3B": "triples", "HR": "homeRuns", "SO": "strikeOuts", "BB": "baseOnBalls", "IBB": "intentionalWalks",
        "HBP": "hitByPitch", "SF": "sacFlies", "SH": "sacBunts", "TB": "totalBases", "RBI": "rbi", "SB": "stolenBases", "CS": "caughtStealing", "R": "runs", "G": "gamesPlayed", "GIDP": "groundIntoDoublePlay",
    },
    "pitching": {
        "batters_faced": "battersFaced", "IP": "inningsPitched", "SO": "strikeOuts", "BB": "baseOnBalls", "HR": "homeRuns", "H": "hits", "ER": "earnedRuns", "R": "runs",
        "G": "gamesPlayed", "GS": "gamesStarted", "SV": "saves", "W": "wins", "L": "losses",
    },
}
MAJOR, REGULAR = 1, "R"


# Register pages: index -> season -> team


def season_index(pages: DataFrame) -> DataFrame:
    """(page, season, season_id) of the league index."""
    rows = html.rows(pages, "lg_history").filter(html.identified())
    year = F.btrim(html.cell("year_ID"))
    return rows.select("page", year.alias("season"), html.link_id(html.SEASON_LINK).alias("season_id")).filter(F.rlike("season", F.lit(r"^\d+$")) & F.col("season_id").isNotNull())


def season_teams(pages: DataFrame) -> DataFrame:
    rows = html.rows(pages, "regular_season").filter(html.identified())
    cells = {c: F.coalesce(html.cell(c), F.lit("")) for c in ("W", "L")}
    out = rows.select("page", F.btrim(F.coalesce(html.cell("team_ID"), F.lit(""))).alias("team_name"), html.link_id(html.TEAM_LINK).alias("team_bref_id"), *[v.alias(c) for c, v in cells.items()])
    return out.filter("team_bref_id IS NOT NULL")


def league_tables(pages: DataFrame) -> DataFrame:
    """Sums of a season's league tables: (page, side, cells)."""
    rows = html.rows(pages).filter(F.col("table_id").isin("league_batting", "league_pitching") & html.identified() & html.is_aggregate())
    return rows.select("page", F.replace("table_id", F.lit("league_"), F.lit("")).alias("side"), "cells")


def team_rows(pages: DataFrame, kind: str) -> DataFrame:
    """Rows of a team page's batting, pitching or roster table with ids and is_aggregate."""
    table_id = {"batting": "team_batting", "pitching": "team_pitching", "roster": "standard_roster"}[kind]
    rows = html.rows(pages, table_id).filter(html.identified())
    return rows.withColumns({"player_register_id": html.link_id(html.PLAYER_LINK), "is_aggregate": html.is_aggregate()}).drop("table_id", "table_at")


def typed(rows: DataFrame, columns: tuple[str, ...] | list[str]) -> DataFrame:
    """Cells to columns: numbers by ``number``, dates, name keys; rows without a player id go."""
    fixed = [c for c in rows.columns if c not in ("cells", "page")]
    out = rows.select(*fixed, *[(number(html.cell(c)) if c in NUMERIC else html.cell(c)).alias(c) for c in columns if c not in fixed])
    if "date_of_birth" in out.columns:
        out = out.withColumn("date_of_birth", F.try_to_timestamp("date_of_birth").cast("date"))
    if "player" in out.columns:
        out = out.withColumn("_k", names.keys("player", "clean", "strict", "loose")).withColumns({"name_clean": F.col("_k.clean"), "name_strict_key": F.col("_k.strict"), "name_loose_key": F.col("_k.loose")}).drop("_k")
    return out.filter("player_register_id IS NOT NULL")


@dataclass
class Crawl:
    batting: DataFrame
    pitching: DataFrame
    roster: DataFrame
    league_totals: DataFrame


def crawl(index: DataFrame, seasons: DataFrame, teams: DataFrame, start: int, end: int) -> Crawl:
    """The three levels as joins over cached pages: ``index`` (page, html), ``seasons`` (season_id, html),
    ``teams`` (team_bref_id, html). Sums go to league totals, players to the other tables."""
    years = season_index(index).filter(F.col("season").try_cast("int").between(start, end)).select(F.col("season").cast("int").alias("season"), "season_id").distinct()
    season_pages = seasons.withColumnRenamed("season_id", "page").join(years, F.col("page") == F.col("season_id"), "left_semi")
    at_season = years.withColumnRenamed("season_id", "page")
    found = season_teams(season_pages).join(at_season, "page").drop("page", "W", "L")
    totals = league_tables(season_pages).join(at_season, "page").drop("page")
    columns = [c for c in NUMERIC if c != "age"]
    totals = totals.select("season", "side", *[number(html.cell(c)).alias(c) for c in columns])
    team_pages = teams.withColumnRenamed("team_bref_id", "page")

    def of(kind: str, cells: list[str]) -> DataFrame:
        rows = team_rows(team_pages, kind)
        rows = rows if kind == "roster" else rows.filter(~F.col("is_aggregate"))
        return typed(rows.join(found.withColumnRenamed("team_bref_id", "page"), "page").withColumn("team_bref_id", F.col("page")), cells)

    return Crawl(of("batting", ["player", *NUMERIC]), of("pitching", ["player", *NUMERIC]), of("roster", ["player", "date_of_birth", "birth_city", "age"]), totals)


def player_ids(batting: DataFrame, pitching: DataFrame, roster: DataFrame, order: str) -> DataFrame:
    return html.first_seen([batting, pitching, roster], "player_register_id", order)


# Player pages of the other source


def page_seasons(pages: DataFrame, side: str, key: str = "page") -> DataFrame:
    """Player seasons of player pages: the first table of the side's columns, whatever their vintage.

    A season with several rows (a trade) keeps the row with the most playing time.
    """
    rows = html.rows(pages).withColumn("cells", html.renamed_cells(CANONICAL)).filter(F.col("table_id").isNotNull())
    rows = html.with_signature(rows, SIGNATURES[side], key)
    rows = html.season_rows(rows, html.cell("season")).filter(~F.lower(F.coalesce(html.cell("team"), F.lit(""))).isin(*TOTALS_LABELS))
    columns = [c for c in NUMERIC if c in SPELLINGS or c == "age"]
    out = rows.select(key, html.cell("season").cast("int").alias("season"), html.cell("team").alias("team"), *[number(html.cell(c)).alias(c) for c in columns])
    playing = "PA" if side == "batting" else "batters_faced"
    best = Window.partitionBy(key, "season").orderBy(F.col(playing).desc_nulls_last(), F.col("team"))
    return out.withColumn("_k", F.row_number().over(best)).filter("_k = 1").drop("_k")


def failed_pages(pages: DataFrame, seasons: DataFrame, key: str = "page") -> DataFrame:
    """Pages that gave no season, with the reason: what the table function says, else that there is no season table."""
    missing = pages.join(seasons.select(key).distinct(), key, "left_anti")
    errors = html.page_rows(missing.select(key, "html"), "").select(key, "error")
    return missing.select(key).join(errors, key, "left").select(key, F.coalesce("error", F.lit("no season table")).alias("error"))


def page_league_totals(pages: DataFrame, side: str, key: str = "season") -> DataFrame:
    """A season page's sums: the first table with the side's columns (the season itself is the page's)."""
    rows = html.rows(pages).withColumn("cells", html.renamed_cells(CANONICAL)).filter(F.col("table_id").isNotNull())
    rows = html.with_signature(rows, tuple(c for c in SIGNATURES[side] if c != "season"), key)
    real = rows.filter(~F.lower(F.coalesce(html.cell("team"), F.lit(""))).isin(*TOTALS_LABELS) & (F.coalesce(html.cell("team"), F.lit("")) != ""))
    return summed(real.select(key, *[number(html.cell(c)).alias(c) for c in NUMERIC if c in SPELLINGS]), [key]).withColumn("side", F.lit(side))


# JSON statistics

SPLITS = "stats array<struct<splits:array<struct<season:string,gameType:string,stat:map<string,string>,team:struct<name:string>,sport:struct<id:int>>>>>"


def json_splits(docs: DataFrame, side: str, body: str = "body") -> DataFrame:
    """A row for each split of JSON documents: major-league regular seasons; absent sport or type passes.

    What is no JSON gives no rows. ``stat`` fields come under our names, absent ones null.
    """
    parsed = docs.withColumn("_j", F.from_json(body, SPLITS, {"mode": "PERMISSIVE"}))
    splits = parsed.withColumn("_s", F.explode(F.flatten(F.transform("_j.stats", lambda s: F.coalesce(s["splits"], F.array().cast("array<struct<season:string,gameType:string,stat:map<string,string>,team:struct<name:string>,sport:struct<id:int>>>"))))))
    s = F.col("_s")
    real = (F.coalesce(s["sport"]["id"], F.lit(MAJOR)) == MAJOR) & (F.coalesce(s["gameType"], F.lit(REGULAR)) == REGULAR) & (F.coalesce(F.size(s["stat"]), F.lit(0)) > 0)
    fields = {ours: number(F.try_element_at(s["stat"], F.lit(theirs))) for ours, theirs in JSON_FIELDS[side].items()}
    fields |= {"age": number(F.try_element_at(s["stat"], F.lit("age")))}
    return splits.filter(real).select(*[c for c in docs.columns if c != body], s["season"].try_cast("int").alias("season"), *[v.alias(c) for c, v in fields.items()], s["team"]["name"].alias("team"))


def json_failures(docs: DataFrame, body: str = "body") -> DataFrame:
    """Documents that give no splits, with the reason: no document, no JSON, or nothing in it."""
    bad = "_malformed"
    parsed = docs.withColumn("_j", F.from_json(body, f"{SPLITS}, {bad} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}))
    n = F.coalesce(F.aggregate("_j.stats", F.lit(0), lambda n, s: n + F.coalesce(F.size(s["splits"]), F.lit(0))), F.lit(0))
    reason = F.when(F.col(body).isNull(), "no document").when(F.col(f"_j.{bad}").isNotNull(), "no json").when(n == 0, "no splits")
    return parsed.select(*[c for c in docs.columns if c != body], reason.alias("error")).filter("error IS NOT NULL")


def summed(rows: DataFrame, by: list[str], largest: tuple[str, ...] = ("age",)) -> DataFrame:
    """Sums of counts by key, the largest age, innings by way of outs."""
    counts = [f.name for f in rows.schema if f.name not in (*by, *largest) and not isinstance(f.dataType, StringType)]

    def total(c: str) -> Column:
        return innings(F.sum(outs(F.col(c), 2))) if c == "IP" else F.sum(f"`{c}`")

    return rows.groupBy(*by).agg(*[total(c).alias(c) for c in counts], *[F.max(c).alias(c) for c in largest if c in rows.columns])


def player_seasons(docs: DataFrame, side: str, key: str = "key_mlbam") -> DataFrame:
    """One row for each player and season: a season's teams summed."""
    return summed(json_splits(docs, side), [key, "season"])


class SourceDown(RuntimeError):
    """The first pages all failed."""


def guard_source(pages: DataFrame, failures: DataFrame, least: int = 10) -> None:
    """Stop where at least ``least`` pages were read and all failed."""
    n = pages.count()
    if n >= least and failures.count() == n:
        raise SourceDown(f"all {n} pages failed")


def json_league_totals(docs: DataFrame, side: str) -> DataFrame:
    """Season totals over teams."""
    return summed(json_splits(docs, side).drop("age", "team"), ["season"]).withColumn("side", F.lit(side))


# The person register


def people(register: DataFrame) -> DataFrame:
    """Register rows with full name and date of birth from its parts; impossible dates are null."""
    full = F.btrim(F.concat_ws(" ", F.nullif(F.col("name_first"), F.lit("")), F.nullif(F.col("name_last"), F.lit(""))))
    born = F.try_make_timestamp(F.col("birth_year").try_cast("int"), F.col("birth_month").try_cast("int"), F.col("birth_day").try_cast("int"), F.lit(0), F.lit(0), F.lit(0))
    return register.withColumns({"name": full, "date_of_birth": born.cast("date")})


def played(register: DataFrame, first: str = "mlb_played_first") -> DataFrame:
    return register.filter(F.col(first).isNotNull())
