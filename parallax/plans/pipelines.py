"""The commands, as functions over a folder of tables: link, audit, model, project, count, and the roster.

Everything but the reports stays lazy. Folders may lie in any store that Spark reads.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.functions import expr, names
from parallax.operators import evaluate, lookup, model, quality, rates, resolve, screen, timeline
from parallax.plans import report
from parallax.sources import records, tables
from parallax.sources.stored import stored
from parallax.sources.urls import Sites, with_pages

SITES = Sites()

COUNTS = "PA double, AB double, H double, `2B` double, `3B` double, HR double, SO double, BB double, HBP double, SF double, TB double, batters_faced double, IP double, ER double, G double"
ABOUT = "batting_avg double, onbase_perc double, slugging_perc double, earned_run_avg double"
HOME = f"player_register_id string, player string, season int, team_name string, team_bref_id string, age double, {COUNTS}, {ABOUT}"
AWAY = f"key_mlbam long, key_bbref string, name string, season int, age double, {COUNTS}"
TOTALS = f"season int, side string, {COUNTS}"
ROSTER = "player_register_id string, player string, season int, team_name string, date_of_birth date, birth_city string"
LINKS = "player_register_id string, key_mlbam long, key_bbref string, match_tier string, match_confidence double"
MIN_PLAYING_TIME = {"batting": 100, "pitching": 100}
LEAST_COVERAGE = 0.80


@dataclass
class Store:
    """Tables of a folder by name, as CSV; absent optional tables are empty."""

    spark: SparkSession
    folder: str

    def read(self, name: str, schema: str, required: bool = False, place: str | None = None) -> DataFrame:
        return tables.read_csv(self.spark, f"{self.folder}/{name}.csv", schema, required, place)

    def write(self, df: DataFrame, name: str) -> None:
        tables.write_csv(df, f"{self.folder}/{name}.csv")

    def exists(self, name: str) -> bool:
        return tables.exists(self.spark, f"{self.folder}/{name}.csv")


def scrape(store: Store, index: DataFrame, seasons: DataFrame, teams: DataFrame, start: int, end: int) -> records.Crawl:
    """Cached pages to the four home tables."""
    found = records.crawl(index, seasons, teams, start, end)
    for name, df in (("kbo_batting", found.batting), ("kbo_pitching", found.pitching), ("kbo_roster", found.roster), ("kbo_league_totals", found.league_totals)):
        store.write(df, name)
    return found


def scrape_cached(store: Store, cache: str, start: int, end: int, sites: Sites = SITES) -> records.Crawl:
    """``scrape`` over a folder of cached pages: the index leads to seasons, those to teams."""
    pages = tables.read_pages(store.spark, cache)
    one = store.spark.range(1).select(F.lit("index").alias("k"))
    index = with_pages(one, sites.league_index(), pages).select(F.col("k").alias("page"), "html")
    seasons = with_pages(records.season_index(index).select("season_id").distinct(), sites.season(F.col("season_id")), pages)
    named = records.season_teams(seasons.withColumnRenamed("season_id", "page")).select("team_bref_id").distinct()
    return scrape(store, index, seasons, with_pages(named, sites.team(F.col("team_bref_id")), pages), start, end)


class TooFewTeams(RuntimeError):
    """League totals that cover too few seasons to be a baseline."""


def fetch_away(store: Store, docs: dict[str, DataFrame], league_docs: dict[str, DataFrame], start: int, end: int) -> None:
    """JSON documents by side to the away tables; refuses totals of under 80 percent of the season rows."""
    totals = [records.json_league_totals(df, side) for side, df in league_docs.items()]
    united = totals[0]
    for t in totals[1:]:
        united = united.unionByName(t, allowMissingColumns=True)
    n = united.filter(F.col("season").between(start, end)).count()
    if n < LEAST_COVERAGE * (end - start + 1) * len(league_docs):
        raise TooFewTeams(f"{n} league rows")
    store.write(united, "mlb_league_totals")
    for side, df in docs.items():
        store.write(records.player_seasons(df, side), f"mlb_{side}")


def link(store: Store, register: DataFrame) -> resolve.Crosswalk:
    """The crosswalk of the roster's players (their first record with a birth date) and the register's."""
    roster = store.read("kbo_roster", ROSTER, True, "ordinal").filter("player_register_id IS NOT NULL")
    home = resolve.best_record(roster, "player_register_id", [F.asc_nulls_last("date_of_birth"), F.asc("ordinal")])
    known = records.people(register)
    found = resolve.crosswalk(home, records.played(known), known)
    store.write(found.matches, "crosswalk")
    store.write(found.review_queue, "crosswalk_review_queue")
    return found


def audit(store: Store, start: int, end: int) -> tuple[DataFrame, str, int]:
    """(checks, report, exit code): 1 where a check failed with an error."""
    batting, pitching = store.read("kbo_batting", HOME, True), store.read("kbo_pitching", HOME, True)
    roster, totals = store.read("kbo_roster", ROSTER), store.read("kbo_league_totals", TOTALS)
    linked = None
    if store.exists("crosswalk"):
        matches = store.read("crosswalk", LINKS)
        people, none = batting.select("player_register_id").distinct(), matches.limit(0)
        linked = resolve.Crosswalk(matches, none, resolve.statistics(people, none, matches, none))
    results = stored(quality.run_all(batting, pitching, roster, totals, start, end, linked), "audit")
    return results, report.audit(results), int(quality.has_errors(results))


def id_map(links: DataFrame, key: str) -> DataFrame:
    return links.select("player_register_id", key).dropna().distinct()


def relative(store: Store, side: str, min_playing_time: float | None = None, source: str = "") -> tuple[DataFrame, DataFrame]:
    """Home and linked away seasons relative to their leagues. Away tables link by whichever key they have."""
    least = MIN_PLAYING_TIME[side] if min_playing_time is None else min_playing_time
    links = store.read("crosswalk", LINKS, True)
    away = store.read(f"mlb_{side}{source}", AWAY, True, "ordinal")
    by = [away.filter(F.col(k).isNotNull()).join(id_map(links, k), k) for k in ("key_mlbam", "key_bbref")]
    away = by[0].unionByName(by[1].filter("key_mlbam IS NULL"))
    out = []
    for league, rows in (("kbo", store.read(f"kbo_{side}", HOME, True, "ordinal")), ("mlb", away)):
        totals = store.read(f"{league}_league_totals{source if league == 'mlb' else ''}", TOTALS, True)
        out.append(rates.relative_rates(rows, rates.league_rates(totals, side), side, least))
    return out[0], out[1]


def pairs_of(home: DataFrame, away: DataFrame) -> DataFrame:
    return timeline.attach(timeline.build_pairs(home, away), timeline.classify(home, away))


@dataclass
class Modelled:
    pairs: DataFrame
    fits: DataFrame
    inversion: DataFrame
    cases: DataFrame
    scores: DataFrame
    report: str


class NothingToFit(RuntimeError):
    """No crossings, or too few of them."""


def fit(store: Store, side: str, min_playing_time: float | None = None, direction: str | None = None, draws: int = 200, source: str = "") -> Modelled:
    """Fit without the posted cohort, validate on it, and write the tables and the report's parts."""
    pairs = stored(pairs_of(*relative(store, side, min_playing_time, source)), "pairs")
    train, _ = evaluate.split(pairs, direction=direction)
    rows = model.design(train, list(expr.RATE_SETS[side]))
    fits = model.fit(rows)
    if fits.isEmpty():
        raise NothingToFit("not enough usable pairs to fit any statistic")
    cases = stored(evaluate.holdout(pairs, side, draws=draws, direction=direction), "cases")
    scores = evaluate.scorecard(cases)
    out = Modelled(pairs, fits, model.inversion(rows), cases, scores, report.validation(side, model.summary(fits), scores, cases))
    for name, df in (("pairs", pairs), ("translation", model.summary(fits)), ("inversion", out.inversion), ("holdout", cases)):
        store.write(df, f"{name}_{side}")
    return out


def sample_sizes(store: Store, side: str, source: str = "") -> DataFrame:
    """One row: players in both leagues, with and without the minimum of playing time."""
    home, away = relative(store, side, 0, source)
    least = MIN_PLAYING_TIME[side]
    counts = []
    for label, n in (("all", 0), ("qualified", least)):
        a = rates.at_least(home, expr.PLAYING_TIME[side], n).select("player_register_id").distinct()
        b = rates.at_least(away, expr.PLAYING_TIME[side], n).select("player_register_id").distinct()
        counts.append(a.join(b, "player_register_id", "left_semi").agg(F.count(F.lit(1)).alias(label)))
    return counts[0].crossJoin(counts[1])  # one row each


@dataclass
class Bundle:
    """What the roster, screen and projection queries need of one side and season."""

    side: str
    season: int
    home: DataFrame
    raw: DataFrame
    league: DataFrame
    fits: DataFrame
    drawn: DataFrame
    profile: DataFrame
    cities: DataFrame
    korean_only: bool = True
    before_free_agency: bool = True
    fa_seasons: int = expr.DOMESTIC_SEASONS
    strictness: str = "balanced"
    interest_only: bool = True
    train: DataFrame | None = field(default=None)

    @cached_property
    def seasons(self) -> DataFrame:
        """From unfiltered rows: service accrues whatever the playing time."""
        return timeline.seasons_by_player(self.raw)

    def roster(self, filtered: bool = True) -> DataFrame:
        """One row for each player of the season: eligibility, score, screen, and congestion after the filters."""
        playing = expr.PLAYING_TIME[self.side]
        now = timeline.latest(self.home.filter(F.col("season") == self.season), "player_register_id", F.desc_nulls_last(playing), F.asc("team_name"))
        out = now.select("player_register_id", "player", "team_name", "age", playing).join(self.seasons, "player_register_id", "left").join(self.cities, "player_register_id", "left")
        korean, signal = names.nationality(names.keys("player", "is_korean")["is_korean"], F.col("birth_city"))
        n = F.coalesce("seasons", F.lit(1)).cast("int")
        out = out.withColumns({"seasons": n, "korean": korean, "nationality_source": signal}).drop("birth_city")
        rules = expr.eligibility(F.col("seasons"), F.col("age"), F.lit(self.season), self.fa_seasons)
        out = out.withColumns({c: rules[c] for c in ("past_first_fa", "earliest_posting_season", "overseas_fa_season")})
        if filtered and self.korean_only:
            out = out.filter("korean")
        if filtered and self.before_free_agency:
            out = out.filter("NOT past_first_fa")
        recent = timeline.recent_before(self.home, None, "player_register_id", "season", 2)
        out = out.join(screen.score(recent, self.side, ["player_register_id"]), "player_register_id", "left")
        out = screen.screened(out, screen.bar(self.profile, self.strictness)).withColumnRenamed("admitted", "clears_screen").drop("threshold")
        if filtered and self.interest_only:
            out = out.filter("clears_screen")
        return timeline.congestion(out)

    def screen(self) -> DataFrame:
        return screen.screen_counts(self.roster(False).select("player", "score"), self.profile, self.strictness)

    @cached_property
    def index(self) -> DataFrame:
        """Home rows by the sound of their names, stored."""
        return lookup.name_index(self.home)

    def find(self, query: str) -> DataFrame:
        """Rows of players whose name sounds like the query."""
        return lookup.find_one(self.index, query).drop("loose_key").orderBy("season")

    def project(self, players: DataFrame | list[str]) -> DataFrame:
        """Projections with trust, labels and eligibility, in display order."""
        rows = self.home.filter(F.col("player_register_id").isin(players)) if isinstance(players, list) else self.home.join(players.select("player_register_id").distinct(), "player_register_id", "left_semi")
        stats = list(expr.RATE_SETS[self.side])
        out = evaluate.project(rows, self.drawn, self.league, self.side, stats).join(self.fits.select("stat", "r_squared"), "stat", "left")
        narrow = expr.informative(F.col("p10_relative"), F.col("p90_relative"))
        out = out.withColumns({"trust": expr.trust(narrow, F.col("r_squared")), "label": expr.pretty(F.col("stat")), "lower_is_better": F.col("stat").isin(*expr.LOWER_IS_BETTER)})
        out = out.withColumn("informative", F.col("trust") == "usable").join(self.seasons, "player_register_id", "left").withColumn("seasons", F.coalesce("seasons", F.lit(1)).cast("int"))
        rules = expr.eligibility(F.col("seasons"), F.col("age"), F.lit(self.season), self.fa_seasons)
        return out.withColumns(rules).drop("seasons", "r_squared").orderBy("player_register_id", expr.display_rank(F.col("stat")))

    def top(self, n: int = 5) -> DataFrame:
        """The season's players with the most playing time."""
        return self.home.filter(F.col("season") == self.season).orderBy(F.desc_nulls_last(expr.PLAYING_TIME[self.side]), "player_register_id").limit(n)

    def quality(self) -> DataFrame:
        """How far each fit is to be believed."""
        f = self.fits
        return f.select("stat", expr.pretty(F.col("stat")).alias("label"), F.bround("retention_slope", 3).alias("retention_slope"), F.bround("r_squared", 3).alias("r_squared"), "n_pairs", F.format_string("%.1fx", expr.range_factor(F.col("residual_sd"))).alias("typical_range"), expr.verdict(F.col("r_squared"), F.col("retention_slope"), F.col("residual_sd")).alias("verdict")).orderBy(expr.display_rank(F.col("stat")))


def projections(store: Store, side: str, season: int, players: list[str] | None = None, top: int = 5, min_playing_time: float = 150, direction: str | None = "mlb_to_kbo", draws: int = 200, source: str = "") -> DataFrame:
    """Projections of the named players active in a season, or of those with the most playing time; written too."""
    bundle = load(store, side, season, min_playing_time, direction, draws, source)
    if players:
        typed = store.spark.createDataFrame([(p,) for p in players], "typed string").distinct()
        chosen = lookup.find(bundle.index.filter(F.col("season") == season), typed)
    else:
        chosen = bundle.top(top)
    named = chosen.groupBy("player_register_id").agg(F.max("player").alias("player"))
    out = bundle.project(named).join(named, "player_register_id")
    store.write(out, f"projections_{side}_{season}")
    return out


def load(store: Store, side: str = "batting", season: int = 2026, min_playing_time: float = 150, direction: str | None = "mlb_to_kbo", draws: int = 400, source: str = "", **options) -> Bundle:
    """Everything for a season. Whether someone was posted counts all his away seasons, however short."""
    home, away = relative(store, side, min_playing_time, source)
    pairs = pairs_of(home, away)
    train, _ = evaluate.split(pairs, direction=direction)
    rows = stored(model.design(train, list(expr.RATE_SETS[side])), "design")
    _, any_away = relative(store, side, 1, source)
    roster = store.read("kbo_roster", ROSTER).filter("player_register_id IS NOT NULL")
    cities = timeline.latest(roster, "player_register_id", F.desc("season")).select("player_register_id", "birth_city")
    posted = timeline.classify(home, any_away).filter(F.col("cohort") == timeline.POSTED)
    cohort = screen.profile(home, posted, side).join(cities, "player_register_id", "left")
    korean, _ = names.nationality(names.keys("player", "is_korean")["is_korean"], F.col("birth_city"))
    cohort = cohort.filter(korean).drop("birth_city")
    league = rates.league_rates(store.read(f"mlb_league_totals{source}", TOTALS, True), side)
    return Bundle(side, season, home, store.read(f"kbo_{side}", HOME, True), league, model.fit(rows), model.with_noise(model.bootstrap(rows, draws)), cohort, cities, train=train, **options)
