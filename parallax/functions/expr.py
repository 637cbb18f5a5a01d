"""Column factories: ratios, rates, thirds of innings, eligibility rules and labels.

All are plain expressions, so Catalyst folds, prunes and pushes them like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rates = Mapping[str, Callable[[DataFrame], Column]]


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den where den > 0, else null (also for negative, null and NaN denominators)."""
    return F.when((den > 0) & ~F.isnan(den.cast("double")), num / den)


def number(c: Column) -> Column:
    """Text to double: thousands commas go, what is no finite number becomes null."""
    value = F.regexp_replace(c.cast("string"), ",", "").try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def count_of(df: DataFrame, name: str) -> Column:
    """A counting column; absent columns and nulls are zero."""
    if name not in df.columns:
        return F.lit(0.0)
    value = F.col(f"`{name}`").try_cast("double")
    return F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(0.0))


# Innings: 5.1 is five and a third


def outs(ip: Column, places: int | None = None) -> Column:
    """Outs of innings in thirds; other fractions are taken as decimal innings, rounded to ``places``."""
    whole = F.floor(ip)
    third = F.bround((ip - whole) * 10, 0)
    decimal = ip * 3 if places is None else F.bround(ip * 3, places)
    return F.when(third.isin(0, 1, 2), whole * 3 + third).otherwise(decimal)


def innings(o: Column) -> Column:
    return F.floor(o / 3) + (o % 3) / 10


def _rate(num: str, den: str) -> Callable[[DataFrame], Column]:
    return lambda df: safe_ratio(count_of(df, num), count_of(df, den))


def _obp(df: DataFrame) -> Column:
    reached = count_of(df, "H") + count_of(df, "BB") + count_of(df, "HBP")
    return safe_ratio(reached, count_of(df, "AB") + count_of(df, "BB") + count_of(df, "HBP") + count_of(df, "SF"))


def _babip(df: DataFrame) -> Column:
    in_play = count_of(df, "AB") - count_of(df, "SO") - count_of(df, "HR") + count_of(df, "SF")
    return safe_ratio(count_of(df, "H") - count_of(df, "HR"), in_play)


BATTING: Rates = {
    "k_pct": _rate("SO", "PA"),
    "bb_pct": _rate("BB", "PA"),
    "hr_pct": _rate("HR", "PA"),
    "avg": _rate("H", "AB"),
    "obp": _obp,
    "slg": _rate("TB", "AB"),
    "iso": lambda df: _rate("TB", "AB")(df) - _rate("H", "AB")(df),
    "babip": _babip,
}
PITCHING: Rates = {
    "k_pct": _rate("SO", "batters_faced"),
    "bb_pct": _rate("BB", "batters_faced"),
    "hr_pct": _rate("HR", "batters_faced"),
    "h_pct": _rate("H", "batters_faced"),
    "era": lambda df: safe_ratio(count_of(df, "ER") * 27, F.coalesce(outs(count_of(df, "IP")), F.lit(0.0))),
}
RATE_SETS = {"batting": BATTING, "pitching": PITCHING}
PLAYING_TIME = {"batting": "PA", "pitching": "batters_faced"}
SCORE_NAME = {"batting": "relative OPS", "pitching": "relative strikeout rate"}


def relative_columns(side: str) -> list[str]:
    return [f"rel_{r}" for r in RATE_SETS[side]]


def add_rates(df: DataFrame, side: str, prefix: str = "") -> DataFrame:
    return df.withColumns({f"{prefix}{name}": rate(df) for name, rate in RATE_SETS[side].items()})


# Eligibility: fixed values of the posting and free agency rules
POSTING_SEASONS, OVERSEAS_SEASONS, DOMESTIC_SEASONS = 7, 8, 9
EXEMPT_AGE, EXEMPT_SEASONS = 25, 6


def eligibility(seasons: Column, age: Column, season: Column, fa_seasons: int = DOMESTIC_SEASONS) -> dict[str, Column]:
    """When someone with so many seasons can move, and under which rules; all outputs by name."""
    wait = F.greatest(F.lit(0), F.lit(POSTING_SEASONS) - seasons)
    posting, age_then = season + wait, age + wait
    exempt = F.coalesce((age_then >= EXEMPT_AGE) & (seasons + wait >= EXEMPT_SEASONS), F.lit(False))
    overseas = season + F.greatest(F.lit(0), F.lit(OVERSEAS_SEASONS) - seasons)
    domestic = season + F.greatest(F.lit(0), F.lit(fa_seasons) - seasons)
    past = seasons >= fa_seasons
    opens = F.greatest(season, posting)
    window = F.when(past, F.lit(0)).otherwise(F.greatest(F.lit(0), domestic - opens))
    return {
        "seasons_played": seasons,
        "seasons_until_posting_eligible": wait,
        "earliest_posting_season": posting,
        "age_at_earliest_posting": F.bround(age_then, 1),
        "bonus_pool_exempt_if_posted_then": exempt,
        "extra_years_for_pool_exemption": F.when(exempt, F.lit(0.0)).otherwise(F.bround(F.greatest(F.lit(0.0), EXEMPT_AGE - age_then), 1)),
        "note": F.when(exempt, "market contract").otherwise("pool-capped: bonus slot only"),
        "domestic_fa_season": domestic,
        "overseas_fa_season": overseas,
        "needs_club_consent_until": overseas,
        "past_first_fa": past,
        "acquisition_window_seasons": window,
        "window": F.when(window > 0, F.concat_ws("-", opens.cast("string"), (domestic - 1).cast("string"))).otherwise("closed"),
    }


# Labels


def informative(lo: Column, hi: Column, ratio: float = 3.0) -> Column:
    """Whether an interval is narrow enough to say something: 0 < lo and 0 < hi < ratio * lo."""
    return F.coalesce((lo > 0) & (hi > 0) & (hi / F.when(lo > 0, lo) < ratio), F.lit(False))


def trust(narrow: Column, r_squared: Column) -> Column:
    return F.when(F.coalesce(r_squared, F.lit(0.0)) < 0.10, F.when(narrow, "league average regardless").otherwise("too wide")).when(narrow, "usable").otherwise("too wide")


BAND_DEVIATIONS = 2 * 1.2816


def range_factor(residual_sd: Column) -> Column:
    """How many times larger the upper end of a typical 80 percent range is than the lower."""
    return F.exp(F.lit(BAND_DEVIATIONS) * residual_sd)


def verdict(r_squared: Column, slope: Column, residual_sd: Column) -> Column:
    strong = F.when(range_factor(residual_sd) > 3, "real pattern, too wide for one player").otherwise("usable signal")
    return F.when((r_squared >= 0.25) & (slope >= 0.3), strong).when(r_squared >= 0.10, "weak signal").otherwise("no usable signal")


#: What statistics are called and the order they are shown in.
PRETTY = {
    "avg": "Batting average",
    "obp": "On-base percentage",
    "slg": "Slugging",
    "iso": "Isolated power",
    "hr_pct": "Home run rate",
    "k_pct": "Strikeout rate",
    "bb_pct": "Walk rate",
    "babip": "Average on balls in play",
    "era": "Earned run average",
    "h_pct": "Hit rate allowed",
}
DISPLAY_ORDER = ("avg", "obp", "slg", "iso", "hr_pct", "k_pct", "bb_pct", "babip", "era", "h_pct")
# Statistics of which less is better.
LOWER_IS_BETTER = ("k_pct", "era", "h_pct")


def lookup(values: Mapping, key: Column) -> Column:
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def pretty(stat: Column) -> Column:
    return F.coalesce(lookup(PRETTY, stat), stat)


def display_rank(stat: Column, order=DISPLAY_ORDER) -> Column:
    """Place in a custom order; what it lacks comes last."""
    return F.coalesce(lookup({s: i for i, s in enumerate(order)}, stat), F.lit(99))
