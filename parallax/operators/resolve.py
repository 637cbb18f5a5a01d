"""Tiered, ambiguity-rejecting entity resolution."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallax.functions import names

# How sure each tier is, and which are accepted without review.
CONFIDENCE = {"register_id": 1.00, "name_dob": 0.95, "phonetic_dob": 0.90, "phonetic_year": 0.60, "manual": 1.0}
AUTOMATIC = ("register_id", "name_dob", "phonetic_dob")


@dataclass
class Crosswalk:
    matches: DataFrame
    review_queue: DataFrame
    stats: DataFrame
    extra: dict = field(default_factory=dict)


def unique_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are all known and that no other row shares."""
    whole = df.dropna(subset=keys)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return whole.withColumn("_n", n).filter("_n = 1").drop("_n")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that occur once on either side; ambiguous keys match nothing."""
    return unique_keys(left, keys).join(unique_keys(right, keys), keys)


def bridged(left: DataFrame, bridge: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Two hops over a table of id pairs; null ids and repeated ids of the bridge are left out first."""
    pairs = bridge.select(left_key, right_key).dropna().groupBy(left_key).agg(F.min(right_key).alias(right_key))
    return left.join(pairs, left_key).join(right.dropna(subset=[right_key]).dropDuplicates([right_key]), right_key)


def tier(name: str) -> dict[str, Column]:
    return {"match_tier": F.lit(name), "match_confidence": F.lit(CONFIDENCE[name])}


def prepared(df: DataFrame, name: str, born: str, suffix: str, keep: str) -> DataFrame:
    """(id, name, match keys); a date of birth that is none is null."""
    k = names.keys(F.col(name), "strict", "loose")
    date = F.col(born).try_cast("date")
    return df.select(keep, F.col(name).alias(f"name_{suffix}"), k.alias("_k"), date.alias("_dob")).select(
        keep, f"name_{suffix}", F.col("_k.strict").alias("_strict"), F.col("_k.loose").alias("_loose"), "_dob", F.year("_dob").alias("_birth_year")
    )


TIERS = ((["_strict", "_dob"], "name_dob"), (["_loose", "_dob"], "phonetic_dob"), (["_loose", "_birth_year"], "phonetic_year"))


def tiered(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tiers, linked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(matches, proposals): each tier joins one to one what no accepted tier before has linked.

    ``tiers``: (keys, name); tiers that are not automatic only propose. ``linked``: matches made before.
    """
    columns = [left_id, right_id, "match_tier", "match_confidence"]
    matches = None if linked is None else linked.select(*columns)
    proposals = None
    for keys, name in tiers:
        rest = left if matches is None else left.join(matches.select(left_id), left_id, "left_anti")
        hit = one_to_one(rest, right, keys).withColumns(tier(name)).select(*columns)
        if name in AUTOMATIC:
            matches = hit if matches is None else matches.unionByName(hit)
        else:
            proposals = hit if proposals is None else proposals.unionByName(hit)
    empty = left.select(left_id, F.lit(None).cast(dict(right.dtypes)[right_id]).alias(right_id)).withColumns(tier("manual")).filter(F.lit(False))
    return (matches if matches is not None else empty), (proposals if proposals is not None else empty)


def review_queue(left: DataFrame, matches: DataFrame, proposals: DataFrame, left_id: str) -> DataFrame:
    """What stays unmatched, and proposals; a proposed entity is in it twice, for either reason."""
    unmatched = left.join(matches.select(left_id), left_id, "left_anti").withColumn("review_reason", F.lit("no_match"))
    return unmatched.unionByName(proposals.withColumn("review_reason", F.lit("low_confidence_proposal")), allowMissingColumns=True)


def crosswalk(home: DataFrame, away: DataFrame, register: DataFrame | None = None, home_id: str = "player_register_id", away_id: str = "key_mlbam", home_name: str = "player", away_name: str = "name", born: str = "date_of_birth", bridge_id: str = "key_bbref_minors") -> Crosswalk:
    """Links between two player tables: by register ids, name and birth date, sound and birth date.

    Sound and birth year only propose. The right side is not reduced between tiers.
    """
    left, right = prepared(home, home_name, born, "home", home_id), prepared(away, away_name, born, "away", away_id)
    linked = None
    if register is not None and {bridge_id, away_id} <= set(register.columns):
        ids = register.select(F.col(bridge_id).alias(home_id), F.col(away_id).cast(dict(away.dtypes)[away_id]).alias(away_id))
        linked = bridged(left.select(home_id), ids, right.select(away_id), home_id, away_id).withColumns(tier("register_id"))
    matches, proposals = tiered(left, right, home_id, away_id, TIERS, linked)
    names_of = left.select(home_id, "name_home").dropDuplicates([home_id])
    matches = matches.join(names_of, home_id, "left").join(right.select(away_id, "name_away").dropDuplicates([away_id]), away_id, "left")
    queue = review_queue(left.drop("_strict", "_loose", "_birth_year"), matches, proposals, home_id)
    return Crosswalk(matches, queue, statistics(left, right, matches, queue))


def statistics(left: DataFrame, right: DataFrame, matches: DataFrame, queue: DataFrame) -> DataFrame:
    """One row: sizes, rate of matches and matches by tier."""

    def size(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name))

    tiers = matches.groupBy("match_tier").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("match_tier", "n")))).alias("by_tier"))
    out = size(left, "kbo_players").crossJoin(size(right, "mlb_players")).crossJoin(size(matches, "matched")).crossJoin(size(queue, "review_queue")).crossJoin(tiers)
    return out.withColumn("match_rate", F.bround(F.col("matched") / F.greatest(F.col("kbo_players"), F.lit(1)), 4))


def with_overrides(found: Crosswalk, decisions: DataFrame, home_id: str = "player_register_id", away_id: str = "key_mlbam") -> Crosswalk:
    """Accepted decisions join the matches; all decided leave the queue."""
    accepted = decisions.filter("decision = 'accept'").select(home_id, away_id).withColumns(tier("manual"))
    matches = found.matches.unionByName(accepted, allowMissingColumns=True)
    queue = found.review_queue.join(decisions.select(home_id).distinct(), home_id, "left_anti")
    return Crosswalk(matches, queue, found.stats)


def best_record(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key by an order that should end in an ordinal."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_k = 1").drop("_k")
