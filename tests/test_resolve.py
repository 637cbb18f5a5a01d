from datetime import date

from parallax.operators import resolve

HOME = "player_register_id string, player string, date_of_birth date"
AWAY = "key_mlbam long, name string, date_of_birth date"
BORN = date(1998, 8, 20)


def link(spark, home, away, register=None):
    reg = None if register is None else spark.createDataFrame(register, "key_bbref_minors string, key_mlbam double")
    return resolve.crosswalk(spark.createDataFrame(home, HOME), spark.createDataFrame(away, AWAY), reg)


def pairs(found):
    return sorted((r["player_register_id"], r["key_mlbam"], r["match_tier"]) for r in found.matches.collect())


def test_tiers(spark):
    home = [("a", "Lee Jung-hoo", BORN), ("b", "Yi Jeong-hu", date(1990, 1, 1)), ("c", "Ha-seong Kim", date(1995, 10, 17)), ("d", "Nobody Here", date(1980, 1, 1))]
    away = [(1, "Jung Hoo Lee", BORN), (2, "Jung Ho Lee", date(1990, 1, 1)), (3, "Ha Seong Kim", date(1995, 1, 1))]
    found = link(spark, home, away)
    assert pairs(found) == [("a", 1, "name_dob"), ("b", 2, "phonetic_dob")]
    queue = sorted((r["player_register_id"], r["review_reason"]) for r in found.review_queue.collect())
    assert queue == [("c", "low_confidence_proposal"), ("c", "no_match"), ("d", "no_match")]
    stats = found.stats.first()
    assert (stats["kbo_players"], stats["matched"], stats["match_rate"]) == (4, 2, 0.5) and dict(stats["by_tier"]) == {"name_dob": 1, "phonetic_dob": 1}


def test_ambiguous_keys_match_nothing(spark):
    found = link(spark, [("a", "Lee Jung-hoo", BORN), ("b", "Jung Hoo Lee", BORN)], [(1, "Jung Hoo Lee", BORN)])
    assert pairs(found) == [] and found.review_queue.count() == 2


def test_birth_date_stops_names_that_sound_alike(spark):
    assert pairs(link(spark, [("a", "Jung Hoo Lee", BORN)], [(1, "Jung Ho Lee", date(1987, 1, 1))])) == []


def test_register_ids_with_nulls_and_repeats(spark):
    home = [("a", "X Y", None), (None, "Z", None), ("b", "Q R", None)]
    away = [(7, "Other Name", None), (None, "N", None)]
    register = [("a", 7.0), ("a", 7.0), (None, None), (None, 7.0), ("b", None)]
    found = link(spark, home, away, register)
    assert pairs(found) == [("a", 7, "register_id")]


def test_overrides(spark):
    found = link(spark, [("a", "A B", BORN), ("b", "C D", BORN)], [(1, "E F", BORN)])
    decided = spark.createDataFrame([("a", 1, "accept"), ("b", 1, "reject")], "player_register_id string, key_mlbam long, decision string")
    after = resolve.with_overrides(found, decided)
    assert pairs(after) == [("a", 1, "manual")] and after.review_queue.count() == 0


def test_empty_tables(spark):
    found = link(spark, [], [])
    assert pairs(found) == [] and found.stats.first()["match_rate"] == 0
