from pathlib import Path

from pyspark.sql import functions as F

from parallax.operators import lookup, timeline


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookups_leave_the_stored_side_where_it_is(spark):
    rows = spark.createDataFrame([("Dae Sol Nam", 1), ("Tae-Sol Nam", 2), ("Gon Woo Oh", 3), ("***", 4), (None, 5)], "player string, n int")
    index = lookup.name_index(rows, buckets=4)
    typed = spark.createDataFrame([("Nam, Dae Sol",), ("nobody",), (None,)], "typed string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    found = lookup.find(index, typed)
    text = plan(found)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r["typed"], r["n"]) for r in found.collect()) == [("Nam, Dae Sol", 1), ("Nam, Dae Sol", 2)]
    assert "SortMergeJoin" in text and text.count("Exchange") == 1 and text.index("Exchange") < text.index("Scan ExistingRDD") < text.index("FileScan")
    one = lookup.find_one(index, "Tae Sol Nam")
    assert sorted(r["n"] for r in one.collect()) == [1, 2] and lookup.find_one(index, "***").count() == 0
    own = {r[0] for r in one.select(F.input_file_name()).collect()}
    others = [f for f in index.inputFiles() if f not in own]
    for f in others:
        Path(f.removeprefix("file://")).write_bytes(b"no parquet")
    assert len(own) == 1 and others and one.count() == 2  # the other buckets are not opened


def test_distinct_whole_numbers_and_days(spark):
    rows = [("a", 2001), ("a", 2001), ("a", -5), ("a", 2064), ("b", None), (None, 3), ("c", 2**31 - 1), ("c", -(2**31))]
    for kind in ("int", "long", "double", "string"):
        df = spark.createDataFrame(rows, "k string, n int").withColumn("n", F.col("n").cast(kind))
        assert {r["k"]: r["seasons"] for r in timeline.seasons_by_player(df, "k", "n").collect()} == {"a": 3, "b": 0, "c": 2}
        assert {r["k"]: r["n_x"] for r in timeline.spans(df, "k", "n", "x").collect()} == {"a": 3, "c": 2}
    days = spark.sql("SELECT 'k' AS k, d FROM VALUES (DATE '1969-12-31'), (DATE '1970-01-01'), (DATE '1970-01-01'), (DATE '2024-02-29') AS t(d)")
    (r,) = timeline.spans(days, "k", "d", "x").collect()
    assert (str(r["first_x"]), str(r["last_x"]), r["n_x"]) == ("1969-12-31", "2024-02-29", 3)
    assert timeline.spans(spark.createDataFrame([], "k string, n int"), "k", "n", "x").count() == 0
    assert plan(timeline.seasons_by_player(spark.createDataFrame(rows, "k string, n int"), "k", "n")).count("bit_or") >= 2


def test_sample_sizes(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 200), ("b", 3), (None, 900), ("c", None)], "k string, n int")
    assert tuple(timeline.sample_sizes(rows, "k", "n", 100).first()) == (3, 1, 4, 1)
    assert tuple(timeline.sample_sizes(rows.limit(0), "k", "n", 100).first()) == (0, 0, 0, 0)
