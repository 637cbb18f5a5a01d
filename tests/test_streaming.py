from pyspark.sql import functions as F

from parallax.operators import timeline
from parallax.session import workers_see_package
from parallax.streaming import crossings


def test_stream_finds_what_the_batch_finds(spark, tmp_path):
    workers_see_package(spark)
    rows = [(k, day, label, k * 1000 + day * 10 + i) for k in range(12) for day in range(k % 4, 30, 1 + k % 3) for i, label in enumerate(["buy", "view"][(k + day) % 2 :])]
    events = spark.createDataFrame(rows, "user_id long, day long, event_type string, event_id long")
    for part, (lo, hi) in enumerate(((0, 10), (10, 20), (20, 31))):
        events.filter(F.col("day").between(lo, hi - 1)).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    found = crossings.switches(stream, "user_id", "day", "event_type", "event_id", 2)
    run = found.writeStream.format("memory").queryName("crossed").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = sorted((r["key"], r["from_ordinal"], r["to_ordinal"], r["gap"]) for r in spark.table("crossed").collect())
    batch = timeline.switches(events, "user_id", "day", "event_type", F.col("event_id"), None, 2)
    assert got == sorted((r["user_id"], r["before"]["event_id"], r["after"]["event_id"], r["gap"]) for r in batch.collect()) and got
