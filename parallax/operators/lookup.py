"""Stored tables that lookups join without moving them: bucketed and sorted by key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax.functions import names
from parallax.sources.stored import new_path

BUCKETS = 64


def bucketed(df: DataFrame, key: str, tag: str, buckets: int = BUCKETS) -> DataFrame:
    """``df`` as a table in the shared folder, in buckets by ``key`` and sorted within; a join or a window on the key moves only the other side.

    An equality with the key opens one bucket, which is one file: rows are dealt by bucket before they are written.
    """
    spark, name = df.sparkSession, f"parallax_{tag}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", new_path(spark, tag)).saveAsTable(name)
    return spark.table(name)


def name_index(rows: DataFrame, name: str = "player", buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with the phonetic key of a name, ``loose_key``, stored by it; rows without a key are left out."""
    keyed = rows.withColumn("loose_key", names.keys(name, "loose")["loose"]).filter("loose_key IS NOT NULL")
    return bucketed(keyed, "loose_key", "names", buckets)


def find(index: DataFrame, typed: DataFrame, name: str = "typed") -> DataFrame:
    """Rows of a name index that sound like the typed names, each beside its name; nothing of the index is moved."""
    return typed.withColumn("loose_key", names.keys(name, "loose")["loose"]).filter("loose_key IS NOT NULL").join(index, "loose_key")


def find_one(index: DataFrame, typed: str) -> DataFrame:
    """Rows of a name index that sound like one typed name, from the one bucket that may have them."""
    key = index.sparkSession.range(1).select(names.keys(F.lit(typed), "loose")["loose"]).first()[0]
    return index.filter(F.col("loose_key") == F.lit(key))
