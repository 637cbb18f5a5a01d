"""What the operators of this subpackage share: tables, the shared folder, streamed reductions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.session import workers_see_package

#: Odd multipliers and the finalizer of a 64-bit mixing function.
MIX_A = np.uint64(0xFF51AFD7ED558CCD)
MIX_B = np.uint64(0xC4CEB9FE1A85EC53)


#: Bytes and rows of texts handed to a Python worker at a time; the JVM holds as much outside its heap.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 4000


def ready(spark: SparkSession) -> SparkSession:
    """Workers import the package, and get batches of bounded bytes, however long texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return workers_see_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Where a session of one machine, as in tests, names no folder.
LOCAL_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, which a cluster must set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or LOCAL_DIR).rstrip("/")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder and read it back.

    The files survive a lost executor and go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/parallax/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete stored tables whose readers are done."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            spark = df.sparkSession
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of a table, of at most 100 bytes each, that is broadcast to a join, and what its rows are repeated by beyond.
BROADCAST_ROWS = 50_000
SALTS = 32


def keyed(rows: DataFrame, table: DataFrame, n: int, key: str, by: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``table``, of ``n`` rows, on ``key``; rows of one key are dealt by ``by``, never one task's alone."""
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key, how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(F.lit(11), by), F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"], how).drop("_salt")


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_B
    return x ^ (x >> np.uint64(33))


def null_to_empty(texts: pd.Series) -> list[str]:
    return ["" if t is None or t != t else t for t in texts]


def arrow_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as an Arrow batch; unlike pandas, which makes doubles of long columns with nulls, it keeps every id."""
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def sum_blocks(partials: DataFrame, parts: int) -> dict[int, np.ndarray]:
    """Sum rows (block int, body binary of float32) by block, streamed, and bring the sums to the driver.

    The result is as large as all blocks together, whatever the input; the caller bounds it.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for block, body in zip(pdf["block"], pdf["body"], strict=True):
                part = np.frombuffer(body, np.float32)
                if block in sums:
                    sums[block] += part
                else:
                    sums[block] = part.astype(np.float64)
        yield pd.DataFrame({"block": list(sums), "body": [s.astype(np.float32).tobytes() for s in sums.values()]}, columns=["block", "body"])

    spread = partials.repartition(parts, "block").mapInPandas(add, "block int, body binary")
    return {r["block"]: np.frombuffer(r["body"], np.float32) for r in spread.collect()}


def hashed_share(key: str, share: float, seed: int):
    """A condition that holds for about ``share`` of the keys, always for the same ones."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < int(round(min(1.0, share) * 1_000_000))


Batches = Iterator[pd.DataFrame]
BatchFunction = Callable[[Batches], Batches]
ArrowBatches = Iterator[pa.RecordBatch]
