"""Typed scans that tolerate absent files and columns, and table sinks."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


class MissingInput(FileNotFoundError):
    """A required table is absent or has no rows."""


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


#: Where a row stands: its file, the first byte of its part of the file, and its place there. The order of these is the order
#: of rows in files by name, however Spark splits the files.
ORDINAL = "struct<file:string,block:bigint,row:bigint>"


def ordinal() -> Column:
    """A row's place, of a table that comes straight from files; parts of a file are read whole and in order by one task each."""
    row = F.monotonically_increasing_id()
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), row.alias("row"))


def first_line(spark: SparkSession, path: str) -> str:
    """The first line of a file, or of the first file with content of a folder; compressed ones too."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    where = hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    files = sorted((f for f in fs.listStatus(where) if f.isFile() and f.getLen() and not f.getPath().getName().startswith(("_", "."))), key=lambda f: f.getPath().getName())
    if not files:
        return ""
    stream = fs.open(files[0].getPath())
    codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(files[0].getPath())
    io = spark.sparkContext._jvm.java.io
    lines = io.BufferedReader(io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
    try:
        return (lines.readLine() or "").removeprefix("\ufeff")
    finally:
        lines.close()


#: The whole record of a row that has more or fewer cells than its header.
MALFORMED = "_malformed"


def scans(spark: SparkSession, paths: list[str], schema: StructType, place: str | None, apart: bool) -> DataFrame | None:
    """One scan for each header among the shards, typed and united; with ``apart`` and the column ``MALFORMED``."""
    by_header: dict[tuple[str, ...], list[str]] = {}
    for p in paths:  # a small read for each shard, as the driver has their names
        header = next(csv.reader([first_line(spark, p)]), [])
        if header:
            by_header.setdefault(tuple(header), []).append(p)
    frames = []
    for header, own in by_header.items():
        fields = [StructField(c, StringType()) for c in header]
        raw = spark.read.schema(StructType([*fields, StructField(MALFORMED, StringType())] if apart else fields))
        raw = raw.options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=MALFORMED).csv(own)
        typed = [(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in header else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]
        cells = F.array(*[F.col(f"`{c}`") for c in header])
        frames.append(raw.select(*typed, *([ordinal().alias(place)] if place else []), *([F.col(MALFORMED), cells.alias("_cells")] if apart else [])))
    return reduce(DataFrame.unionByName, frames) if frames else None


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str, required: bool = False, place: str | None = None) -> DataFrame:
    """CSV files with a header, by the declared schema; cells that don't fit are null.

    Columns are found by their names in the header, whatever their order; absent ones are null. Files
    that are absent give no rows, or MissingInput if ``required``. A list of paths is one table in shards, which are read by one
    scan for each header among them. ``place``: the name of a column for ``ordinal``.
    """
    schema = spark.createDataFrame([], schema).schema
    paths = [p for p in ([path] if isinstance(path, str) else path) if exists(spark, p)]
    if not paths and required:
        raise MissingInput(f"no such table: {path}")
    out = scans(spark, paths, schema, place, False)
    if out is None:
        out = spark.createDataFrame([], schema)
        out = out.withColumn(place, F.lit(None).cast(ORDINAL)) if place else out
    if required and out.isEmpty():
        raise MissingInput(f"empty table: {path}")
    return out


def read_csv_apart(spark: SparkSession, path: str | list[str], schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): as ``read_csv``, but records with more or fewer cells than their header are set apart.

    rejects: (file, record, n_cells), the file's name, the whole record, and how many cells its header has.
    """
    schema = spark.createDataFrame([], schema).schema
    paths = [p for p in ([path] if isinstance(path, str) else path) if exists(spark, p)]
    found = scans(spark, paths, schema, "_place", True)
    if found is None:
        return spark.createDataFrame([], schema), spark.createDataFrame([], "file string, record string, n_cells int")
    # Spark refuses plans that read the malformed records alone, and its CSV reader takes conditions on them for ones on cells: so this
    # condition also looks at the cells, and is none that a reader takes.
    bad = F.concat(F.coalesce(F.col(MALFORMED), F.lit("")), F.substring(F.concat_ws("", "_cells"), 1, 0)) != ""
    rejects = found.filter(bad).select(F.regexp_extract("_place.file", "([^/]+)$", 1).alias("file"), F.col(MALFORMED).alias("record"), F.size("_cells").alias("n_cells"))
    return found.filter(~bad).select(*schema.names), rejects


def ensure_columns(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """``df`` with every named column; absent ones hold their default."""
    return df.withColumns({c: v if isinstance(v, Column) else F.lit(v) for c, v in defaults.items() if c not in df.columns})


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def with_ordinal(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """A scan with the place of each row in its files, for rules that keep the first or last of equal rows."""
    return df.withColumn(name, ordinal())


def page_key(url: Column) -> Column:
    """The cache's file name of a page: 20 hexadecimal digits of its address."""
    return F.concat(F.substring(F.sha2(url, 256), 1, 20), F.lit(".html"))


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Cached pages: (page, html), the name and whole text of each file."""
    files = spark.read.format("binaryFile").options(pathGlobFilter="*.html", recursiveFileLookup=True).load(folder)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("page"), F.decode("content", "UTF-8").alias("html"))
