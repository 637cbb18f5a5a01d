"""A training-corpus pipeline over ``documents``; each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parallax.llm import stages
from parallax.llm.common import stored, table

STAGES = [
    ("language_id", stages.language_id),
    ("near_dedup", stages.near_dedup),
    ("decontamination", stages.decontaminated),
    ("pii", stages.without_pii),
    ("packing", stages.packing),
]

#: No SQL form: training, tokenizing and packing are not expressible there.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's result is written to the shared folder and read again, so that none runs twice."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
