"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame.

``docs`` has the columns of documents; all stages but the last return these columns, and any others that ``docs`` has. Of those,
columns named as the results of a stage's operator (lang_pred, lang_score, lang_rejected, leaks, pii_base, pii_spans) hold these
results after it. An empty table gives an empty one. Repeated rows are rows of their own, but where a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.llm import decontaminate, langid, minhash, pii
from parallax.llm.common import ready, table
from parallax.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from rows with a language; rejected documents go, ``lang`` is what was predicted.

    Null and empty texts and texts without a letter are rejected; a null ``lang`` is not learned from. Whole texts count, however long.
    """
    ready(spark)
    model = langid.train(docs.select("doc_id", "text", "lang"))
    found = langid.identify(docs, model).filter(~F.col("lang_rejected"))
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one of the least doc_id; of its repeated rows one.

    Texts without words, null ones among them, are linked with nothing, so all with an id stay.
    """
    ready(spark)
    return minhash.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, at any place of whole texts.

    Null and empty texts hold none and stay; null items are found nowhere. Without a benchmark all stay.
    """
    found = decontaminate.annotate(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("leaks") == 0).select(*docs.columns)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kinds; ``n_chars`` follows. All documents stay.

    Null texts stay null; where nothing is found, text and n_chars are as they were, even where n_chars is null or wrong.
    """
    ready(spark)
    found = pii.find(docs, pii.train(docs))
    some = F.size("pii_spans") > 0
    found = found.withColumn("text", F.when(some, pii.redacted(F.col("text"), F.col("pii_spans"))).otherwise(F.col("text")))
    return found.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences, as ``packing.pack`` gives them; each id of each row lies in one piece.

    A null or empty text is a document of its end alone. Columns other than doc_id and text are not read.
    """
    ready(spark)
    return pack(docs)
