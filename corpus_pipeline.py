"""A cleaning pipeline over ``documents``: quality, exact copies, near copies, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparstrata.llm import exact_dedup, near_dedup, packing, quality, suffix_dedup
from sparstrata.llm.common import saved
from sparstrata.llm.queries import BYTE_BPE


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; those without text, or of a language without trusted text, stay.

    Null ids are never trusted. Repeated rows are judged alike. An empty table gives none.
    """
    return quality.drop_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id, null text being empty and a null id the smallest; one of repeated rows.

    An empty table gives no rows.
    """
    return exact_dedup.drop_exact_copies(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest id, a null id first; texts without words are one class.

    Rows that repeat id and text stay or go alike. An empty table gives none.
    """
    return near_dedup.drop_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of repeated passages; a character that is cut in two goes whole.

    All rows stay, those that are covered as a whole with an empty text, and
    untouched ones as they are, null text too. An empty table gives no rows.
    """
    found = suffix_dedup.remove_repeats(docs, carry=True)
    text = F.when(F.size("removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    columns = {c: F.col("row").getField(c) for c in docs.columns} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return found.select(*[column.alias(c) for c, column in columns.items()])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences; null text is a piece of the end id alone. An empty table gives no rows."""
    return packing.pack_documents(docs, BYTE_BPE)


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

#: Training, components and packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
