"""The training-data pipeline over ``documents``: five stages, each by one operator.

Every stage gets all rows that the one before it kept and returns the columns it was given; the
last returns packed pieces. ``run`` writes each stage's rows to the shared folder and reads them
again, so a lost executor costs at most one stage's tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsieve.llm import exact, language, leaks, near, packing, queries
from callsieve.session import materialise

#: Rows whose best language is less likely than this are rejected, as are those without letters.
LEAST_SCORE = 0.5


def _fresh() -> str:
    """A column name that no table has."""
    return f"key_{uuid.uuid4().hex}"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in one of the learned languages."""
    return language.recognised(docs, queries.language_model(docs), LEAST_SCORE)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, also if rows with the same id are repeated."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    mine, theirs = _fresh(), _fresh()
    kept = exact.exact_groups(docs).filter("kept").select(F.concat(name, F.lit(":"), "text_sha256").alias(theirs))
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "")
    keyed = docs.withColumn(mine, F.concat(name, F.lit(":"), F.sha2(norm, 256)))
    rows = keyed.join(kept.distinct(), F.col(mine) == F.col(theirs), "left_semi")
    return rows.dropDuplicates([mine]).drop(mine)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies. Rows with equal ids are one document."""
    theirs = _fresh()
    kept = near.near_groups(docs).filter("kept").select(F.col("doc_id").alias(theirs)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(theirs)), "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share no window with the benchmark."""
    return leaks.without_leaks(docs, queries.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, packed into training sequences."""
    return packing.pack(docs, queries.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: SQL can express neither the language model nor the packing.
ORACLE_SQL = None
