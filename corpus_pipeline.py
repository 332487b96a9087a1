"""The documents table through quality rules, language, near duplicates, benchmark passages and encoding.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a DataFrame that
is written as Parquet and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from mirrortab.llm import byte_bpe, decontaminate, language, near_dup, quality
from mirrortab.llm.scratch import saved, ship

#: Below this lead over the next language a text counts as being in none.
LEAST_LEAD = 0.02


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that pass the quality rules, without the lines that stand all over their source; n_chars follows the text."""
    ship(spark)
    kept = quality.cleaned(docs, "doc_id", "text", "source")
    return kept.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language: not ``und``, and not torn between two."""
    ship(spark)
    # Names that no column has, whatever else the table holds.
    free = "_" * (1 + max(len(c) for c in docs.columns))
    judged = language.predict(docs, "text", language.learn(docs), prediction=f"{free}language", score=f"{free}lead")
    sure = (F.col(f"{free}language") != language.UNKNOWN) & (F.col(f"{free}lead") >= LEAST_LEAD)
    return judged.where(sure).select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text per group of near duplicates, that of the smallest doc_id."""
    ship(spark)
    return near_dup.one_per_group(docs, "doc_id", "text")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are not contaminated by passages of the benchmark."""
    ship(spark)
    return decontaminate.clean_rows(docs, "doc_id", "text", spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the number of ids and the digests of ids and of decoded bytes."""
    ship(spark)
    return byte_bpe.round_trip(docs, ["doc_id"], "text", public_tokenizers.path(byte_bpe.VOCABULARY))


STAGES = [("quality", of_quality), ("language", in_a_language), ("near_dup", one_of_each), ("decontaminate", decontaminated), ("byte_bpe", encoded)]
#: Language scores and token ids are beyond SQL; the tests check the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
