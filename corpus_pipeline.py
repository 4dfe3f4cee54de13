"""The pipeline from documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)``, calls one of the operators, and hands on the
documents it keeps; the last one returns the packed sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import best_fit, contextual_pii, language, near_copies, substrings
from textloom.llm.tables import own_column, whole_row, word_count
from textloom.session import shared_folder, ship_package

LEAST_SCORE = 0.4


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be told; the code is learned from all rows.

    A document is rejected if it has no letter, or if even the nearest language is
    about as likely as not. A missing ``lang`` is filled in."""
    ship_package(spark)
    model = language.train(docs, "text", "lang")
    named = docs.select(whole_row(docs), language.told(F.col("text"), model).alias("told"))
    kept = named.where((F.col("told.lang_pred") != language.UNDETERMINED) & (F.col("told.score") >= LEAST_SCORE))
    lang = F.coalesce("row.lang", "told.lang_pred").alias("lang")
    return kept.select(*[lang if c == "lang" else own_column(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies."""
    ship_package(spark)
    return near_copies.deduplicate(docs, "doc_id", "text")


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has; what is left empty goes."""
    ship_package(spark)
    kept = substrings.remove_repeats(docs, "doc_id", "text", with_text=True, with_row=True)
    left = kept.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    own = {"doc_id": F.col("key").alias("doc_id"), "text": F.col("text")}
    return counted(left.select(*[own.get(c, own_column(c)) for c in docs.columns]), docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind."""
    ship_package(spark)
    return counted(contextual_pii.masked(docs, "doc_id", "text"), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences: documents and their words in order."""
    ship_package(spark)
    placed = best_fit.pack(docs, "doc_id", word_count(F.col("text")))
    return best_fit.sequences(docs, placed, "doc_id", "text")


def counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``n_chars`` follows the text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*[F.col(f"`{c}`") for c in columns])


STAGES = [
    ("language", identify),
    ("near_copies", drop_near_copies),
    ("substrings", drop_repeats),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: Not SQL: learned codes, automata and best-fit packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
