"""Loading the given tables, and a registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import clean_lines
from textloom.operators.vocabulary import Vocabulary, build_vocabulary
from textloom.session import REPARTITION, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCAB_WORDS, VOCAB_CHARS = 1500, 60


def query(name: str, sql: str | None = None):
    """Register a query and, where one exists, the SQL that must agree with it."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def given(df: DataFrame, key: str) -> DataFrame:
    """A table as its scan gives it, or dealt out by ``key`` where the session asks for
    that: files of one row group are one task however many cores there are."""
    parts = df.sparkSession.conf.get(REPARTITION, None)
    return df.repartition(int(parts), key) if parts else df


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return given(load(spark, sf_dir, "documents", *columns), "doc_id")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a corpus: the source is the shard, lines are stripped and non-empty."""
    return documents(spark, sf_dir, "doc_id", "source", "text").select(
        F.col("source").alias("shard"), "doc_id", clean_lines(F.col("text")).alias("lines")
    )


_vocabularies: dict[tuple[str, str], Vocabulary] = {}


def vocabulary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_vocabulary(documents(spark, sf_dir, "doc_id", "text"), F.col("text"), VOCAB_WORDS, VOCAB_CHARS)


def vocabulary(spark: SparkSession, sf_dir: str) -> Vocabulary:
    """The vocabulary of a data folder, built once per application: to the jobs it
    is an input, like a vocabulary file."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _vocabularies:
        _vocabularies[key] = Vocabulary.from_table(vocabulary_table(spark, sf_dir))
    return _vocabularies[key]
