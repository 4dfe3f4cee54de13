"""Labelled text data sets. Every reader gives ``row_id, text, label``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.labels import stratified_split
from textloom.sources.ordinals import numbered, placed

DIALOGUE_SCHEMA = (
    "talk struct<content: map<string, string>>, profile struct<emotion: struct<type: string>>"
)
SENTIMENT_SCHEMA = (
    "document array<struct<paragraph: array<struct<paragraph_form: string>>, document_score: int>>"
)


def _keyed(raw: DataFrame, text: Column, label: Column) -> DataFrame:
    """``row_id, text, label``: the key is a digest of the content and the row's number over
    all files, so it survives recomputation and equal rows have keys of their own."""
    digest = F.md5(F.concat_ws("\u0001", "text", F.col("label").cast("string")))
    rows = raw.select(text.alias("text"), label.alias("label"), "ordinal")
    return rows.select(F.concat_ws("-", digest, "ordinal").alias("row_id"), "text", "label")


def _split(rows: DataFrame, is_train: bool, seed: int) -> DataFrame:
    """One side of the 80/20 split; the other call gives the complement."""
    wanted = ~F.col("is_test") if is_train else F.col("is_test")
    return stratified_split(rows, "row_id", "label", 0.2, seed).where(wanted).select("row_id", "text", "label")


def read_fake_news(spark: SparkSession, path: str, is_train: bool, seed: int = 42) -> DataFrame:
    """CSV with ``title``, ``content`` and ``Label`` (or ``label``); missing values
    become the text ``nan``. Split 80/20 by label."""
    raw = (
        spark.read.option("header", "true")
        .option("multiLine", "true")
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    label = "Label" if "Label" in raw.columns else "label"
    raw = numbered(placed(raw), over_files=True)
    value = lambda c: F.coalesce(F.col(c), F.lit("nan"))
    text = F.concat(value("title"), F.lit(" "), value("content"))
    return _split(_keyed(raw, text, value(label)), is_train, seed)


def read_dialogue_emotion(spark: SparkSession, path: str, is_train: bool, seed: int = 42) -> DataFrame:
    """JSON list of dialogues: the turns joined in file order, the emotion type as
    the label. Train and validation are separate files, so nothing is split."""
    raw = spark.read.schema(DIALOGUE_SCHEMA).option("multiLine", "true").json(path)
    rows = numbered(placed(raw), over_files=True)
    return _keyed(rows, F.array_join(F.map_values("talk.content"), " "), F.col("profile.emotion.type"))


def read_document_sentiment(spark: SparkSession, path: str, is_train: bool, seed: int = 42) -> DataFrame:
    """JSON with documents of paragraphs: paragraphs joined, the score as the label.
    Split 80/20 by label."""
    raw = spark.read.schema(SENTIMENT_SCHEMA).option("multiLine", "true").json(path)
    files = numbered(placed(raw), "record", over_files=True)
    docs = files.select("record", F.posexplode("document").alias("i", "d"))
    docs = docs.withColumn("ordinal", F.concat_ws("-", "record", "i"))
    rows = _keyed(docs, F.array_join(F.col("d.paragraph.paragraph_form"), " "), F.col("d.document_score"))
    return _split(rows, is_train, seed)


def read_reviews(spark: SparkSession, path: str, is_train: bool, seed: int = 42) -> DataFrame:
    """A Parquet table ``document, label, split`` that is already split."""
    place = F.concat_ws("-", F.col("_metadata.file_name"), F.col("_metadata.row_index")).alias("ordinal")
    raw = spark.read.parquet(path).select("document", "label", "split", place)
    wanted = raw.where(F.col("split") == ("train" if is_train else "test"))
    return _keyed(wanted, F.col("document"), F.col("label"))
