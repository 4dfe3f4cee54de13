"""Question answering data sets. Every reader gives ``context, qas`` with one
explicit schema; a directory stands for all its ``*.json`` files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import qa_features as qa
from textloom.sources.ordinals import numbered, placed

_ANSWERS = "answers: array<struct<text: string, answer_start: int>>"
SQUAD_SCHEMA = (
    "data array<struct<paragraphs: array<struct<context: string, qas: array<struct<"
    f"id: string, question: string, is_impossible: boolean, {_ANSWERS}>>>>>>"
)
GUID_SCHEMA = SQUAD_SCHEMA.replace("id: string", "guid: string", 1)
# the raw HTML fields are not in the schema, so they are never materialised
HTML_SCHEMA = (
    "data array<struct<context: string, qas: array<struct<id: string, question: string, "
    "is_impossible: boolean, answer: struct<text: string, answer_start: int>>>>>"
)
BYTES_SCHEMA = (
    "language string, document_plaintext string, question_text string, annotations array<struct<"
    "minimal_answer: struct<plaintext_start_byte: int, plaintext_end_byte: int>, yes_no_answer: string>>"
)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole files of one JSON value, with ``file``."""
    raw = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)
    return raw.select("*", F.col("_metadata.file_path").alias("file"))


def _json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A record per line, with ``file`` and ``record``, the number of the line over all files."""
    lines = numbered(placed(spark.read.option("pathGlobFilter", "*.json{,l}").text(path)), "record", over_files=True)
    parsed = lines.where(F.trim("value") != "").select(F.from_json("value", schema).alias("v"), "file", "record")
    return parsed.select("v.*", "file", "record")


def _place(*parts) -> Column:
    """Where a paragraph stands: file, then positions from the outside in."""
    names = ("outer", "inner")
    return F.struct(F.col("file").alias("file"), *[p.cast("long").alias(n) for p, n in zip(parts, names, strict=True)]).alias("place")


def _questions(qas: Column, question_id, answers) -> Column:
    return F.transform(
        qas,
        lambda q: F.struct(
            question_id(q).alias("id"),
            q["question"].alias("question"),
            F.coalesce(q["is_impossible"], F.lit(False)).alias("is_impossible"),
            answers(q).alias("answers"),
        ),
    )


def spread_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """A file is one task until here: its records go to all tasks before they are worked on."""
    return rows.repartition(*keys)


def shape_squad(raw: DataFrame, question_id=lambda q: q["id"]) -> DataFrame:
    """``context, qas, place`` from nested ``data`` (and ``file``)."""
    rows = raw.select("file", F.posexplode("data").alias("i", "d"))
    rows = rows.select("file", "i", F.posexplode("d.paragraphs").alias("j", "p"))
    questions = _questions(F.col("p.qas"), question_id, lambda q: q["answers"])
    return spread_rows(rows.select("p.context", questions.alias("qas"), _place(F.col("i"), F.col("j"))), "place")


def of_language(column: Column, language: str) -> Column:
    """Whether a record is in a language, whatever the case and the space around it."""
    return F.lower(F.trim(column)) == language


def read_squad(spark: SparkSession, path: str, is_train: bool, **_) -> DataFrame:
    return shape_squad(_json(spark, path, SQUAD_SCHEMA))


def read_mrc(spark: SparkSession, path: str, is_train: bool, **_) -> DataFrame:
    """As :func:`read_squad`, with ``guid`` as the id."""
    return shape_squad(_json(spark, path, GUID_SCHEMA), lambda q: q["guid"])


def read_html_qa(spark: SparkSession, path: str, is_train: bool, all_questions: bool = False, **_) -> DataFrame:
    """One HTML context per datum with many questions. Training uses the first
    question only unless ``all_questions``; tags are removed, answers move along,
    and contexts with many questions are split."""
    return shape_html(_json(spark, path, HTML_SCHEMA), is_train, all_questions)


def shape_html(raw: DataFrame, is_train: bool, all_questions: bool = False) -> DataFrame:
    rows = raw.select("file", F.posexplode("data").alias("i", "d"))
    questions = _questions(F.col("d.qas"), lambda q: q["id"], lambda q: F.array(q["answer"]))
    if is_train and not all_questions:
        questions = qa.first_question(questions)
    paragraphs = spread_rows(rows.select("d.context", questions.alias("qas"), "file", "i"), "file", "i")
    chunks = qa.question_chunks(qa.strip_html_paragraphs(paragraphs))
    return chunks.select("context", "qas", _place(F.col("i"), F.col("chunk")))


def read_byte_qa(spark: SparkSession, path: str, is_train: bool, language: str = "korean", **_) -> DataFrame:
    """JSON lines with byte offsets: one language, no yes/no questions. The id is a
    digest of the question and its text with the number of its line over all files, so
    it is the same however the files are split for reading."""
    return shape_bytes(_json_lines(spark, path, BYTES_SCHEMA), language)


def shape_bytes(raw: DataFrame, language: str) -> DataFrame:
    rows = raw.where(of_language(F.col("language"), language))
    text = F.col("document_plaintext")
    kept, answers = qa.byte_annotation_answers(text, F.col("annotations"))
    digest = F.md5(F.concat_ws("\u0001", text, F.col("question_text"), F.to_json("annotations")))
    key = F.concat_ws("-", digest, "record")
    rows = rows.where(kept).select(
        text.alias("context"), F.col("question_text").alias("question"), answers.alias("answers"), key.alias("id"),
        _place(F.col("record"), F.lit(0)),
    )
    question = F.struct("id", "question", (F.size("answers") == 0).alias("is_impossible"), "answers")
    return rows.select("context", F.array(question).alias("qas"), "place")
