"""Corpus files: plain text and JSON lines."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import strip_unicode
from textloom.sources.ordinals import numbered, placed

TEXT_SUFFIXES = (".txt",)
JSON_SUFFIXES = (".jsonl", ".jsonl.gz", ".jsonl.zst")


def _ends_with(path: Column, suffixes: tuple[str, ...]) -> Column:
    return reduce(or_, [path.endswith(s) for s in suffixes])


def corpus_files(spark: SparkSession, folder: str) -> DataFrame:
    """All files below a folder with their paths and whether they can be read.
    No file content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    supported = _ends_with(F.col("path"), TEXT_SUFFIXES + JSON_SUFFIXES)
    return files.select("path", "length", supported.alias("supported"))


def skipped_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of other kinds, to be reported."""
    return corpus_files(spark, folder).where("not supported").select("path")


def _lines(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``shard, doc_id, value``: lines with their file and their number in it."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return numbered(placed(reader.text(folder)), "doc_id").withColumnRenamed("file", "shard")


def _text_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of ``*.txt`` that are not blank; a huge file is many rows."""
    rows = _lines(spark, folder, "*.txt").select("shard", "doc_id", strip_unicode(F.col("value")).alias("line"))
    return rows.where("line <> ''")


def _json_documents(spark: SparkSession, folder: str, field: str) -> DataFrame:
    """Documents of JSON-lines files, read line by line through the codec that belongs to
    the suffix (``.zst`` needs the cluster's Hadoop codec). ``field`` holds a text or a
    list of texts; a line may also be the text itself."""
    rows = _lines(spark, folder, "*.jsonl*").where(F.trim("value") != "")
    texts = F.from_json("value", f"`{field}` array<string>")[field]
    text = F.coalesce(F.from_json("value", f"`{field}` string")[field], F.get_json_object("value", "$"))
    return rows.select("shard", "doc_id", F.coalesce(texts, F.array(text)).alias("lines"))


def clean_document_lines(docs: DataFrame) -> DataFrame:
    """Each element of a document is one line: stripped, inner newlines to spaces,
    empty ones dropped."""
    lines = F.transform("lines", lambda x: F.replace(strip_unicode(x), F.lit("\n"), F.lit(" ")))
    return docs.withColumn("lines", F.filter(lines, lambda x: x != ""))


def read_corpus(spark: SparkSession, folder: str, field: str = "text") -> DataFrame:
    """``shard, doc_id, lines`` of all corpus files below a folder. The file is the shard
    and the number of the line ``doc_id``, so nothing follows how files are split for
    reading; blank lines in text files do not separate documents.

    Raises when the folder holds no readable file.
    """
    files = corpus_files(spark, folder)
    found = {kind: not files.where(_ends_with(F.col("path"), kind)).isEmpty() for kind in (TEXT_SUFFIXES, JSON_SUFFIXES)}
    if not any(found.values()):
        raise FileNotFoundError(f"no files ending in {', '.join(TEXT_SUFFIXES + JSON_SUFFIXES)} below {folder}")
    parts = []
    if found[TEXT_SUFFIXES]:
        parts.append(_text_lines(spark, folder).select("shard", "doc_id", F.array("line").alias("lines")))
    if found[JSON_SUFFIXES]:
        parts.append(clean_document_lines(_json_documents(spark, folder, field)).select("shard", "doc_id", "lines"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
