"""Training order, batches, and padding of evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import draws
from textloom.operators.ordering import hash_rank


def shuffled_batches(
    df: DataFrame, key: Column, batch_size: int, epoch: int, seed: int = 12345, drop_last: bool = True
) -> DataFrame:
    """A random order of the whole table for an epoch, cut into batches: adds
    ``batch`` and ``slot``. The incomplete last batch is dropped on request.

    A global shuffle per epoch, where a bounded shuffle buffer only mixes
    neighbours.
    """
    ranked = hash_rank(df, draws.seed(seed, "shuffle", epoch, key), key, "_position")
    rows = ranked.withColumn("batch", F.floor(F.col("_position") / batch_size)).withColumn(
        "slot", (F.col("_position") % batch_size).cast("int")
    )
    if drop_last:
        rows = rows.where(F.col("batch") < F.floor(F.col("_position_total") / batch_size))
    return rows.drop("_position", "_position_total")


def collate(batched: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row per batch: each column as an array in slot order, cast to the given
    element type. A batch has a fixed number of rows."""
    fields = [F.col(c).cast(t).alias(c) for c, t in columns.items()]
    rows = batched.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("slot", *fields))).alias("rows"))
    return rows.select("batch", *[F.col(f"rows.{c}").alias(c) for c in columns])


CLS_COLUMNS = {"input_ids": "array<bigint>", "attention_mask": "array<tinyint>", "labels": "bigint"}
QA_COLUMNS = {
    "input_ids": "array<bigint>",
    "attention_mask": "array<tinyint>",
    "token_type_ids": "array<tinyint>",
    "start_position": "bigint",
    "end_position": "bigint",
}


def pad_for_devices(df: DataFrame, order: str, batch_size: int, devices: int) -> DataFrame:
    """Extend an evaluation set to a multiple of ``batch_size * devices``.

    A full extra chunk is added when the size already is a multiple. Padding
    repeats the first row; a set smaller than one batch is padded with null rows.
    ``is_pad`` marks padding so that scoring can leave it out.
    """
    chunk = batch_size * devices
    names = df.columns
    head = df.agg(F.count("*").alias("n"), F.min_by(F.struct(*names), order).alias("first")).where("n > 0")
    times = (F.lit(chunk) - F.col("n") % chunk).cast("int")
    first = F.when(F.col("n") >= batch_size, F.col("first"))
    padding = head.select(F.explode(F.array_repeat(F.struct(first.alias("row")), times)).alias("p"))
    padding = padding.select(*[F.col(f"p.row.{c}").alias(c) for c in names], F.lit(True).alias("is_pad"))
    return df.withColumn("is_pad", F.lit(False)).unionByName(padding)
