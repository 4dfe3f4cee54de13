"""Line numbers of files that are read in splits, without a sort of the rows.

Two passes: the rows of every split are counted, sums over the earlier splits give the
number at which a split begins, and a row's number is that plus its place in the split.
The numbers follow the files only, whatever size the splits have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import write_through

#: So many splits are sent to all tasks; more are joined.
SPLITS = 100_000


def placed(raw: DataFrame) -> DataFrame:
    """Rows of a file source with their file, split, and a number that rises in reading
    order inside a split. To be taken right after reading: all rows of a split count."""
    split = F.col("_metadata.file_block_start").alias("_split")
    return raw.select("*", F.col("_metadata.file_path").alias("file"), split, F.monotonically_increasing_id().alias("_at"))


def numbered(rows: DataFrame, name: str = "ordinal", over_files: bool = False) -> DataFrame:
    """``name``: the 0-based number of each row of :func:`placed` in its file, or with
    ``over_files`` in all files, ordered by path."""
    counted = rows.groupBy("file", "_split").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    splits = write_through(counted)
    # one row per split
    order = Window.orderBy("file", "_split") if over_files else Window.partitionBy("file").orderBy("_split")
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = splits.select("file", "_split", (before - F.col("_first")).alias("_begin"))
    both = rows.join(F.broadcast(begins) if splits.count() <= SPLITS else begins, ["file", "_split"])
    return both.withColumn(name, F.col("_at") + F.col("_begin")).drop("_split", "_at", "_begin")
