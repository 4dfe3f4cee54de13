"""Order-dependent work without one task seeing everything.

A total order is cut into contiguous blocks by range partitioning; the block
number of each row is frozen by writing the table through the shared folder. A
job then runs inside the blocks, and only one row per block (or per key and
block) is needed to stitch the blocks together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import write_through


BUCKET_ROWS = 100_000


def block_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ordered_blocks(df: DataFrame, *order: str | Column, blocks: int | None = None) -> DataFrame:
    """Add ``block``: every row of block *k* sorts before every row of block *k+1*."""
    ranged = df.repartitionByRange(blocks or block_count(df), *order)
    return write_through(ranged.withColumn("block", F.spark_partition_id()))


def block_offsets(blocked: DataFrame, value: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per block (and key) the sum of ``value`` over all earlier blocks."""
    sums = blocked.groupBy(*keys, "block").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_sum").over(earlier), F.lit(0).cast(dict(sums.dtypes)["_sum"]))
    return sums.select(*keys, "block", offset.alias("_offset"))


def numbered(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """Add the 0-based place of each row in a total order."""
    blocked = ordered_blocks(df, *order)
    inside = Window.partitionBy("block").orderBy(*order)
    return (
        blocked.join(F.broadcast(block_offsets(blocked, F.lit(1))), "block")  # one row per block
        .withColumn(name, F.row_number().over(inside) - 1 + F.col("_offset"))
        .drop("block", "_offset")
    )


def running_sum(blocked: DataFrame, value: Column, order: list[Column], name: str) -> DataFrame:
    """Inclusive running sum of ``value`` over the whole order."""
    offsets = block_offsets(blocked, value)
    inside = Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocked.withColumn("_inside", F.sum(value).over(inside))
        .join(F.broadcast(offsets), "block")  # one row per block
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_inside", "_offset")
    )


def hash_rank(df: DataFrame, draw: Column, tie: Column, name: str, buckets: int | None = None) -> DataFrame:
    """0-based rank of each row in the order of a uniform integer ``draw``, and the
    number of rows as ``<name>_total``.

    Uniform draws make equal buckets, so ranks come from a window per bucket plus
    the bucket offsets; ``tie`` makes the order total. By default there is a bucket
    for every ``BUCKET_ROWS`` rows.
    """
    from textloom.functions.draws import MODULUS

    buckets = buckets or max(16, -(-df.count() // BUCKET_ROWS))
    keyed = df.withColumn("_draw", draw).withColumn(
        "_bucket", F.floor(F.col("_draw") * buckets / MODULUS).cast("int")
    )
    counts = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    # at most `buckets` rows
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_bucket",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(F.lit(0))).alias(f"{name}_total"),
    )
    inside = Window.partitionBy("_bucket").orderBy("_draw", tie)
    return (
        keyed.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(name, F.col("_rank") + F.col("_before"))
        .drop("_draw", "_bucket", "_rank", "_before")
    )
