"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a row's hash. A bucket whose rows
hold more bytes than the limit is split on one more bit, and only such a bucket;
the leaves are the shards. DataFrame functions only.

Sizes are first summed per *cell*, a prefix a few bits longer than needed on
average, so that the splitting itself works on a few rows per shard. Cells that are
still too large are cut into longer prefixes, each from its own rows only.

Defined results: a null size counts 0 bytes; a null key is hashed like the empty
string; an empty table gives no shard. A bucket whose rows all have one hash cannot
split: a single row above the limit is a shard of its own, and repeated keys are
dealt into pages of at most the limit (``page``, 0 elsewhere).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.tables import free_name, saved

HASH_BITS = 60
SPARE_BITS = 3
STEP_BITS = 6


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key's text, as a long."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def leading(value: Column, depth: Column, bits: int = HASH_BITS) -> Column:
    """The first ``depth`` of the ``bits`` bits of ``value``."""
    return F.call_function("shiftright", value, (F.lit(bits) - depth).cast("int"))


def _cells(rows: DataFrame, depth: int) -> DataFrame:
    """Bytes per prefix of ``depth`` bits."""
    cell = leading(F.col("_hash"), F.lit(depth)).alias("prefix")
    return rows.groupBy(F.lit(depth).alias("depth"), cell).agg(
        F.sum("_bytes").alias("bytes"), F.min("_hash").alias("low"), F.max("_hash").alias("high")
    )


def _fine_cells(rows: DataFrame, limit: int) -> DataFrame:
    """Cells that fit the limit or hold one hash only, and cover all rows."""
    total = rows.agg(F.sum("_bytes").alias("n")).first()["n"] or 0
    depth = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE_BITS)
    cells = saved(_cells(rows, depth))
    large = (F.col("bytes") > limit) & (F.col("low") < F.col("high"))
    done = cells.where(~large)
    while depth < HASH_BITS and not (split := cells.where(large).select("prefix")).isEmpty():
        inside = rows.withColumn("prefix", leading(F.col("_hash"), F.lit(depth)))
        rows = inside.join(split, "prefix", "left_semi").drop("prefix")
        depth = min(HASH_BITS, depth + STEP_BITS)
        cells = saved(_cells(rows, depth))
        done = done.unionByName(cells.where(~large))
    return done


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """Every cell with its bytes and the leaf it lies in (``depth``, ``prefix``).

    A prefix is split when its bytes exceed the limit and it holds two hashes; the
    leaf of a cell lies one bit below its deepest split prefix.
    """
    cells = saved(_fine_cells(rows, limit))
    ancestors = cells.select(
        "depth", "prefix", "bytes", "low", "high", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("level")
    ).withColumn("above", leading(F.col("low"), F.col("level")))
    sums = ancestors.groupBy("level", "above").agg(
        F.sum("bytes").alias("_sum"), F.min("low").alias("_low"), F.max("high").alias("_high")
    )
    split = sums.where((F.col("_sum") > limit) & (F.col("_low") < F.col("_high"))).select("level", "above")
    deepest = (
        ancestors.join(split, ["level", "above"])
        .groupBy(F.col("depth").alias("cell_depth"), F.col("prefix").alias("cell_prefix"))
        .agg(F.max("level").alias("_deepest"))
    )
    placed = cells.select(F.col("depth").alias("cell_depth"), F.col("prefix").alias("cell_prefix"), "bytes", "low").join(
        deepest, ["cell_depth", "cell_prefix"], "left"
    )
    leaf = placed.withColumn("depth", F.coalesce(F.col("_deepest") + 1, F.lit(0)))
    return leaf.select(
        "cell_depth",
        "cell_prefix",
        "bytes",
        "depth",
        leading(F.col("low"), F.col("depth")).alias("prefix"),
    )


def assign_shards(df: DataFrame, key: str, size: Column, limit: int) -> DataFrame:
    """Each row's ``key`` with ``bytes``, ``shard`` (the bits of its prefix as text,
    empty for the only shard), ``page`` and ``shard_bytes``, the bytes of that page."""
    rows = df.select(
        F.col(key),
        F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("_bytes"),
        hash_bits(F.col(key)).alias("_hash"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = saved(rows)
    cells = saved(directory(rows, limit))
    leaves = cells.groupBy("depth", "prefix").agg(F.sum("bytes").alias("leaf_bytes"))
    base = cells.agg(F.min("cell_depth").alias("d")).first()["d"] or 0
    # below a base cell lie one leaf or, where it was cut again, a few depths of leaves
    found = (
        cells.select(
            F.call_function("shiftright", F.col("cell_prefix"), F.col("cell_depth") - base).alias("_base"), F.col("depth").alias("_depth")
        )
        .distinct()
    )
    placed = (
        rows.withColumn("_base", leading(F.col("_hash"), F.lit(base)))
        .join(found, "_base")
        .withColumn("_prefix", leading(F.col("_hash"), F.col("_depth")))
        .join(leaves, (F.col("_depth") == F.col("depth")) & (F.col("_prefix") == F.col("prefix")))
    )
    shard = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    placed = placed.select(key, "_bytes", "_row", "leaf_bytes", shard.alias("shard"))
    fits = placed.where(F.col("leaf_bytes") <= limit)
    over = _pages(placed.where(F.col("leaf_bytes") > limit), limit)
    return fits.select(
        key, F.col("_bytes").alias("bytes"), "shard", F.lit(0).cast("long").alias("page"), F.col("leaf_bytes").alias("shard_bytes")
    ).unionByName(over.select(key, F.col("_bytes").alias("bytes"), "shard", "page", "shard_bytes"))


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of one hash, dealt by their ordinal into groups of about the limit and
    inside a group cut every half limit; a row above half the limit is a page."""
    dealt = rows.withColumn(
        "_group", F.pmod(F.xxhash64("_row"), F.ceil(F.col("leaf_bytes") / limit).cast("long"))
    ).withColumn("_large", F.col("_bytes") * 2 > limit)
    inside = Window.partitionBy("shard", "_group", "_large").orderBy("_row")
    running = F.sum("_bytes").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    cut = F.when(F.col("_large"), F.row_number().over(inside).cast("long")).otherwise(
        F.floor((F.greatest(running, F.lit(1)) - 1) * 2 / limit)
    )
    cut = dealt.withColumn("_cut", cut)
    pages = cut.groupBy("shard", "_group", "_large", "_cut").agg(F.sum("_bytes").alias("shard_bytes"))
    return cut.join(pages, ["shard", "_group", "_large", "_cut"]).withColumn(
        "page", F.abs(F.xxhash64("_group", "_large", "_cut"))
    )


def write_shards(df: DataFrame, assigned: DataFrame, key: str, path: str) -> None:
    """``df`` (unique keys) as one Parquet folder per shard: ``shard=…/page=…``, with an
    underscore more where ``df`` has columns of these names."""
    shard, page = (free_name(name, df.columns) for name in ("shard", "page"))
    places = assigned.select(key, F.col("shard").alias(shard), F.col("page").alias(page))
    df.join(places, key).repartition(shard, page).write.partitionBy(shard, page).parquet(path)
