"""Labels: dense ids, encoding, stratified split, classification features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import draws
from textloom.functions.arrays import let, pad_to
from textloom.operators.ordering import numbered
from textloom.operators.vocabulary import CLS, PAD, SEP, Vocabulary
from textloom.operators.wordpiece import tokenise_text
from textloom.session import write_through

SPLIT_BUCKETS = 4096


def label_map(df: DataFrame, label: str = "label") -> DataFrame:
    """``(label, id)``: the distinct labels in sorted order, numbered from 0. Strings
    sort as strings, numbers as numbers."""
    labels = df.select(F.col(label).alias("label")).where(F.col("label").isNotNull()).distinct()
    return numbered(labels, F.col("label"), name="id").select("label", F.col("id").cast("int").alias("id"))


def encode_labels(df: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """Replace ``label`` by its id. A label the map does not know is an error."""
    mapped = df.withColumnRenamed(label, "_label").join(
        labels.withColumnRenamed("id", "_id"), F.col("_label") == F.col("label"), "left"
    )
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), F.col("_label").cast("string"))).cast("int")
    return mapped.withColumn("_id", F.coalesce("_id", unknown)).drop("label", "_label").withColumnRenamed("_id", label)


def test_counts(sizes: DataFrame, label: str, test_share: float) -> DataFrame:
    """Test rows per label, ``ceil(share * n)`` in total, by largest remainder; ``sizes``
    has ``n`` rows for each label."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    n_test = math.ceil(total * test_share)
    share = F.col("n") * n_test / max(total, 1)
    shares = sizes.select(
        label, "n", F.floor(share).alias("base"), F.round(share - F.floor(share), 9).alias("rest")
    )
    placed = numbered(shares, F.desc("rest"), F.col(label), name="place")
    missing = n_test - (placed.agg(F.sum("base")).first()[0] or 0)
    extra = F.when(F.col("place") < missing, 1).otherwise(0)
    return placed.select(label, "n", (F.col("base") + extra).cast("bigint").alias("n_test"))


def stratified_split(
    df: DataFrame, key: str, label: str = "label", test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``is_test``: per label an exact number of rows, the smallest keyed draws.

    A label may hold most of the table, so its rows are never ranked together:
    a histogram of the draws finds the bucket in which the label's quota ends,
    only that bucket is ranked, and its last test row gives a cut that every row
    is compared with. Rows without a label stay in training.

    What has one row per label is a table, joined as its size allows.
    """
    draw = draws.seed(seed, "split", F.col(key))
    bucket = F.floor(F.col("draw") * SPLIT_BUCKETS / draws.MODULUS).cast("int").alias("bucket")
    drawn = df.where(F.col(label).isNotNull()).select(label, key, draw.alias("draw"))
    keyed = write_through(drawn.select("*", bucket))
    counts = write_through(keyed.groupBy(label, "bucket").agg(F.count("*").alias("m")))
    quotas = test_counts(counts.groupBy(label).agg(F.sum("m").alias("n")), label, test_share)
    # at most SPLIT_BUCKETS rows per label
    upto = Window.partitionBy(label).orderBy("bucket")
    hist = counts.withColumn("upto", F.sum("m").over(upto)).join(quotas, label)
    ends = hist.where((F.col("upto") >= F.col("n_test")) & (F.col("upto") - F.col("m") < F.col("n_test"))).select(
        label, "bucket", (F.col("n_test") - F.col("upto") + F.col("m")).alias("need")
    )
    last = Window.partitionBy(label, "bucket").orderBy("draw", key)
    cuts = write_through(
        keyed.join(write_through(ends), [label, "bucket"])
        .withColumn("rank", F.row_number().over(last))
        .where(F.col("rank") == F.col("need"))
        .select(label, F.struct("draw", key).alias("cut"))
    )
    below = F.struct(draw.alias("draw"), F.col(key)) <= F.col("cut")
    return df.join(cuts, label, "left").withColumn("is_test", F.coalesce(below, F.lit(False))).drop("cut")


def classification_features(
    df: DataFrame, vocab: Vocabulary, max_length: int, text: Column, label: Column, keys: list[str]
) -> DataFrame:
    """``input_ids, attention_mask, labels`` of fixed length: framed, cut, padded."""
    pieces = F.slice(tokenise_text(vocab, text), 1, max_length - 2)
    ids = F.concat(F.array(vocab.id(CLS)), pieces, F.array(vocab.id(SEP)))
    both = let(
        ids,
        lambda xs: F.struct(
            pad_to(xs, max_length, vocab.id(PAD)).alias("input_ids"),
            pad_to(F.transform(xs, lambda _: F.lit(1)), max_length, F.lit(0)).alias("attention_mask"),
        ),
    )
    rows = df.select(*keys, both.alias("f"), label.alias("labels"))
    return rows.select(*keys, "f.input_ids", "f.attention_mask", "labels")
