"""Corpus to pretraining examples, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import batching, examples, packing
from textloom.operators.vocabulary import Vocabulary
from textloom.operators.wordpiece import tokenise_units
from textloom.session import write_through
from textloom.sources.corpus import read_corpus
from textloom.sources.sinks import read_examples, write_examples


def tokenised_lines(lines: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``shard, doc_id, lines array<string>`` to token ids per line. Lines without
    tokens add nothing to an example and are dropped."""
    tokens = lines.select("shard", "doc_id", tokenise_units(vocab, F.col("lines")).alias("lines"))
    return tokens.select("shard", "doc_id", F.filter("lines", lambda t: F.size(t) > 0).alias("lines"))


def with_lengths(tokens: DataFrame) -> DataFrame:
    """Tokenised documents with the number of tokens of every line (``lens``): once stored,
    the packing need not read the tokens for them."""
    return tokens.withColumn("lens", F.transform("lines", F.size))


def packed_groups(tokens: DataFrame, config: examples.ExampleConfig, blocks: int | None = None) -> DataFrame:
    """Tokenised documents to groups of lines (``shard, dupe, grp, lines``)."""
    lens = tokens if "lens" in tokens.columns else with_lengths(tokens)
    packed = packing.pack_lines(
        lens, config.max_seq_length, config.short_seq_prob, config.seed, config.dupe_factor, blocks
    )
    return packing.collect_groups(tokens, packed)


def pretraining_examples(
    lines: DataFrame, vocab: Vocabulary, config: examples.ExampleConfig, blocks: int | None = None
) -> DataFrame:
    """The whole job. Tokens are written once and read twice: as lengths for the
    packing, and as tokens for the examples."""
    tokens = write_through(with_lengths(tokenised_lines(lines, vocab)))
    return examples.examples_from_groups(packed_groups(tokens, config, blocks), vocab, config)


def build_examples(
    spark: SparkSession,
    input_dir: str,
    vocab: DataFrame,
    output_dir: str,
    config: examples.ExampleConfig,
    n_files: int = 1000,
) -> int:
    """From corpus files to example files; returns the number of examples."""
    lines = read_corpus(spark, input_dir)
    rows = pretraining_examples(lines, Vocabulary.from_table(vocab), config)
    return write_examples(rows, output_dir, n_files)


def training_batches(
    spark: SparkSession, path: str, config: examples.ExampleConfig, batch_size: int, epoch: int, seed: int = 12345
) -> DataFrame:
    """Examples of an epoch in random order, in full batches: adds ``batch, slot``.
    The key of an example is its content, equal examples being interchangeable."""
    rows = read_examples(spark, path, config.max_seq_length, config.max_predictions_per_seq)
    key = F.xxhash64("input_ids", "segment_ids", "masked_lm_positions", "masked_lm_ids")
    return batching.shuffled_batches(rows, key, batch_size, epoch, seed)
