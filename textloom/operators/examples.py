"""Pretraining examples: segments, chunks, masks, fixed-length features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import draws
from textloom.functions.arrays import let, pad_to
from textloom.operators import masking
from textloom.operators.vocabulary import CLS, PAD, SEP, Vocabulary

NO_PAIR_TARGET = 100000
EXAMPLE_KEYS = ["shard", "dupe", "grp", "chunk"]


@dataclass(frozen=True)
class ExampleConfig:
    """Options of the example builder; the defaults are part of the results."""

    max_seq_length: int = 512
    max_predictions_per_seq: int = 76
    sentence_pair_prob: float = 0.05
    short_seq_prob: float = 0.01
    do_whole_word_mask: bool = False
    max_ngram_size: int | None = None
    dupe_factor: int = 2
    masked_lm_prob: float = 0.15
    seed: int = 12345
    long_seq_threshold: float = 1.8

    def __post_init__(self):
        if not self.long_seq_threshold > 1.0:
            raise ValueError("long_seq_threshold must be above 1.0")
        if self.max_ngram_size and not self.do_whole_word_mask:
            raise ValueError("n-gram masking needs whole word masking")


# Production options for long sequences.
LONG_CONFIG = dict(
    max_seq_length=4096,
    max_predictions_per_seq=640,
    sentence_pair_prob=0.0,
    short_seq_prob=0.0,
    do_whole_word_mask=True,
    max_ngram_size=2,
    dupe_factor=3,
)


def first_segment_flags(lens: Column, first_target: Column, coins: Column) -> Column:
    """For each line whether it goes to the first segment.

    It does when the first segment is empty, when it still fits under the target,
    or, while nothing is in the second and the first is under its target, on a
    coin below one half.
    """
    zero = F.struct(
        F.lit(0).alias("a"), F.lit(0).alias("b"), F.array().cast("array<boolean>").alias("flags")
    )

    def step(acc, i):
        size = lens[i]
        first = (
            (acc["a"] == 0)
            | (acc["a"] + size < first_target)
            | ((acc["b"] == 0) & (acc["a"] < first_target) & (coins[i] < 0.5))
        )
        return F.struct(
            F.when(first, acc["a"] + size).otherwise(acc["a"]).alias("a"),
            F.when(first, acc["b"]).otherwise(acc["b"] + size).alias("b"),
            F.array_append(acc["flags"], first).alias("flags"),
        )

    return F.aggregate(F.transform(lens, lambda _, i: i), zero, step)["flags"]


def split_segments(groups: DataFrame, config: ExampleConfig) -> DataFrame:
    """``shard, dupe, grp, lines`` to ``…, first, second`` token arrays.

    ``target`` is the token target of the group when targets are drawn, else
    the maximum length. A group below the segment target is a single segment
    whatever the coins say, which skips the pass over its lines.
    """
    target = F.col("target") if "target" in groups.columns else F.lit(config.max_seq_length)
    keys = [F.col("shard"), F.col("dupe"), F.col("grp")]
    pair = draws.uniform(config.seed, "pair", *keys) < config.sentence_pair_prob
    first_target = F.when(pair, F.floor((target - 3) / 2).cast("int")).otherwise(NO_PAIR_TARGET)
    none = F.array().cast("array<int>")

    def flags(lens: Column, limit: Column) -> Column:
        coins = F.transform(
            draws.mix(draws.seed(config.seed, "coin", *keys), F.transform(lens, lambda _, i: i)), draws.to_unit
        )
        return let(coins, lambda c: first_segment_flags(lens, limit, c))

    def split(lens: Column, limit: Column) -> Column:
        pick = lambda fs, wanted: F.flatten(F.filter("lines", lambda _, i: fs[i] == wanted))
        return let(
            flags(lens, limit), lambda fs: F.struct(pick(fs, True).alias("first"), pick(fs, False).alias("second"))
        )

    def segments(limit: Column, lens: Column) -> Column:
        total = F.aggregate(lens, F.lit(0), lambda a, x: a + x)
        whole = F.struct(F.flatten("lines").alias("first"), none.alias("second"))
        return F.when(total < limit, whole).otherwise(split(lens, limit))

    lens = F.transform("lines", F.size)
    both = let(first_target, lambda limit: let(lens, lambda ls: segments(limit, ls)))
    return groups.select(*keys, both.alias("s")).select("shard", "dupe", "grp", "s.first", "s.second")


def chunk_segments(segments: DataFrame, config: ExampleConfig) -> DataFrame:
    """Very long examples are cut into single-segment chunks; others are trimmed,
    and what does not fit is dropped."""
    length, room = config.max_seq_length, config.max_seq_length - 2
    limit = int(length * config.long_seq_threshold)
    total = F.size("first") + F.size("second")
    none = F.array().cast("array<int>")
    chunks = let(
        F.concat("first", "second"),
        lambda both: F.transform(
            F.sequence(F.lit(0), total - 1, F.lit(room)),
            lambda i, k: F.struct(k.alias("chunk"), F.slice(both, i + 1, room).alias("first"), none.alias("second")),
        ),
    )
    first = F.slice("first", 1, room)
    second = F.slice("second", F.lit(1), F.greatest(F.lit(0), length - F.least(F.size("first"), F.lit(room)) - 3))
    single = F.array(F.struct(F.lit(0).alias("chunk"), first.alias("first"), second.alias("second")))
    pieces = F.explode(F.when(total >= limit, chunks).otherwise(single)).alias("p")
    return segments.where(total > 0).select("shard", "dupe", "grp", pieces).select("shard", "dupe", "grp", "p.*")


def frame_segments(chunks: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Add classifier and separator tokens: ``ids`` and ``segment_ids``, not padded."""
    cls, sep = F.array(vocab.id(CLS)), F.array(vocab.id(SEP))
    none = F.array().cast("array<int>")
    tail = F.when(F.size("second") > 0, F.concat("second", sep)).otherwise(none)
    ids = F.concat(cls, F.col("first"), sep, tail)
    first_len = F.size("first") + 2
    segment = F.concat(
        F.array_repeat(F.lit(0), first_len),
        F.array_repeat(F.lit(1), F.when(F.size("second") > 0, F.size("second") + 1).otherwise(0)),
    )
    return chunks.select(*EXAMPLE_KEYS, ids.alias("ids"), segment.alias("segments"))


def replicate(rows: DataFrame, copies: int) -> DataFrame:
    """``copies`` of every row, told apart by ``dupe``."""
    if copies == 1:
        return rows
    others = [c for c in rows.columns if c != "dupe"]
    return rows.select(F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("dupe"), *others)


def find_words(framed: DataFrame, vocab: Vocabulary, config: ExampleConfig) -> DataFrame:
    """Add ``words`` (maskable spans) and the masking ``budget``."""
    find = masking.find_spans(np.array(vocab.kind_list(config.do_whole_word_mask), dtype=np.int8))
    budget = masking.mask_budget(F.size("ids"), config.masked_lm_prob, config.max_predictions_per_seq)
    return framed.withColumn("words", find(F.col("ids"))).withColumn("budget", budget)


def choose_masks(rows: DataFrame, vocab: Vocabulary, config: ExampleConfig) -> DataFrame:
    """Add ``spans`` (what is masked) and ``masked`` (position, label, new id); one
    seed per example drives all draws."""
    keys = [F.col(k) for k in EXAMPLE_KEYS]
    rows = rows.withColumn("select_seed", draws.seed(config.seed, "select", *keys))
    rows = rows.withColumn("corrupt_seed", draws.seed(config.seed, "corrupt", *keys))
    spans = masking.select_spans(config.max_ngram_size)(
        F.col("words.b"), F.col("words.e"), F.col("budget"), F.col("select_seed")
    )
    rows = rows.withColumn("spans", spans)
    masked = masking.corrupt_spans(F.col("ids"), F.col("spans"), vocab, F.col("corrupt_seed"))
    return rows.withColumn("masked", masked).drop("select_seed", "corrupt_seed", "words")


def fixed_features(masked: DataFrame, vocab: Vocabulary, config: ExampleConfig) -> DataFrame:
    """The six fixed-length features of an example."""
    length, predictions = config.max_seq_length, config.max_predictions_per_seq
    pad = vocab.id(PAD).cast("bigint")
    long = lambda c: c.cast("array<bigint>")
    one = F.transform("masked", lambda _: F.lit(1.0).cast("float"))
    return masked.select(
        *EXAMPLE_KEYS,
        pad_to(long(masking.apply_corruption(F.col("ids"), F.col("masked"))), length, pad).alias("input_ids"),
        pad_to(long(F.col("segments")), length, F.lit(0).cast("bigint")).alias("segment_ids"),
        pad_to(long(F.col("masked.pos")), predictions, F.lit(0).cast("bigint")).alias("masked_lm_positions"),
        pad_to(long(F.col("masked.label")), predictions, pad).alias("masked_lm_ids"),
        pad_to(one, predictions, F.lit(0.0).cast("float")).alias("masked_lm_weights"),
        F.array(F.lit(0).cast("bigint")).alias("next_sentence_labels"),
    )


def masked_examples(groups: DataFrame, vocab: Vocabulary, config: ExampleConfig) -> DataFrame:
    """Packed groups to framed examples with their masks.

    Duplicates share everything that is not drawn, so rows are replicated after
    the last shared step: already packed apart with short targets, before the
    segments with pairs, else only before the masks are drawn.
    """
    copies = 1 if config.short_seq_prob > 0 else config.dupe_factor
    early = copies if config.sentence_pair_prob > 0 else 1
    groups = replicate(groups, early)
    framed = frame_segments(chunk_segments(split_segments(groups, config), config), vocab)
    words = replicate(find_words(framed, vocab, config), copies // early)
    return choose_masks(words, vocab, config)


def examples_from_groups(groups: DataFrame, vocab: Vocabulary, config: ExampleConfig) -> DataFrame:
    """Packed groups of tokenised lines to fixed-length masked examples."""
    return fixed_features(masked_examples(groups, vocab, config), vocab, config)
