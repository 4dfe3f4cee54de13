"""The vocabulary: a table ``(token, id)`` whose size is checked before use."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrays import literal_array
from textloom.functions.text import characters
from textloom.session import write_through

# The special tokens.
SPECIAL_TOKENS = {
    "bos_token": "<s>",
    "eos_token": "</s>",
    "unk_token": "[UNK]",
    "sep_token": "[SEP]",
    "pad_token": "[PAD]",
    "cls_token": "[CLS]",
    "mask_token": "[MASK]",
}
PAD, UNK, CLS, SEP, MASK = "[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"
UNUSED_PATTERN = "^\\[unused.*\\]$"

SPECIAL_KIND, WORD_KIND, SUFFIX_KIND = 0, 1, 2


def replacement_vocabulary(vocab: DataFrame) -> DataFrame:
    """Tokens a masked position may be replaced with: everything but the unused
    placeholders. Special tokens stay in, and are added when missing."""
    specials = vocab.sparkSession.createDataFrame([(t,) for t in SPECIAL_TOKENS.values()], "token string")
    kept = vocab.select("token").where(~F.col("token").rlike(UNUSED_PATTERN))
    return kept.unionByName(specials).distinct()


def build_vocabulary(docs: DataFrame, text: Column, n_words: int, n_chars: int) -> DataFrame:
    """A vocabulary from a corpus, for when none is supplied: special tokens,
    ten unused slots, the most frequent words and characters.

    Counts are combined before the shuffle, punctuation is split off distinct
    words only, and only the top entries leave the last aggregation.
    """
    from textloom.operators.wordpiece import basic_tokens, whitespace_words

    spark = docs.sparkSession
    raw = docs.select(F.explode(whitespace_words(text)).alias("raw")).groupBy("raw").agg(F.count("*").alias("m"))
    entries = F.transform(
        basic_tokens(F.col("raw")),
        lambda w: F.concat(
            F.array(F.struct(F.lit(True).alias("is_word"), w.alias("token"))),
            F.transform(characters(w), lambda c: F.struct(F.lit(False).alias("is_word"), c.alias("token"))),
        ),
    )
    counted = write_through(
        raw.select(F.explode(F.flatten(entries)).alias("e"), "m")
        .groupBy("e.is_word", "e.token")
        .agg(F.sum("m").alias("n"))
    )
    ranked = counted.orderBy(F.desc("n"), "token")
    top = ranked.where("is_word").limit(n_words).select("token")
    chars = (
        ranked.where("not is_word")
        .limit(n_chars)
        .select(F.explode(F.array("token", F.concat(F.lit("##"), "token"))).alias("token"))
    )
    fixed = list(_FIXED_HEAD)
    head = spark.createDataFrame([(t, i) for i, t in enumerate(fixed)], "token string, id int")
    # at most n_words + 2 * n_chars tokens, so one ordered array is fine
    ordered = top.unionByName(chars).agg(
        F.array_sort(F.array_except(F.collect_set("token"), F.array(*[F.lit(t) for t in fixed]))).alias("tokens")
    )
    body = ordered.select(F.posexplode("tokens").alias("i", "token")).select(
        "token", (F.col("i") + len(fixed)).cast("int").alias("id")
    )
    return head.unionByName(body)


# Ids 0.. of a vocabulary built here.
_FIXED_HEAD = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "<s>", "</s>"] + [f"[unused{i}]" for i in range(10)]


@dataclass
class Vocabulary:
    """A size-checked vocabulary, held as plain lists so that expressions can
    carry it as constant arrays and Arrow functions as a dictionary."""

    tokens: list[str]
    ids: dict[str, int] = field(repr=False)

    MAX_SIZE = 2_000_000

    @classmethod
    def from_table(cls, vocab: DataFrame) -> Vocabulary:
        """Read ``(token, id)``; ids must be 0..n-1. Refuses tables over MAX_SIZE."""
        rows = vocab.select("token", "id").limit(cls.MAX_SIZE + 1).collect()
        if len(rows) > cls.MAX_SIZE:
            raise ValueError(f"a vocabulary may have at most {cls.MAX_SIZE} tokens")
        by_id = sorted((r["id"], r["token"]) for r in rows)
        if [i for i, _ in by_id] != list(range(len(by_id))):
            raise ValueError("vocabulary ids must be 0..n-1 without gaps")
        tokens = [t for _, t in by_id]
        ids = {t: i for i, t in enumerate(tokens)}
        missing = [t for t in SPECIAL_TOKENS.values() if t not in ids]
        if missing:
            raise ValueError(f"special tokens missing from the vocabulary: {missing}")
        return cls(tokens, ids)

    def id(self, token: str) -> Column:
        return F.lit(self.ids[token])

    def kind_list(self, whole_words: bool = True) -> list[int]:
        """Kind of each id: special, word start, or suffix. Without whole words every
        ordinary token counts as a word start."""
        special = set(SPECIAL_TOKENS.values())
        return [
            SPECIAL_KIND if t in special else SUFFIX_KIND if whole_words and t.startswith("##") else WORD_KIND
            for t in self.tokens
        ]

    def kinds(self, whole_words: bool = True) -> Column:
        """:meth:`kind_list` as a constant array."""
        return literal_array(self.kind_list(whole_words))

    def replacement_ids(self) -> list[int]:
        """Ids a masked position may be replaced with."""
        return [i for i, t in enumerate(self.tokens) if not (t.startswith("[unused") and t.endswith("]"))]

    def replacements(self) -> tuple[Column, int]:
        """:meth:`replacement_ids` as a constant array, and how many there are."""
        ids = self.replacement_ids()
        return literal_array(ids), len(ids)

    def decode(self, ids: Column) -> Column:
        """Ids to token strings through a constant array."""
        table = F.split(F.lit("\n".join(self.tokens)), "\n")
        return F.transform(ids, lambda i: table[i])
