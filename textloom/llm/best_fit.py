"""Best-fit packing into sequences of several permitted lengths.

Documents are cut into pieces of at most the longest length; pieces are placed in
decreasing order, each into the open bin with the least room that holds it. Where
none does, bins of the size with the least cost per token are opened, and in the end
every bin shrinks to the shortest permitted length that holds its contents.

A placement depends on lengths only, so the exact result follows from the number of
pieces of each length: at most as many counts as the longest length has tokens,
whatever the size of the corpus. ``plan_bins`` works on *groups* of bins with equal
contents. Its runs ("pieces of length n with ranks a to b lie in bins from c on") are
joined back by length, and ranks within a length are numbered in hash buckets, so
that a length that a third of all pieces share is no single task.

Defined results: null and empty texts have no words and no piece; equal lengths are
placed in the order of a hash of the key; repeated rows are pieces of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.tables import saved

LENGTHS = (512, 1024, 2048, 4096)
BUCKET_ROWS = 100_000


def training_cost(length: int, attention_scale: int = 16_384) -> float:
    """Cost of a sequence: linear layers plus attention, which grows with the square."""
    return length * (1 + length / attention_scale)


@dataclass
class Group:
    """``n`` bins from number ``first`` on with the same contents."""

    first: int
    n: int
    size: int
    used: int
    runs: tuple  # (length, first rank, pieces per bin, offset in the bin)

    def cut(self, n: int) -> tuple[Group, Group]:
        """The first ``n`` bins and the rest."""
        rest = tuple((length, rank + n * k, k, offset) for length, rank, k, offset in self.runs)
        return (
            Group(self.first, n, self.size, self.used, self.runs),
            Group(self.first + n, self.n - n, self.size, self.used, rest),
        )

    def add(self, length: int, rank: int, k: int) -> Group:
        run = (length, rank, k, self.used)
        return Group(self.first, self.n, self.size, self.used + k * length, (*self.runs, run))


def best_size(length: int, count: int, below: list[int], sizes, cost: Callable[[int], float]) -> int:
    """The size whose bins cost least per token they can be filled with: pieces of
    this length, and in the room left the shorter pieces there are."""

    def price(size: int) -> float:
        k = min(size // length, count)
        bins = -(-count // k)
        room = size - k * length
        return cost(size) / (k * length + min(room, below[min(room, length - 1)] / bins))

    return min((s for s in sizes if s >= length), key=lambda s: (price(s), -s))


def plan_bins(counts: dict[int, int], sizes=LENGTHS, cost: Callable[[int], float] = training_cost) -> list[Group]:
    """Best-fit decreasing over ``counts`` (length -> pieces) as groups of equal bins."""
    top = max(sizes)
    below = [0] * (top + 1)  # tokens in pieces up to a length
    for length in range(1, top + 1):
        below[length] = below[length - 1] + length * counts.get(length, 0)
    rooms: dict[int, list[Group]] = {}
    opened = 0

    def put(group: Group) -> None:
        if group.n:
            rooms.setdefault(group.size - group.used, []).append(group)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for room in sorted(r for r in rooms if r >= length):
            for group in sorted(rooms.pop(room), key=lambda g: g.first):  # of equal rooms the bin opened first
                k = room // length
                full = min(group.n, left // k)
                filled, group = group.cut(full)
                if full:
                    put(filled.add(length, rank, k))
                    rank, left = rank + full * k, left - full * k
                if group.n and left and left < k:
                    one, group = group.cut(1)
                    put(one.add(length, rank, left))
                    rank, left = rank + left, 0
                put(group)
            if not left:
                break
        if left:
            size = best_size(length, left, below, sizes, cost)
            k = min(size // length, left)
            full, rest = divmod(left, k)
            put(Group(opened, full, size, 0, ()).add(length, rank, k))
            if rest:
                put(Group(opened + full, 1, size, 0, ()).add(length, rank + full * k, rest))
            opened += full + bool(rest)
    return [g for groups in rooms.values() for g in groups]


RUN = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("from_rank", T.LongType()),
        T.StructField("to_rank", T.LongType()),
        T.StructField("per_bin", T.LongType()),
        T.StructField("first_bin", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("capacity", T.LongType()),
        T.StructField("used", T.LongType()),
    ]
)


def run_rows(groups: list[Group], sizes) -> list[tuple]:
    rows = []
    for g in groups:
        capacity = min(s for s in sizes if s >= g.used)
        for length, rank, k, offset in g.runs:
            rows.append((length, rank, rank + g.n * k, k, g.first, offset, capacity, g.used))
    return rows


def pieces(df: DataFrame, key: str, words: Column, longest: int) -> DataFrame:
    """Documents cut at every ``longest`` words: ``piece`` from 0, ``start``, ``n_words``."""
    sized = df.select(F.col(key), words.cast("long").alias("_n")).where(F.col("_n") > 0)
    numbered = sized.withColumn(
        "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {longest}")))
    )
    start = F.col("piece") * longest
    return numbered.select(
        key, "piece", start.alias("start"), F.least(F.lit(longest), F.col("_n") - start).cast("long").alias("n_words")
    )


def ranked(cut: DataFrame, key: str) -> DataFrame:
    """``rank`` of each piece among those of its length, from 0."""
    rows = cut.withColumn("_order", F.xxhash64(key, "piece"))
    total = rows.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_order"), F.lit(buckets)))
    sums = rows.groupBy("n_words", "_bucket").agg(F.count("*").alias("_in"))
    earlier = Window.partitionBy("n_words").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("n_words", "_bucket", F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("n_words", "_bucket").orderBy("_order", key, "piece")
    numbered = rows.withColumn("_inside", F.row_number().over(inside) - 1)
    return numbered.join(before, ["n_words", "_bucket"]).select(
        key, "piece", "start", "n_words", (F.col("_inside") + F.col("_before")).alias("rank")
    )


def pack(
    df: DataFrame, key: str, words: Column, sizes=LENGTHS, cost: Callable[[int], float] = training_cost
) -> DataFrame:
    """One row per piece: ``key, piece, start, n_words, seq_id, offset, capacity, used``.

    ``start`` counts words of the document, ``offset`` words of the sequence;
    ``used`` is what the sequence holds.
    """
    spark = df.sparkSession
    cut = saved(ranked(saved(pieces(df, key, words, max(sizes))), key))
    counts = {r["n_words"]: r["n"] for r in cut.groupBy("n_words").agg(F.count("*").alias("n")).collect()}
    rows = run_rows(plan_bins(counts, sizes, cost), sizes)
    # bounded by the longest length, not by the data; one row per length for the join
    runs = spark.createDataFrame(rows, RUN).coalesce(1)
    by_length = runs.groupBy("n_words").agg(
        F.array_sort(F.collect_list(F.struct("from_rank", "to_rank", "per_bin", "first_bin", "offset", "capacity", "used"))).alias("_runs")
    )
    run = F.filter("_runs", lambda r: (r["from_rank"] <= F.col("rank")) & (F.col("rank") < r["to_rank"]))[0]
    placed = cut.join(F.broadcast(by_length), "n_words").withColumn("_run", run)
    step = F.col("rank") - F.col("_run.from_rank")
    return placed.select(
        key,
        "piece",
        "start",
        "n_words",
        (F.col("_run.first_bin") + F.floor(step / F.col("_run.per_bin"))).alias("seq_id"),
        (F.col("_run.offset") + step % F.col("_run.per_bin") * F.col("n_words")).alias("offset"),
        F.col("_run.capacity").alias("capacity"),
        F.col("_run.used").alias("used"),
    )


def sequences(df: DataFrame, placed: DataFrame, key: str, text: str) -> DataFrame:
    """The packed sequences themselves: ``seq_id, capacity, used``, the documents in
    order of their place, and their words joined by one space, documents by a newline.

    Keys are unique. A sequence is bounded by the longest length.
    """
    spread = df.select(key, F.col(text).alias("_text")).join(placed, key)
    # a document in one piece keeps its words without being split and joined again
    words = F.split(F.trim(F.regexp_replace("_text", r"[\x20\x09-\x0D]+", " ")), " ")
    cut = F.array_join(F.slice(words, (F.col("start") + 1).cast("int"), F.col("n_words").cast("int")), " ")
    parts = spread.select(
        "seq_id", "capacity", "used", F.struct("offset", F.col(key).alias("doc"), cut.alias("words")).alias("_part")
    )
    packed = parts.groupBy("seq_id", "capacity", "used").agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
    return packed.select(
        "seq_id",
        "capacity",
        "used",
        F.col("_parts.doc").alias(f"{key}s"),
        F.array_join(F.col("_parts.words"), "\n").alias("text"),
    )
