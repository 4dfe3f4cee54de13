"""Sequence packing: consecutive lines of a shard into groups of at least a
target number of tokens.

Where a group ends depends on where it began, so the plain form is one loop per
shard, and a shard may hold a third of the corpus. Here the ordered lines are
cut into blocks and three passes give exactly the loop's result:

1. each block is summarised as a step function: tokens still missing from the
   group that is open when the block begins -> tokens missing when it ends, and
   groups closed in between;
2. the step functions of ``FAN`` neighbouring blocks are composed to one, and again
   until a shard has one; on the way back each gives its parts their entry states,
   so that no task holds the blocks of a shard;
3. each block, knowing its entry state, numbers its groups.

Only line lengths take part; tokens are joined back afterwards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import draws
from textloom.operators.ordering import block_count, ordered_blocks
from textloom.session import write_through

#: Lines in a block at most, on average; blocks follow the data.
BLOCK_LINES = 1_000_000
#: Step functions composed by one task.
FAN = 256
KEYS = ["shard", "dupe", "block"]


def group_targets(max_length: int, short_prob: float, seed: int, *keys: Column) -> Column:
    """Token target of a group that starts at the keyed line: ``max_length``, or
    with ``short_prob`` a length drawn from 5 to ``max_length``."""
    if short_prob <= 0:
        return F.lit(max_length)
    short = 5 + draws.seed(seed, "short-length", *keys) % (max_length - 4)
    return F.when(draws.uniform(seed, "short", *keys) < short_prob, short.cast("int")).otherwise(max_length)


def _group_ends(lengths: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a group starting at each line: the line that closes it (n when none
    does) and the tokens before each line."""
    before = np.concatenate([[0], np.cumsum(lengths)])
    return np.searchsorted(before[1:], before[:-1] + targets, side="left"), before


def _block_steps(rows: pd.DataFrame) -> pd.DataFrame:
    """Pass 1 for one shard and block."""
    rows = rows.sort_values("doc_id", kind="stable")
    lengths = np.concatenate(rows["lens"].tolist()).astype(np.int64)
    targets = np.concatenate(rows["targets"].tolist()).astype(np.int64)
    n = len(lengths)
    ends, before = _group_ends(lengths, targets)
    missing = [0] * (n + 1)
    closed = [0] * (n + 1)
    left = (targets - (before[n] - before[:n])).tolist()
    ends = ends.tolist()
    for i in range(n - 1, -1, -1):
        end = ends[i]
        if end == n:
            missing[i] = left[i]
        else:
            missing[i], closed[i] = missing[end + 1], closed[end + 1] + 1
    # an open group misses at most max(target) tokens, so it closes on one of the first lines
    reach = int(np.searchsorted(before[:-1], rows["max_target"].iloc[0], side="left"))
    upto, missing_after, closed_after = (np.array(x[1 : reach + 1], dtype=np.int64) for x in (before, missing, closed))
    # groups soon fall into step, so neighbouring entries mostly lead to the same end
    last = np.append(
        np.flatnonzero((np.diff(missing_after) != 0) | (np.diff(closed_after) != 0)), len(upto) - 1
    )
    first = rows.iloc[0]
    return pd.DataFrame(
        {
            "shard": [first["shard"]],
            "dupe": [first["dupe"]],
            "block": [first["block"]],
            "most": [int(first["max_target"])],
            "total": [int(before[n])],
            "upto": [upto[last]],
            "missing": [missing_after[last]],
            "closed": [closed_after[last]],
            "fresh_missing": [missing[0]],
            "fresh_closed": [closed[0]],
        }
    )


STEP_SCHEMA = (
    "shard string, dupe int, block int, most bigint, total bigint, upto array<bigint>, missing array<bigint>, "
    "closed array<bigint>, fresh_missing bigint, fresh_closed bigint"
)


def _through(step, missing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens missing after a step, and groups closed in it, for tokens missing before."""
    at = np.minimum(np.searchsorted(step.upto, missing, side="left"), len(step.upto) - 1)
    fresh, open_after = missing == 0, missing > step.total
    after = np.where(open_after, missing - step.total, np.where(fresh, step.fresh_missing, step.missing[at]))
    closed = np.where(open_after, 0, np.where(fresh, step.fresh_closed, step.closed[at] + 1))
    return after, closed


def _compose(steps: pd.DataFrame) -> pd.DataFrame:
    """The step function of neighbouring blocks: one row per block in, one row out."""
    steps = steps.sort_values("block")
    first, *later = steps.itertuples(index=False)
    total, upto, missing, closed = first.total, first.upto, first.missing, first.closed
    fresh_missing, fresh_closed = first.fresh_missing, first.fresh_closed
    for s in later:
        missing, more = _through(s, np.asarray(missing))
        # groups that the blocks before leave open are closed here
        upto = np.concatenate([upto, s.upto + total])
        missing, closed = np.concatenate([missing, s.missing]), np.concatenate([closed + more, s.closed])
        last = np.append((np.diff(missing) != 0) | (np.diff(closed) != 0), True)
        upto, missing, closed = upto[last], missing[last], closed[last]
        # no group misses more than the largest target
        within = np.append(0, upto[:-1]) < s.most
        upto, missing, closed = upto[within], missing[within], closed[within]
        (fresh_missing,), (again,) = _through(s, np.array([fresh_missing]))
        fresh_closed += again
        total += s.total
    row = (first.shard, first.dupe, first.parent, first.most, total, upto, missing, closed, fresh_missing, fresh_closed)
    return pd.DataFrame([row], columns=[c for c in steps.columns if c != "parent"])


def _entry_states(steps: pd.DataFrame) -> pd.DataFrame:
    """Entry states of neighbouring blocks from that of the first (``entry_missing``,
    ``entry_group``): one row per block in, one row per block out."""
    steps = steps.sort_values("block")
    missing, group = steps["entry_missing"].iloc[0], steps["entry_group"].iloc[0]
    out = []
    for s in steps.itertuples(index=False):
        out.append((s.shard, s.dupe, s.block, missing, group))
        (missing,), (closed,) = _through(s, np.array([missing]))
        group += closed
    return pd.DataFrame(out, columns=["shard", "dupe", "block", "entry_missing", "entry_group"])


ENTRY_SCHEMA = "shard string, dupe int, block int, entry_missing bigint, entry_group bigint"


def entry_states(steps: DataFrame, blocks: int, fan: int = FAN) -> DataFrame:
    """Pass 2: the state in which each block begins, by composing up and walking down."""
    parent = F.floor(F.col("block") / fan).cast("int").alias("parent")
    levels = [write_through(steps)]
    while blocks > fan:
        blocks = -(-blocks // fan)
        above = levels[-1].select("*", parent).groupBy("shard", "dupe", "parent").applyInPandas(_compose, STEP_SCHEMA)
        levels.append(write_through(above))
    start = [F.lit(0).cast("bigint").alias(c) for c in ("entry_missing", "entry_group")]
    entries = levels[-1].select("shard", "dupe", F.lit(0).alias("parent")).distinct().select("*", *start)
    for level in reversed(levels):
        known = level.select("*", parent).join(entries, ["shard", "dupe", "parent"])
        entries = known.groupBy("shard", "dupe", "parent").applyInPandas(_entry_states, ENTRY_SCHEMA)
        if level is not levels[0]:
            entries = entries.withColumnRenamed("block", "parent")
    return entries


def _number_groups(rows: pd.DataFrame) -> pd.DataFrame:
    """Pass 3 for one shard and block: the groups each document takes part in, as
    runs of lines."""
    rows = rows.sort_values("doc_id", kind="stable")
    sizes = [len(x) for x in rows["lens"]]
    lengths = np.concatenate(rows["lens"].tolist()).astype(np.int64)
    targets = np.concatenate(rows["targets"].tolist()).astype(np.int64)
    n = len(lengths)
    ends, before = _group_ends(lengths, targets)
    missing, group = int(rows["entry_missing"].iloc[0]), int(rows["entry_group"].iloc[0])
    numbers = np.empty(n, dtype=np.int64)
    start_target = np.zeros(n, dtype=np.int64)
    start = 0
    if missing > 0:
        end = int(np.searchsorted(before[1:], missing, side="left"))
        numbers[: end + 1] = group
        start, group = end + 1, group + 1
    while start < n:
        end = int(ends[start])
        numbers[start : end + 1] = group
        start_target[start] = targets[start]
        start, group = end + 1, group + 1
    doc_start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    new_run = np.ones(n, dtype=bool)
    new_run[1:] = numbers[1:] != numbers[:-1]
    new_run[doc_start] = True
    first = np.flatnonzero(new_run)
    size = np.diff(np.append(first, n))
    doc = np.searchsorted(doc_start, first, side="right") - 1
    columns = [numbers[first], first - doc_start[doc], size, start_target[first]]
    runs = list(zip(*[c.tolist() for c in columns], strict=True))
    at = np.searchsorted(doc, np.arange(len(sizes) + 1)).tolist()
    return pd.DataFrame(
        {
            "shard": rows["shard"],
            "dupe": rows["dupe"],
            "doc_id": rows["doc_id"],
            "runs": [runs[a:b] for a, b in zip(at[:-1], at[1:], strict=True)],
        }
    )


RUN_SCHEMA = "shard string, dupe int, doc_id bigint, runs array<struct<grp: bigint, first: int, size: int, target: int>>"


def pack_lines(
    docs: DataFrame,
    max_length: int,
    short_prob: float = 0.0,
    seed: int = 12345,
    dupe_factor: int = 1,
    blocks: int | None = None,
    fan: int = FAN,
) -> DataFrame:
    """Groups of consecutive lines.

    ``docs``: ``shard string, doc_id bigint, lens array<int>`` — token counts
    (above zero) of the lines of a document. Lines follow each other by
    ``(doc_id, line)`` within a shard; document boundaries do not end a group,
    the end of a shard does. Result: ``shard, dupe, doc_id, runs``:
    for each group the document takes part in, its number within the shard, the
    first line, the number of lines, and the target of the group where it starts
    here (0 where it only continues).

    Only drawn targets make the packing of duplicates differ: without them the
    result holds one copy (``dupe`` 0), to be replicated as late as possible.
    """
    copies = dupe_factor if short_prob > 0 else 1
    # counted, sampled and exchanged: lengths are made from the tokens once
    docs = write_through(docs.select("shard", "doc_id", "lens").where(F.size("lens") > 0))
    if blocks is None:
        lines = docs.agg(F.sum(F.size("lens")).alias("n")).first()["n"] or 0
        blocks = max(block_count(docs), -(-lines // BLOCK_LINES))
    blocked = ordered_blocks(docs, "shard", "doc_id", blocks=blocks)
    rows = blocked.select("*", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("dupe"))
    if short_prob > 0:
        first = F.min(F.struct("doc_id")).alias("f")
        heads = rows.groupBy("shard", "dupe").agg(first).select("shard", "dupe", F.col("f.doc_id").alias("head_doc"))
        rows = rows.join(heads, ["shard", "dupe"]).withColumn(
            "targets",
            F.transform(
                "lens",
                # the first group of a shard always has the full target
                lambda _, i: F.when(
                    (F.col("doc_id") == F.col("head_doc")) & (i == 0), F.lit(max_length)
                ).otherwise(
                    group_targets(max_length, short_prob, seed, F.col("shard"), F.col("dupe"), F.col("doc_id"), i)
                ),
            ),
        ).drop("head_doc")
    else:
        rows = rows.withColumn("targets", F.transform("lens", lambda _: F.lit(max_length)))
    rows = rows.withColumn("max_target", F.lit(max_length))
    steps = rows.groupBy(*KEYS).applyInPandas(_block_steps, STEP_SCHEMA)
    entries = entry_states(steps, blocks, fan)
    return rows.join(entries, KEYS).groupBy(*KEYS).applyInPandas(_number_groups, RUN_SCHEMA)


def collect_groups(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """Attach the tokens: ``docs`` has ``shard, doc_id, lines array<array<int>>``.
    Result: ``shard, dupe, grp, target, lines`` with the lines of a group in order. A
    group holds fewer than its target of tokens plus one line, so no group grows
    with the data. Lines of one document that fall into one group travel together.
    """
    parts = packed.join(docs.where(F.size("lines") > 0), ["shard", "doc_id"]).select(
        "shard",
        "dupe",
        "doc_id",
        F.explode(
            F.transform(
                "runs",
                lambda r: F.struct(r["grp"].alias("grp"), r["target"].alias("target"), F.slice("lines", r["first"] + 1, r["size"]).alias("lines")),
            )
        ).alias("p"),
    )
    return (
        parts.groupBy("shard", "dupe", F.col("p.grp").alias("grp"))
        .agg(
            F.max("p.target").alias("target"),
            F.array_sort(F.collect_list(F.struct("doc_id", F.col("p.lines").alias("lines")))).alias("parts"),
        )
        .select("shard", "dupe", "grp", "target", F.flatten(F.col("parts.lines")).alias("lines"))
    )
