"""Masked-token selection and corruption, local to each row.

Word spans, corruption and the greedy choice of spans run in Arrow batches, the first two
over all tokens of a batch at once; the choice stops as soon as the budget is used.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import draws
from textloom.functions.arrays import let, positions
from textloom.operators.vocabulary import MASK, SPECIAL_KIND, SUFFIX_KIND, Vocabulary

#: Draws of the n-grams at one place are so many apart, or further for longer ones.
LEAST_STRIDE = 16
MASK_SHARE, KEEP_SHARE = 0.8, 0.1


def token_kinds(ids: Column, kinds: Column) -> Column:
    """Kind of every token, from the constant array of kinds by id."""
    return F.transform(ids, lambda i: kinds[i])


def word_spans(kinds: Column) -> Column:
    """Words as half-open token spans ``array<struct<b,e>>``, in order.

    A word starts at any ordinary token and runs over the suffix pieces after it;
    special tokens belong to no word, and a suffix right after one starts a word.
    """

    def edges(ks: Column) -> Column:
        # where a word or a special token starts, and the end
        size = F.size(ks)
        return F.filter(
            F.sequence(F.lit(0), size),
            lambda i: (i == size)
            | (i == 0)
            | (ks[F.least(i, size - 1)] != SUFFIX_KIND)
            | (ks[F.greatest(i - 1, F.lit(0))] == SPECIAL_KIND),
        )

    def pairs(ks: Column, at: Column) -> Column:
        spans = F.transform(
            F.slice(at, 1, F.size(at) - 1), lambda b, k: F.struct(b.alias("b"), at[k + 1].alias("e"))
        )
        return F.filter(spans, lambda s: ks[s["b"]] != SPECIAL_KIND)

    return let(kinds, lambda ks: let(edges(ks), lambda at: pairs(ks, at)))


def ngram_spans(spans: Column, max_ngram: int) -> Column:
    """Every run of 1..``max_ngram`` touching words as one span, shorter runs first.
    Overlapping words are an error."""

    def check(xs: Column) -> Column:
        overlap = F.exists(positions(xs), lambda i: (i + 1 < F.size(xs)) & (xs[i]["e"] > xs[i + 1]["b"]))
        failed = F.raise_error(F.lit("overlapping spans")).cast("array<struct<b:int,e:int>>")
        return F.when(overlap, failed).otherwise(xs)

    # neighbours are looked up by place: no array is made for a run
    def touch(xs: Column, i: Column, n: int) -> Column:
        return functools.reduce(lambda a, k: a & (xs[i + k]["e"] == xs[i + k + 1]["b"]), range(n - 1), i + n <= F.size(xs))

    def runs(xs: Column, n: int) -> Column:
        starts = positions(xs) if n == 1 else F.filter(positions(xs), lambda i: touch(xs, i, n))
        return F.transform(starts, lambda i: F.struct(xs[i]["b"].alias("b"), xs[i + n - 1]["e"].alias("e")))

    return let(let(spans, check), lambda xs: F.concat(*[runs(xs, n) for n in range(1, max_ngram + 1)]))


def mask_budget(n_tokens: Column, prob: float, max_predictions: int) -> Column:
    """Tokens to mask: the share ``prob`` of the tokens, rounded half to even, at
    least one, at most ``max_predictions``."""
    wanted = F.rint(n_tokens * F.lit(float(prob))).cast("int")
    return F.least(F.lit(max_predictions), F.greatest(F.lit(1), wanted))


def _candidates(begin: np.ndarray, end: np.ndarray, max_ngram: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams in the order in which they are tried.

    Each size is shuffled. Sizes are drawn with weight 1/n: giving the
    candidates of size n, in shuffled order, arrival times with gaps of mean n
    and merging by time draws sizes with just these weights.
    """
    all_begin, all_end, all_time = [], [], []
    touching = end[:-1] == begin[1:]
    stride = max(LEAST_STRIDE, max_ngram + 1)
    whole = np.ones(len(begin), dtype=bool)
    for n in range(1, min(max_ngram, len(begin)) + 1):
        if n > 1:
            whole = whole[:-1] & touching[n - 2 :]
        first = np.flatnonzero(whole)
        rank = np.arange(len(first), dtype=np.int64)
        first = first[np.argsort(draws.mix_numpy(seed, begin[first].astype(np.int64) * 2 * stride + n), kind="stable")]
        gap = -np.log(draws.to_unit(draws.mix_numpy(seed, (rank * 2 + 1) * stride + n))) * n
        all_begin.append(begin[first])
        all_end.append(end[first + n - 1])
        all_time.append(np.cumsum(gap))
    if max_ngram == 1:
        return all_begin[0], all_end[0]
    order = np.argsort(np.concatenate(all_time), kind="stable")
    return np.concatenate(all_begin)[order], np.concatenate(all_end)[order]


def choose_spans(begin: np.ndarray, end: np.ndarray, max_ngram: int, budget: int, seed: int) -> list[tuple[int, int]]:
    """Greedy pass: take a candidate when it fits the budget and overlaps nothing taken."""
    if len(begin) == 0:
        return []
    taken = bytearray(int(end[-1]))
    used, chosen = 0, []
    cand_begin, cand_end = _candidates(begin, end, max_ngram, seed)
    for b, e in zip(cand_begin.tolist(), cand_end.tolist(), strict=True):
        if used + e - b > budget or taken.find(1, b, e) >= 0:
            continue
        taken[b:e] = b"\x01" * (e - b)
        used += e - b
        chosen.append((b, e))
        if used == budget:
            break
    chosen.sort()
    return chosen


def select_spans(max_ngram: int | None):
    """A column function ``(begins, ends, budget, seed) -> array<struct<b,e>>``:
    the spans to mask, in order of position. No words, no spans."""
    size = max_ngram or 1

    @F.arrow_udf("array<struct<b:int,e:int>>")
    def select(begins: pa.Array, ends: pa.Array, budget: pa.Array, seed: pa.Array) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(begins.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
        begin = begins.flatten().to_numpy(zero_copy_only=False)
        end = ends.flatten().to_numpy(zero_copy_only=False)
        out, out_offsets = [], [0]
        rows = zip(budget.to_pylist(), seed.to_pylist(), strict=True)
        for r, (row_budget, row_seed) in enumerate(rows):
            lo, hi = offsets[r], offsets[r + 1]
            out.extend(choose_spans(begin[lo:hi], end[lo:hi], size, row_budget, row_seed))
            out_offsets.append(len(out))
        flat = np.array(out, dtype=np.int32).reshape(-1, 2)
        spans = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["b", "e"])
        return pa.ListArray.from_arrays(pa.array(out_offsets, type=pa.int32()), spans)

    # keeps the optimizer from copying the call into filters placed after it
    return select.asNondeterministic()


def _bounds(rows: pa.ListArray) -> np.ndarray:
    """Where each row begins in the flattened elements, and the end."""
    return np.concatenate([[0], np.cumsum(rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _lists(bounds: np.ndarray, elements: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), elements)


def find_spans(kinds: np.ndarray):
    """A column function ``ids -> array<struct<b,e>>``: :func:`word_spans` of whole batches;
    ``kinds`` holds the kind of every id."""

    @F.arrow_udf("array<struct<b:int,e:int>>")
    def find(ids: pa.Array) -> pa.Array:
        bounds = _bounds(ids)
        kind = kinds[ids.flatten().to_numpy(zero_copy_only=False)]
        edge = kind != SUFFIX_KIND
        edge[1:] |= kind[:-1] == SPECIAL_KIND
        edge[bounds[:-1][np.diff(bounds) > 0]] = True
        begin = np.flatnonzero(edge)
        end = np.append(begin[1:], len(kind))[: len(begin)]
        word = kind[begin] != SPECIAL_KIND
        begin, end = begin[word], end[word]
        cut = np.searchsorted(begin, bounds)
        first = np.repeat(bounds[:-1], np.diff(cut))
        ends = [pa.array((x - first).astype(np.int32)) for x in (begin, end)]
        return _lists(cut, pa.StructArray.from_arrays(ends, names=["b", "e"]))

    return find.asNondeterministic()


def corrupt_spans(ids: Column, spans: Column, vocab: Vocabulary, seed: Column) -> Column:
    """The masked positions with their old and new ids, ascending:
    ``array<struct<pos, label, new>>``. One draw per span: masked, kept, or every
    token replaced by its own random token."""
    table, mask_id = np.array(vocab.replacement_ids(), dtype=np.int32), vocab.ids[MASK]

    @F.arrow_udf("array<struct<pos:int,label:int,new:int>>")
    def corrupt(ids: pa.Array, spans: pa.Array, seed: pa.Array) -> pa.Array:
        tokens, cut = ids.flatten().to_numpy(zero_copy_only=False), _bounds(spans)
        begin, end = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in spans.flatten().flatten())
        size, row = end - begin, np.repeat(np.arange(len(spans)), np.diff(cut))
        keys = seed.to_numpy(zero_copy_only=False)[row]
        action = np.repeat(draws.to_unit(draws.mix_numpy(keys, begin * 2)), size)
        before = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        pos = np.repeat(begin - before[:-1], size) + np.arange(before[-1])
        old = tokens[np.repeat(_bounds(ids)[row], size) + pos]
        drawn = table[draws.mix_numpy(np.repeat(keys, size), pos * 2 + 1) % len(table)]
        new = np.where(action < MASK_SHARE, mask_id, np.where(action < MASK_SHARE + KEEP_SHARE, old, drawn))
        columns = [pa.array(x.astype(np.int32)) for x in (pos, old, new)]
        return _lists(before[cut], pa.StructArray.from_arrays(columns, names=["pos", "label", "new"]))

    return corrupt.asNondeterministic()(ids, spans, seed)


def apply_corruption(ids: Column, masked: Column) -> Column:
    """``ids`` with the masked positions replaced."""

    @F.arrow_udf("array<int>")
    def replace(ids: pa.Array, masked: pa.Array) -> pa.Array:
        bounds, tokens = _bounds(ids), ids.flatten().to_numpy(zero_copy_only=False).copy()
        pos, _, new = (x.to_numpy(zero_copy_only=False) for x in masked.flatten().flatten())
        tokens[np.repeat(bounds[:-1], np.diff(_bounds(masked))) + pos] = new
        return _lists(bounds, pa.array(tokens, pa.int32()))

    return replace.asNondeterministic()(ids, masked)
