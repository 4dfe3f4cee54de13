"""Array expressions shared by the jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_array(values, element_type: str = "int") -> Column:
    """A constant array. One string literal that Catalyst folds once, instead of
    one literal expression per element (a vocabulary has tens of thousands)."""
    values = list(values)
    if not values:
        return F.array().cast(f"array<{element_type}>")
    return F.split(F.lit(",".join(str(v) for v in values)), ",").cast(f"array<{element_type}>")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row. An expression used
    inside a lambda is otherwise evaluated for every element."""
    return F.transform(F.array(value), body)[0]


def positions(xs: Column) -> Column:
    """``[0, 1, …, size-1]``; empty for an empty array."""
    return F.transform(xs, lambda _, i: i)


def pad_to(xs: Column, length, value) -> Column:
    """Append ``value`` until the array has ``length`` elements."""
    length = length if isinstance(length, Column) else F.lit(length)
    return F.concat(xs, F.array_repeat(value, F.greatest(F.lit(0), length - F.size(xs)).cast("int")))


def sliding(xs: Column, size: int) -> Column:
    """All windows of ``size`` neighbouring elements; none when the array is shorter."""

    def windows(v: Column) -> Column:
        starts = F.filter(positions(v), lambda i: i + size <= F.size(v))
        return F.transform(starts, lambda i: F.slice(v, i + 1, size))

    return let(xs, windows)


def contiguous(spans: Column) -> Column:
    """True when the sorted half-open spans ``struct<b,e>`` touch each other."""
    total = F.aggregate(spans, F.lit(0), lambda acc, s: acc + (s["e"] - s["b"]))
    return total == F.element_at(spans, -1)["e"] - spans[0]["b"]


def top_indexes(values: Column, n: int) -> Column:
    """Indexes of the ``n`` largest values, descending; the first index wins ties.

    The n-th largest value comes from a sort of the plain array; only positions
    at or above it are then ordered as structs.
    """

    def ranked(v: Column, floor: Column) -> Column:
        kept = F.filter(positions(v), lambda i: v[i] >= floor)
        order = F.array_sort(F.transform(kept, lambda i: F.struct((-v[i]).alias("v"), i.alias("i"))))
        return F.transform(F.slice(order, 1, n), lambda s: s["i"])

    return let(
        values,
        lambda v: let(
            F.sort_array(v, asc=False)[F.least(F.lit(n), F.size(v)) - 1], lambda floor: ranked(v, floor)
        ),
    )


def argmax(values: Column) -> Column:
    """Index of the largest value, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def softmax(scores: Column) -> Column:
    """Max-shifted softmax of an array of doubles; empty stays empty."""

    def scaled(exps: Column) -> Column:
        return let(
            F.aggregate(exps, F.lit(0.0).cast("double"), lambda a, x: a + x),
            lambda total: F.transform(exps, lambda x: x / total),
        )

    exps = let(F.array_max(scores), lambda top: F.transform(scores, lambda s: F.exp(s - top)))
    return let(exps, scaled)
