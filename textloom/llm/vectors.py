"""Vectors of a table: which take part, and their entries as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = 4096


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds numbers only."""
    entries = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & entries, F.lit(False))


def floored(vector: Column, scale: float, offset: int = 0) -> Column:
    """``floor(scale * entry) + offset`` of every entry as a long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(offset).cast("long"))


def usual_size(df: DataFrame, vector: str) -> int:
    """The size that most vectors have, the larger of equally frequent ones; 0 without any."""
    sizes = df.where(F.size(vector) > 0).groupBy(F.size(vector).alias("size")).count()
    first = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return first["size"] if first else 0


def matrices(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """First row and entries of the vectors of a batch, some thousand rows at a time."""
    for at in range(0, len(column), ROWS):
        part = column.slice(at, ROWS)
        yield at, part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), size)
