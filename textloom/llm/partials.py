"""Sums of arrays that the tasks of a pass over a table make.

Each task yields one row: its number and its array as bytes. The rows are added up in
two steps, so that the driver gets at most ``FAN`` arrays however many tasks there were;
both steps add in the order of the tasks, so a repeated task changes no bit of the sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 64
PARTIAL = "part int, values binary"


def row(part: int, values: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int32()), pa.array([values.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["part", "values"])


def _adding(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(raw.as_buffer(), dtype)
                group = part % FAN
                groups[group] = groups[group] + values if group in groups else values.copy()
        for group, values in sorted(groups.items()):
            yield row(group, values)

    return run


def total(df: DataFrame, work: Callable, dtype: str) -> np.ndarray | None:
    """The sum over all tasks of the arrays that ``work`` makes, an Arrow function with
    rows of :func:`row`; None without a row."""
    made = df.mapInArrow(work, PARTIAL)
    few = made.repartition(FAN, F.col("part") % FAN).sortWithinPartitions("part").mapInArrow(_adding(dtype), PARTIAL)
    rows = sorted(few.collect(), key=lambda r: r["part"])
    return np.sum([np.frombuffer(r["values"], dtype) for r in rows], axis=0) if rows else None
