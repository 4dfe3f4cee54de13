"""Whitening of integer vectors by shifted CholeskyQR.

The rows ``a = (n * x - S) / n`` (the difference in exact integers, S the exact sums) are
orthogonalised in passes over the table: a pass solves the rows with the triangular
factors so far, adds up their Gram matrix per task, and the driver takes its Cholesky
factor. The first Gram matrix gets a shift, which keeps it positive definite however ill
the rows are conditioned; later ones only where the factor does not exist. The factors are
composed to R, and R's singular values and right vectors give the eigenvalues and the
components of the covariance without its condition being squared.

Nothing but Gram matrices (size by size) leaves a task; the driver adds at most
``partials.FAN`` of them a pass. Every pass reads the source anew, only the vectors.

Defined results: null vectors and such with null or non-finite entries take no part, nor
do empty ones and those of another size than most have (:func:`vectors.usual_size`);
equal rows and equal keys count each time; a null key stays null. Components without
variance (to double precision) are left out, so equal vectors or a single one give no
rows, like an empty table. Sums that do not fit a long raise ``OverflowError``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import partials
from textloom.llm.vectors import matrices, usual_size

PASSES = 8
SETTLED = 1e-10  # distance of a Gram matrix's eigenvalues from one (or zero) that ends the passes
UNIT = np.finfo(float).eps / 2
LONG = float(1 << 63)


@dataclass
class Whitening:
    n: int
    sums: np.ndarray  # exact, per dimension
    axes: np.ndarray  # dimensions x components
    eigenvalues: np.ndarray  # falling
    trace: float
    identity_error: float | None = None

    @property
    def weights(self) -> np.ndarray:
        return self.axes / np.sqrt(self.eigenvalues)


def _part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _summing(size: int):
    """Number and sums of the rows of a task; the sum of their magnitudes guards against overflow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, reach = np.zeros(size + 1, np.int64), 0.0
        for batch in batches:
            for _, x in matrices(batch.column(0), size):
                reach += np.abs(x.astype(float)).max(initial=0) * len(x)
                if reach >= LONG:
                    raise OverflowError("sums of entries do not fit 64 bits")
                sums[0] += len(x)
                sums[1:] += x.sum(0)
        if sums[0]:
            yield partials.row(_part(), sums)

    return run


def _differences(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - S``, exactly."""
    if np.abs(x.astype(float)).max(initial=0) * n + np.abs(sums.astype(float)).max(initial=0) >= LONG:
        raise OverflowError("entries times rows do not fit 64 bits")
    return x * np.int64(n) - sums


def solved(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of an upper triangular matrix, column by column."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def _products(size: int, n: int, sums: np.ndarray, made):
    """The Gram matrix, over the rows of a task, of what ``made`` makes of centred rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = None
        for batch in batches:
            for _, x in matrices(batch.column(0), size):
                rows = made(_differences(x, n, sums) / n)
                gram = rows.T @ rows if gram is None else gram + rows.T @ rows
        if gram is not None:
            yield partials.row(_part(), gram)

    return run


def _solving(factors: list[np.ndarray]):
    def made(rows: np.ndarray) -> np.ndarray:
        for upper in factors:
            rows = solved(rows, upper)
        return rows

    return made


def _factor(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper Cholesky factor; with a shift if asked to, or if there is none without."""
    size = len(gram)
    if not shifted:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    shift = max(11 * (n * size + size * (size + 1)) * UNIT, 32 * size * UNIT) * np.linalg.eigvalsh(gram)[-1]
    return np.linalg.cholesky(gram + min(shift, gram.trace()) * np.eye(size)).T


def fit(df: DataFrame, vector: str, components: int | None = None) -> Whitening | None:
    """Components of the covariance (divisor n) of all vectors (arrays of longs, all of
    one size), the first ``components`` of them; None without vectors."""
    rows = df.select(F.col(vector).alias("x"))
    size = usual_size(rows, "x")
    rows = rows.where(F.size("x") == size)
    sums = partials.total(rows, _summing(size), "<i8") if size else None
    if sums is None:
        return None
    n, sums = int(sums[0]), sums[1:].copy()
    factors: list[np.ndarray] = []
    composed = np.eye(size)
    for turn in range(PASSES):
        gram = partials.total(rows, _products(size, n, sums, _solving(factors)), "<f8").reshape(size, size)
        gram = (gram + gram.T) / 2
        if not gram.any():
            break
        values, turned = np.linalg.eigh(gram)
        if turn and np.all((np.abs(values - 1) < SETTLED) | (values < SETTLED)):
            break
        factors.append(_factor(gram, n, shifted=turn == 0))
        composed = factors[-1] @ composed
    else:
        raise ArithmeticError("the rows did not become orthogonal")
    if not gram.any():
        return Whitening(n, sums, np.empty((size, 0)), np.empty(0), 0.0)
    # what is left of the last Gram matrix belongs to R as well
    rest = (turned * np.sqrt(np.maximum(values, 0))).T
    _, singular, axes = np.linalg.svd(rest @ composed)
    with_variance = singular > singular[0] * size * 8 * UNIT
    axes = axes[with_variance].T[:, :components]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    eigenvalues = singular**2 / n
    found = Whitening(n, sums, axes, eigenvalues[with_variance][:components], float(eigenvalues.sum()))
    weights = found.weights
    again = partials.total(rows, _products(size, n, sums, lambda a: a @ weights), "<f8")
    k = len(found.eigenvalues)
    found.identity_error = float(np.abs(again.reshape(k, k) / n - np.eye(k)).max(initial=0))
    return found


def _whitening(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.weights
        for batch in batches:
            for at, x in matrices(batch.column(1), len(model.sums)):
                apart = _differences(x, model.n, model.sums)
                if (apart.astype(float) ** 2).sum(1).max(initial=0) >= LONG:
                    raise OverflowError("a deviation does not fit 64 bits")
                flat = pa.array(((apart / model.n) @ weights).ravel(), pa.float64())
                lists = pa.FixedSizeListArray.from_arrays(flat, weights.shape[1]).cast(pa.list_(pa.float64()))
                deviation = pa.array((apart * apart).sum(1), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x)), deviation, lists], ["key", "deviation", "whitened"])

    return run


def whiten(df: DataFrame, key: str, vector: str, model: Whitening | None) -> DataFrame:
    """``key, deviation, whitened`` (an array, a number per component) of every vector of
    the model's size. ``deviation`` is the exact sum of ``(n * x - S)^2``."""
    rows = df.select(F.col(key).alias("key"), F.col(vector).alias("x"))
    schema = f"key {dict(rows.dtypes)['key']}, deviation long, whitened array<double>"
    if model is None or not len(model.eigenvalues):
        return df.sparkSession.createDataFrame([], schema)
    return rows.where(F.size("x") == len(model.sums)).mapInArrow(_whitening(model), schema)


def report(df: DataFrame, key: str, vector: str, components: int) -> DataFrame:
    """A row per vector and component: ``key, component, n, deviation, whitened, explained, identity_error``."""
    model = fit(df, vector, components)
    each = whiten(df, key, vector, model).select("key", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    shares = [float(e / model.trace) for e in model.eigenvalues] if model is not None else []
    return each.select(
        "key",
        (F.col("_at") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(F.array(*[F.lit(s) for s in shares]).cast("array<double>"), F.col("_at")).alias("explained"),
        F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
    )
