"""Vectors as short codes: the nearest entry of a codebook per part of the vector.

The nearest entry is found by slices and bitmasks. Per coordinate the entries are sorted,
and each place of that order has the mask of the entries before it, so the entries whose
coordinate lies in a range are the exclusive or of two prefix masks. The distance to one
entry (the one next along the widest coordinate) is the initial radius: no nearer entry
can lie outside that range in any coordinate, so the masks of all coordinates, ANDed, are
exact candidates, ties included. Only candidates have their distance computed.

Codebooks are learned by rounds of assigning and averaging in exact integers. A round is
one pass over the table; a task hands on counts and sums per entry, never rows.

Defined results: null vectors and such with null or non-finite entries take no part, nor
do empty ones and those of another size than most have; rows with equal or null keys
count each time; the first entries come from the smallest keys (nulls last, equal keys in
the order of their vectors), and fewer rows than entries give fewer entries. Null labels
count as one label. An empty table gives no rows. Coordinates whose squared distances do
not fit 64 bits raise ``OverflowError``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import partials
from textloom.llm.tables import saved
from textloom.llm.vectors import finite, floored, matrices, usual_size

WORD = 64


def int_roots(squares: np.ndarray) -> np.ndarray:
    """Whole square roots, rounded down."""
    root = np.sqrt(squares.astype(float)).astype(np.int64)
    root -= root * root > squares
    root += (root + 1) * (root + 1) <= squares
    return root


class Book:
    """The entries of one part, with their sorted coordinates and prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.ascontiguousarray(entries, np.int64)
        n, width = self.entries.shape
        order = self.entries.argsort(0, kind="stable")
        self.sorted = np.take_along_axis(self.entries, order, 0)
        self.order = order
        bits = np.zeros((n + 1, width, -(-n // WORD)), np.uint64)
        place, column = np.indices((n, width))
        bits[place + 1, column, order // WORD] = np.uint64(1) << (order % WORD).astype(np.uint64)
        self.before = np.bitwise_or.accumulate(bits, 0)  # place x coordinate x word
        self.widest = int((self.sorted[-1] - self.sorted[0]).argmax()) if width else 0

    def distances(self, rows: np.ndarray, entry: np.ndarray) -> np.ndarray:
        apart = rows - self.entries[entry]
        return (apart * apart).sum(1)

    def probe(self, rows: np.ndarray) -> np.ndarray:
        """The entry next to a row along the widest coordinate."""
        line, at = self.sorted[:, self.widest], rows[:, self.widest]
        high = np.minimum(np.searchsorted(line, at), len(line) - 1)
        low = np.maximum(high - 1, 0)
        place = np.where(np.abs(line[low] - at) <= np.abs(line[high] - at), low, high)
        return self.order[place, self.widest]

    def candidates(self, rows: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks (rows x words) of the entries within ``radius`` in every coordinate."""
        masks = None
        for j in range(rows.shape[1]):
            low = np.searchsorted(self.sorted[:, j], rows[:, j] - radius, "left")
            high = np.searchsorted(self.sorted[:, j], rows[:, j] + radius, "right")
            inside = self.before[high, j] ^ self.before[low, j]
            masks = inside if masks is None else masks & inside
        return masks

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index (the lowest of equally near ones) and squared distance of the nearest entry."""
        if not rows.shape[1]:
            return np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        masks = self.candidates(rows, int_roots(self.distances(rows, self.probe(rows))))
        best, least = np.zeros(len(rows), np.int64), np.full(len(rows), np.iinfo(np.int64).max)
        for word in range(masks.shape[1]):
            mask, left = masks[:, word], np.flatnonzero(masks[:, word])
            while len(left):
                own = mask[left]
                lowest = own & (~own + np.uint64(1))
                entry = np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) + word * WORD
                far = self.distances(rows[left], entry)
                nearer = far < least[left]
                best[left[nearer]], least[left[nearer]] = entry[nearer], far[nearer]
                mask[left] = own ^ lowest
                left = left[mask[left] != 0]
        return best, least


def bounds(size: int, parts: int) -> list[int]:
    return [i * size // parts for i in range(parts + 1)]


def _checked(x: np.ndarray) -> np.ndarray:
    if x.size and float(np.abs(x.astype(float)).max()) ** 2 * 4 * x.shape[1] >= float(1 << 63):
        raise OverflowError("squared distances do not fit 64 bits")
    return x


def _gathering(books: list[Book], cuts: list[int]):
    """Counts and sums of the rows of a task per entry, one part after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        size, n = cuts[-1], len(books[0].entries)
        counts, sums = np.zeros((len(books), n), np.int64), np.zeros((n, size), np.int64)
        for batch in batches:
            for _, x in matrices(batch.column(0), size):
                _checked(x)
                for p, book in enumerate(books):
                    rows = x[:, cuts[p] : cuts[p + 1]]
                    nearest, _ = book.nearest(rows)
                    counts[p] += np.bincount(nearest, minlength=n)
                    order = nearest.argsort(kind="stable")
                    met, first = np.unique(nearest[order], return_index=True)
                    sums[met, cuts[p] : cuts[p + 1]] += np.add.reduceat(rows[order], first, 0)
        if counts.any():
            yield partials.row(TaskContext.get().partitionId(), np.concatenate([counts.ravel(), sums.ravel()]))

    return run


def _encoding(books: list[Book], cuts: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch.column(0), cuts[-1]):
                _checked(x)
                found = [book.nearest(x[:, cuts[p] : cuts[p + 1]]) for p, book in enumerate(books)]
                codes = np.stack([f[0] for f in found], 1).astype(np.uint8)
                error = np.sum([f[1] for f in found], axis=0)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(books)), len(x), [None, pa.py_buffer(codes.tobytes())])
                others = [c.slice(at, len(x)) for c in batch.columns[1:]]
                columns = [*others, raw.cast(pa.binary()), pa.array(error, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[1:], "code", "error"])

    return run


def train(df: DataFrame, key: str, vector: str, parts: int = 8, entries: int = 16, rounds: int = 6) -> list[Book]:
    """The codebooks of vectors (arrays of longs): none without vectors."""
    if entries > 256:
        raise ValueError("an index takes one byte")
    rows = df.select(F.col(key).alias("key"), F.col(vector).alias("x"))
    size = usual_size(rows, "x")
    rows = rows.where(F.size("x") == size)
    first = rows.orderBy(F.col("key").asc_nulls_last(), "x").limit(entries).collect() if size else []
    if not first:
        return []
    cuts = bounds(size, parts)
    start = _checked(np.array([r["x"] for r in first], np.int64))
    books = [Book(start[:, a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    n = len(start)
    for _ in range(rounds):
        made = partials.total(rows.select("x"), _gathering(books, cuts), "<i8")
        counts, sums = made[: parts * n].reshape(parts, n), made[parts * n :].reshape(n, size)
        moved = []
        for p, book in enumerate(books):
            own = sums[:, cuts[p] : cuts[p + 1]] // np.maximum(counts[p], 1)[:, None]
            moved.append(Book(np.where(counts[p][:, None] > 0, own, book.entries)))
        books = moved
    return books


def digest(books: list[Book]) -> str:
    """SHA-256 over the entries as decimal numbers: by part, entry, position."""
    return hashlib.sha256(",".join(str(v) for book in books for v in book.entries.ravel().tolist()).encode()).hexdigest()


def encode(df: DataFrame, vector: str, books: list[Book], kept: list[str]) -> DataFrame:
    """The columns ``kept`` of every row with ``code`` (a byte per part) and ``error``,
    the squared distance to the coded vector."""
    read = df.select(F.col(vector).alias("_x"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)])
    own = ", ".join(f"{n} {t}" for n, t in read.dtypes[1:])
    schema = f"{own}, code binary, error long"
    if not books:
        coded = df.sparkSession.createDataFrame([], schema)
    else:
        cuts = [0, *np.cumsum([b.entries.shape[1] for b in books]).tolist()]
        coded = read.where(F.size("_x") == cuts[-1]).mapInArrow(_encoding(books, cuts), schema)
    return coded.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], "code", "error")


def decode(code: bytes, books: list[Book]) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([book.entries[i] for i, book in zip(code, books, strict=True)])


def report(df: DataFrame, key: str, vector: str, label: str, scale: int = 4096) -> DataFrame:
    """``key, code`` (hex), ``error, label_error, codebooks_sha256`` of every vector, its
    entries taken as ``floor(scale * entry)``."""
    rows = df.where(finite(F.col(vector))).select(
        F.col(key).alias("key"), F.col(label).alias("label"), floored(F.col(vector), scale).alias("x")
    )
    books = train(rows, "key", "x")
    coded = saved(encode(rows, "x", books, ["key", "label"]))
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    both = coded.join(sums, coded["label"].eqNullSafe(sums["_label"]))
    return both.select("key", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
