"""Order MinHash fingerprints: sketches of texts that follow the edit distance.

The k-mers of a text (8 bytes of its UTF-8) are numbered by occurrence. Each of 64 hash
functions selects the two k-mers with the least values; the pair, in the order in which
it stands in the text, is hashed to 16 bits. The share of equal components estimates how
alike two texts are in their k-mers and in the order of them.

Every text meets the one that follows it in key order. Texts are dealt once, by ranges
whose cuts are keys of the table: the text at a cut is sent along to the range before
it, the first of all to the last range, so that no second pass joins the ranges.

Defined results: a null text is empty; an empty text has the fingerprint of zeros; a text
under 8 bytes is one k-mer that includes its length; repeated keys follow each other in
the order of their texts; a single row is followed by itself; rows without a key are left
out. A task holds the k-mers of one text at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.words import mix

K = 8
FUNCTIONS = 64
RANGE_BYTES = 24 << 20
STRIDE = 1 << 13
ROWS = 512

_draws = mix(np.arange(1, 2 * FUNCTIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_flips = (_draws[:FUNCTIONS] >> np.uint64(32)).astype(np.uint32)[:, None]
_factors = ((_draws[FUNCTIONS:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1))[:, None]


def kmers(raw: bytes) -> np.ndarray:
    """Identities of the occurrence-numbered k-mers, by place."""
    if not raw:
        return np.empty(0, np.uint64)
    if len(raw) < K:
        return mix(np.frombuffer(raw.ljust(K - 1, b"\0") + bytes([len(raw)]), "<u8"))
    values = np.ndarray(len(raw) - K + 1, "<u8", raw, strides=(1,))
    n = len(values)
    order = np.argsort(values)
    ranked = values[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    found = mix(values)
    if not fresh.all():
        run = np.cumsum(fresh) - 1
        place = np.sort(run * n + order) - run * n  # places ascend within equal k-mers
        starts = np.flatnonzero(fresh)
        occurrence = np.arange(n) - starts[run]
        again = occurrence > 0
        found[place[again]] = mix(found[place[again]] ^ mix(occurrence[again].astype(np.uint64)))
    return found


def _least_two(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per function the places of the two least values; the first place wins ties."""
    values = (h[None, :] ^ _flips) * _factors
    rows = np.arange(FUNCTIONS)
    first = values.argmin(1)
    low = values[rows, first]
    values[rows, first] = np.uint32(0xFFFFFFFF)
    second = values.argmin(1)
    clash = second == first  # the other values are all as large as can be
    second[clash] = np.where(first[clash] == 0, 1, 0)
    high = values[rows, second]
    return np.stack([first, second]), np.stack([low, high])


def fingerprint(raw: bytes) -> np.ndarray:
    """64 components of 16 bits."""
    ids = kmers(raw)
    if len(ids) == 0:
        return np.zeros(FUNCTIONS, np.uint16)
    if len(ids) == 1:
        first = second = np.zeros(FUNCTIONS, np.int64)
    else:
        h = (ids >> np.uint64(32)).astype(np.uint32)
        places, values = [], []
        cuts = list(range(0, len(h), STRIDE))
        if len(cuts) > 1 and len(h) - cuts[-1] < 2:
            cuts.pop()
        for at, to in zip(cuts, [*cuts[1:], len(h)], strict=True):
            place, value = _least_two(h[at:to])
            places.append(place + at)
            values.append(value)
        places, values = np.concatenate(places), np.concatenate(values)
        best = np.argsort(values, axis=0, kind="stable")[:2]
        chosen = np.sort(np.take_along_axis(places, best, 0), axis=0)
        first, second = chosen
    pair = mix(ids[first] * np.uint64(3) + mix(ids[second]) + np.arange(FUNCTIONS, dtype=np.uint64))
    return (pair >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def as_text(print_: np.ndarray) -> str:
    return print_.astype(">u2").tobytes().hex()


COMPARED = (
    "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
NAMES = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def edit(text: str, following: str) -> str:
    """The last half of a text replaced by the beginning of the one that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _comparing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``range, ahead, key, text`` in order; a row sent ahead only ends its range."""
    out: list[tuple] = []
    held = None

    def batch_of(rows):
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], NAMES)

    for batch in batches:
        for part, ahead, key, value in zip(*batch.columns, strict=True):
            part, ahead, text = part.as_py(), ahead.as_py(), value.as_py() or ""
            if held is None or held[0] != part:
                if ahead:
                    continue
                held = (part, key.as_py(), text, fingerprint(text.encode()))
                continue
            _, own_key, own, print_ = held
            following = fingerprint(text.encode())
            edited = edit(own, text).encode()
            edited_print = fingerprint(edited)
            out.append(
                (own_key, len(own), hashlib.sha256(edited).hexdigest(), as_text(print_), as_text(edited_print))
                + (likeness(print_, edited_print), likeness(print_, following))
            )
            held = None if ahead else (part, key.as_py(), text, following)
            if len(out) >= ROWS:
                yield batch_of(out)
                out = []
    if out:
        yield batch_of(out)


def compare_with_next(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per row its fingerprint, that of its edited text, and how alike it is to the
    edited text and to the text with the next key (after the last, the first)."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text")).alias("n"), F.min("key").alias("low")).first()
    parts = max(1, -(-(size["n"] or 0) // RANGE_BYTES))
    cuts: list[int] = []
    if parts > 1:
        exact = [F.expr(f"percentile_approx(key, array({','.join(str(i / parts) for i in range(1, parts))}), {20 * parts})")]
        cuts = sorted({c for c in rows.agg(*[e.alias("c") for e in exact]).first()["c"] if c > size["low"]})
    low, last = size["low"], len(cuts)

    @F.pandas_udf("array<int>")
    def ranges(keys: pd.Series) -> pd.Series:
        """Twice the range of a key; for the key at a cut also the range before, plus one."""
        values = keys.to_numpy()
        at = np.searchsorted(cuts, values, "right") if cuts else np.zeros(len(values), np.int64)
        firsts = values == np.array([low, *cuts])[at]
        return pd.Series(
            [[2 * a, 2 * (a - 1 if a else last) + 1] if f else [2 * a] for a, f in zip(at.tolist(), firsts.tolist(), strict=True)]
        )

    dealt = rows.withColumn("_code", F.explode(ranges("key"))).select(
        F.expr("_code div 2").cast("int").alias("part"), F.expr("_code % 2").alias("ahead"), "key", "text"
    )
    ordered = dealt.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "ahead", "key", "text")
    return ordered.mapInArrow(_comparing, COMPARED)
