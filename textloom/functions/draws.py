"""Keyed random draws.

Every random choice is a pure function of a seed and the keys of the row it
belongs to, so results do not depend on partitioning, task retries or the
number of executors. A row gets its seed from one md5; the draws for the
elements of an array come from cheap integer mixing of (seed, index), which
gives the same numbers in Spark expressions and in numpy.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.arrays import let

MODULUS = 2147483647  # 2**31 - 1, products of two residues fit a signed 64-bit integer
STEP = 1000003
ROUND_1, ROUND_2, ROUND_3 = 1103515245, 1597334677, 1812433253
SHIFT_1, SHIFT_2 = 15, 13


def seed(*keys) -> Column:
    """A seed in [0, MODULUS) for the given keys (columns or plain values)."""
    parts = [k if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % MODULUS


def uniform(*keys) -> Column:
    """A draw in (0, 1) for the given keys."""
    return (seed(*keys) + F.lit(0.5)) / F.lit(float(MODULUS))


def mix(seed_col: Column, indexes: Column) -> Column:
    """Draws in [0, MODULUS), one for each integer of the array ``indexes``."""
    h = let(
        seed_col,
        lambda s: F.transform(indexes, lambda i: (s + i.cast("bigint") * STEP) % MODULUS * ROUND_1 % MODULUS),
    )
    h = F.transform(h, lambda x: x.bitwiseXOR(F.shiftright(x, SHIFT_1)) * ROUND_2 % MODULUS)
    return F.transform(h, lambda x: x.bitwiseXOR(F.shiftright(x, SHIFT_2)) * ROUND_3 % MODULUS)


def mix_numpy(seed_value: int, indexes: np.ndarray) -> np.ndarray:
    """The same draws as :func:`mix`, for use inside Arrow batches."""
    h = (seed_value + indexes.astype(np.int64) * STEP) % MODULUS * ROUND_1 % MODULUS
    h = (h ^ (h >> SHIFT_1)) * ROUND_2 % MODULUS
    return (h ^ (h >> SHIFT_2)) * ROUND_3 % MODULUS


def to_unit(draw):
    """Integer draw to (0, 1); works on columns and on numpy arrays."""
    if isinstance(draw, Column):
        return (draw + F.lit(0.5)) / F.lit(float(MODULUS))
    return (draw + 0.5) / float(MODULUS)
