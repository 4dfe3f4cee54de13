"""Near-duplicate links between SimHash fingerprints by deletion variants.

A 64-bit fingerprint is cut into two halves. If two fingerprints differ in at most
two bits (three, even), one half differs in at most one, so the two agree on that half
with one bit left out. Each fingerprint is indexed under its 2 x 32 one-wildcard
halves; rows with equal keys meet in an equality shuffle and are verified.

Equal fingerprints are one node, and a key's rows yield a spanning forest of links,
never all pairs: in one sweep over the sorted rows of a task while the key has at most
``SWEEP`` fingerprints, and beyond that through two-bit variants of the remaining bits,
whose groups hold at most four fingerprints, all within two bits of each other.

Defined results: a text without words (null, empty, blank) has the fingerprint zero and
is linked like any other; rows without a key are left out; repeated rows share their
node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.components import components
from textloom.llm.tables import saved

SEED = 42
MAX_BITS = 2
SWEEP = 8192
PAIRWISE = 16
SPAN_BYTES = 4_000_000
WHITE = b" \t\n\v\f\r"


def spans(raw: bytes, size: int = SPAN_BYTES) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes, cut at white space."""
    at = 0
    while len(raw) - at > size:
        cut = max(raw.rfind(bytes([c]), at + 1, at + size) for c in WHITE)
        if cut < 0:
            ends = [e for e in (raw.find(bytes([c]), at + size) for c in WHITE) if e > at]
            if not ends:
                break
            cut = min(ends)
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def shingle_hashes(raw: bytes, k: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of the k-word shingles, in parts; of the whole sequence if it is shorter."""
    carried: list[bytes] = []
    any_hash = False
    for part in spans(raw.lower()):
        words = carried + part.split()
        if len(words) < k:
            carried = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        pairs = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
        digest = xxhash.xxh64_intdigest
        yield np.fromiter((digest(joined[a:b], seed) for a, b in pairs), "<u8", len(words) - k + 1)
        any_hash = True
        carried = words[len(words) - k + 1 :]
    if not any_hash and carried:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carried), seed)], "<u8")


def majority(parts: Iterator[np.ndarray]) -> int:
    """The fingerprint: bits set in over half the hashes; zero without any."""
    counts, total = np.zeros(64, np.int64), 0
    for part in parts:
        for at in range(0, len(part), 1 << 16):
            cut = np.ascontiguousarray(part[at : at + (1 << 16)])
            counts += np.unpackbits(cut.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += len(cut)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def _fingerprinting(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = pc.fill_null(batch.column(1), "").cast(pa.binary())
            values = [majority(shingle_hashes(text.as_py(), k)) for text in raw]
            found = pa.array(np.array(values, dtype="<u8").view("<i8"), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["key", "fingerprint"])

    return run


def fingerprints(df: DataFrame, key: str, text: str, k: int = 3) -> DataFrame:
    """``key, fingerprint`` (the 64 bits as a long) of every whole text."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull())
    return rows.mapInArrow(_fingerprinting(k), "key long, fingerprint long")


def variants(nodes: DataFrame) -> DataFrame:
    """``variant, node, bits``: the one-wildcard halves of ``bits``.

    A variant is the number of the half and of the bit left out, then the half."""
    rows = nodes.select("node", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    half = F.expr("IF(i < 32, bits, shiftrightunsigned(bits, 32)) & 4294967295L")
    kept = half.bitwiseAND(F.expr("~shiftleft(1L, i % 32)"))
    return rows.select(F.expr("shiftleft(CAST(i AS BIGINT), 32)").bitwiseOR(kept).alias("variant"), "node", "bits")


def _near(x: np.ndarray, i: np.ndarray | int, max_bits: int) -> np.ndarray:
    """Differences that count for variant number ``i``: small enough, and in the bit
    left out unless that is the first one, so that equal halves count once."""
    differs = (x >> np.asarray(i).astype(np.uint64)) & np.uint64(1)
    return (np.bitwise_count(x) <= max_bits) & ((differs == 1) | (np.asarray(i) % 32 == 0))


def _forest(bits: np.ndarray, i: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of one variant's rows, breadth first."""
    left = np.arange(len(bits))
    a, b = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _near(bits[left] ^ bits[at], i, max_bits)
            found = left[near]
            a.append(np.full(len(found), at))
            b.append(found)
            queue += found.tolist()
            left = left[~near]
    return np.concatenate(a or [np.empty(0, np.int64)]), np.concatenate(b or [np.empty(0, np.int64)])


def _links(variant: np.ndarray, node: np.ndarray, bits: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal variants."""
    edges = np.flatnonzero(np.diff(variant)) + 1
    starts = np.concatenate([[0], edges])
    sizes = np.diff(np.concatenate([starts, [len(variant)]]))
    a, b = [], []
    small = np.repeat(sizes <= PAIRWISE, sizes)
    for step in range(1, PAIRWISE):
        at = np.flatnonzero((variant[step:] == variant[:-step]) & small[step:])
        if not len(at):
            break
        at = at[_near(bits[at] ^ bits[at + step], variant[at] >> 32, max_bits)]
        a.append(node[at])
        b.append(node[at + step])
    for group in np.flatnonzero(sizes > PAIRWISE):
        inside = slice(starts[group], starts[group] + sizes[group])
        x, y = _forest(bits[inside], int(variant[starts[group]] >> 32), max_bits)
        a.append(node[inside][x])
        b.append(node[inside][y])
    return np.concatenate(a or [np.empty(0, np.int64)]), np.concatenate(b or [np.empty(0, np.int64)])


SWEPT = "variant long, a long, b long"
NO_VARIANT = -1


def _sweeping(max_bits: int):
    """Links of complete runs; the rows of a longer run pass through as they are."""

    def rows(variant, a, b) -> pa.RecordBatch:
        columns = [pa.array(np.ascontiguousarray(c), pa.int64()) for c in (variant, a, b)]
        return pa.RecordBatch.from_arrays(columns, ["variant", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        passing = None
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if passing is not None:
                same = int(np.searchsorted(new[0], passing, "right"))
                yield rows(*(c[:same] for c in new))
                new = [c[same:] for c in new]
                if not len(new[0]):
                    continue
                passing = None
            held = [np.concatenate([h, n]) for h, n in zip(held, new, strict=True)]
            if not len(held[0]):
                continue
            last = int(np.searchsorted(held[0], held[0][-1], "left"))
            done, held = [h[:last] for h in held], [h[last:] for h in held]
            yield from finish(done)
            if len(held[0]) > SWEEP:
                passing = held[0][0]
                yield rows(*held)
                held = [h[:0] for h in held]
        yield from finish(held)

    def finish(done) -> Iterator[pa.RecordBatch]:
        variant, node, bits = done
        if len(variant) > 1:
            sizes = np.diff(np.concatenate([[0], np.flatnonzero(np.diff(variant)) + 1, [len(variant)]]))
            large = np.repeat(sizes > SWEEP, sizes)
            if large.any():
                yield rows(variant[large], node[large], bits[large])
                variant, node, bits = (c[~large] for c in done)
            a, b = _links(variant, node, bits.view(np.uint64), max_bits)
            if len(a):
                yield rows(np.full(len(a), NO_VARIANT), a, b)

    return run


def _hot_links(rows: DataFrame, max_bits: int) -> DataFrame:
    """Links of variants with very many fingerprints: what is left free are the bit
    out and the other half, 33 bits; fingerprints within two bits of each other agree
    once the two bits are left out as well."""
    if max_bits != 2:
        raise ValueError("two-bit variants link at two bits")
    free = rows.withColumn(
        "_other", F.expr("IF(variant < shiftleft(32L, 32), shiftrightunsigned(bits, 32), bits & 4294967295L)")
    ).withColumn("_own", F.expr("shiftrightunsigned(bits, CAST(shiftrightunsigned(variant, 32) AS INT)) & 1L"))
    free = free.withColumn("_free", F.expr("_other | shiftleft(_own, 32)"))
    pairs = F.expr("flatten(transform(sequence(0, 31), i -> transform(sequence(i + 1, 32), j -> shiftleft(1L, i) | shiftleft(1L, j))))")
    cut = free.select("variant", "node", "_free", F.explode(pairs).alias("_out")).select(
        "variant", "node", "_out", F.expr("_free & ~_out").alias("_kept")
    )
    groups = cut.groupBy("variant", "_out", "_kept").agg(F.array_sort(F.collect_list("node")).alias("_nodes"))
    return groups.where(F.size("_nodes") > 1).select(
        F.col("_nodes")[0].alias("a"), F.explode(F.expr("slice(_nodes, 2, 3)")).alias("b")
    )


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``a, b`` that join all nodes (distinct ``bits``) within ``max_bits``."""
    keyed = variants(nodes).repartition("variant").sortWithinPartitions("variant", "node")
    swept = saved(keyed.mapInArrow(_sweeping(max_bits), SWEPT))
    direct = swept.where(F.col("variant") == NO_VARIANT).select("a", "b")
    hot = swept.where(F.col("variant") != NO_VARIANT).select("variant", F.col("a").alias("node"), F.col("b").alias("bits"))
    return direct.unionByName(_hot_links(hot, max_bits))


def groups(df: DataFrame, key: str, text: str, k: int = 3) -> DataFrame:
    """``key, fingerprint, component`` of every row: texts linked at two or fewer
    differing bits, directly or through others, share the smallest key among them."""
    prints = saved(fingerprints(df, key, text, k))
    nodes = saved(prints.groupBy(F.col("fingerprint").alias("bits")).agg(F.min("key").alias("node")))
    reached = components(links(nodes))
    labels = nodes.join(reached, "node", "left").select(
        F.col("bits").alias("fingerprint"), F.coalesce("component", "node").alias("component")
    )
    return prints.join(labels, "fingerprint").select("key", "fingerprint", "component")
