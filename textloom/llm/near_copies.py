"""One document of each group of near-copies: SimHash candidates, exact similarity.

Texts are alike when their sets of five-word shingles (words lower-cased, a shorter text
being one shingle) have a Jaccard similarity of 0.8 or more. At that similarity two
64-bit fingerprints differ in too many bits for a guarantee, so links are found in two steps.

First, the index of deletion variants is used several times over: ``INDEXED`` fingerprints
with draws of their own are cut into halves, and texts that agree on a half but for one
bit become candidates if a last, independent fingerprint is near, too. The fingerprints
weigh each word by the root of its count, which moves least bits for a changed word;
candidates are then verified on their shingles. A variant's rows give each node a few
partners (the smallest, the most central and the nearest ones), in variants with more
than ``SWEEP`` nodes a few hubs, never all pairs.

Then ``completed`` finds every link between components that the fingerprints missed: in
any fixed order of all shingles, alike texts share one of their first n/5 + 1.

Equal word sequences are one node.

Defined results: texts without words are copies of each other; the smallest key of a
group stays; of rows that share a key one stays (the first in the order of texts); rows
without a key go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import words
from textloom.llm.components import components
from textloom.llm.simhash import variants
from textloom.llm.tables import discarded, own_column, saved, whole_row

SHINGLE, SIMILARITY = 5, 0.8
INDEXED = 3
NEAR_BITS = 14
SWEEP, PAIRWISE, NEAREST = 8192, 16, 4
SAMPLE, OFTEN, COMMON = 4096, 4, 1 << 17
HUBS, TURNS = 8, 2
ROWS = 512
SHINGLE_BASE, FIRST_BASE, SECOND_BASE = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3
_draws = words.mix(np.arange(1, INDEXED + 2, dtype=np.uint64))


def _raw(texts: pa.Array) -> list[bytes]:
    return [t.lower() for t in pc.fill_null(texts, "").cast(pa.binary()).to_pylist()]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows: what is made of them stays small in a worker."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _texts(batch_texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Number and word hashes of every text."""
    for at, to, of, _, _, hashes in words.word_tables(_raw(batch_texts)):
        bounds = np.searchsorted(of, np.arange(to - at + 1))
        for i in range(to - at):
            yield at + i, hashes[bounds[i] : bounds[i + 1]]


def prints(hashes: np.ndarray) -> list[int]:
    """The fingerprints of a text: per bit, the side with the larger sum of weights."""
    distinct, counts = np.unique(hashes, return_counts=True)
    weights = np.sqrt(counts)
    out = []
    for draw in _draws:
        total = np.zeros(64)
        for at in range(0, len(distinct), 1 << 15):
            drawn = words.mix(distinct[at : at + (1 << 15)] ^ draw)
            bits = np.unpackbits(drawn.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total += weights[at : at + (1 << 15)] @ bits
        out.append(int(np.packbits(total * 2 > weights.sum(), bitorder="little").view("<i8")[0]))
    return out


def shingles(hashes: np.ndarray) -> np.ndarray:
    """The set of shingles as sorted 32-bit hashes."""
    whole = np.array([words.sequence(hashes, SHINGLE_BASE)], np.uint64)
    grams = words.runs(hashes, SHINGLE, SHINGLE_BASE) if len(hashes) >= SHINGLE else whole
    return np.unique((grams >> np.uint64(32)).astype("<u4"))


def ordered_grams(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The distinct shingles as 64-bit hashes in the order of all texts: common ones last."""
    grams = words.runs(hashes, SHINGLE, SHINGLE_BASE)
    if not len(grams):
        grams = np.array([words.sequence(hashes, SHINGLE_BASE)], np.uint64)
    grams = np.unique(grams)
    late = np.zeros(len(grams), bool)
    if len(common):
        late = common[np.minimum(np.searchsorted(common, grams), len(common) - 1)] == grams
    return np.concatenate([grams[~late], grams[late]])


def parity(grams: np.ndarray) -> bytes:
    """Per class of shingles whether their number is odd; about two classes a shingle.

    Sets differ in at least as many shingles as their parities differ in bits."""
    classes = 64 << max(0, (len(grams) // 32 - 1).bit_length())
    odd = np.bincount((grams & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def parity_distance(x: bytes, y: bytes) -> int:
    """Bits in which two parities differ, the longer one folded to the shorter."""
    x, y = (np.frombuffer(z, np.uint8) for z in (x, y))
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, size), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


PRINTED = "key long, h1 long, h2 long, prints array<long>, size long, grams array<long>, parity binary"


def _printing(common: np.ndarray):
    """``grams`` are the first shingles in the common order: of two alike texts these share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            first, second, found, sizes, grams, parities = [], [], [], [], [], []
            for _, hashes in _texts(batch.column(1)):
                first.append(words.sequence(hashes, FIRST_BASE))
                second.append(words.sequence(hashes, SECOND_BASE))
                found.append(prints(hashes))
                every = ordered_grams(hashes, common)
                sizes.append(len(every))
                grams.append(every[: len(every) // 5 + 1].copy().view(np.int64))
                parities.append(parity(every))
            h1, h2 = (pa.array(np.array(h, np.uint64).view(np.int64), pa.int64()) for h in (first, second))
            lists = pa.array(found, pa.list_(pa.int64()))
            columns = [batch.column(0), h1, h2, lists, pa.array(sizes, pa.int64()), pa.array(grams, pa.list_(pa.int64())), pa.array(parities, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "h1", "h2", "prints", "size", "grams", "parity"])

    return run


def _listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.empty(0, np.uint64)
    for batch in batches:
        for _, hashes in _texts(batch.column(1)):
            yield pa.RecordBatch.from_arrays([pa.array(ordered_grams(hashes, none).view(np.int64), pa.int64())], ["gram"])


def common_grams(rows: DataFrame) -> np.ndarray:
    """Shingles that many of a sample of the texts have. Any order of shingles gives the
    same links; with these last, few texts meet for a passage that many have."""
    share = max(1, rows.count() // SAMPLE)
    listed = rows.where(F.pmod(F.xxhash64("key"), F.lit(share)) == 0).mapInArrow(_listing, "gram long")
    often = listed.groupBy("gram").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "gram").limit(COMMON)
    return np.sort(np.array([r["gram"] for r in often.collect()], np.int64).view(np.uint64))


def _partners(node: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: the smallest, the most central and the nearest of those near it."""
    n = len(node)
    a, b = [], []
    totals = np.zeros(n, np.int64)
    step = max(1, (1 << 22) // n)
    for at in range(0, n, step):
        totals[at : at + step] = np.bitwise_count(check[at : at + step, None] ^ check[None, :]).sum(1, dtype=np.int64)
    hubs = np.array([np.argmin(node), np.argmin(totals)])
    for at in range(0, n, step):
        rows = np.arange(at, min(at + step, n))
        apart = np.bitwise_count(check[rows, None] ^ check[None, :]).astype(np.int64)
        apart[np.arange(len(rows)), rows] = 65
        near = np.argpartition(apart * n + np.arange(n), min(NEAREST, n - 1), axis=1)[:, :NEAREST]
        chosen = np.concatenate([near, np.broadcast_to(hubs, (len(rows), 2))], axis=1)
        keep = np.take_along_axis(apart, chosen, 1) <= NEAR_BITS
        a.append(node[np.broadcast_to(rows[:, None], chosen.shape)[keep]])
        b.append(node[chosen[keep]])
    return np.concatenate(a), np.concatenate(b)


def _candidates(key: np.ndarray, node: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs within each run of equal keys."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    small = np.repeat(sizes <= PAIRWISE, sizes)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for step in range(1, PAIRWISE):
        at = np.flatnonzero((key[step:] == key[:-step]) & small[step:])
        if not len(at):
            break
        at = at[np.bitwise_count(check[at] ^ check[at + step]) <= NEAR_BITS]
        a.append(node[at])
        b.append(node[at + step])
    for group in np.flatnonzero(sizes > PAIRWISE):
        inside = slice(starts[group], starts[group] + sizes[group])
        x, y = _partners(node[inside], check[inside])
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


SWEPT = "variant long, a long, b long"
PAIR = -1


def _sweeping(limit: int):
    """Candidates of runs of at most ``limit`` rows; longer runs pass through."""

    def table(variant, a, b) -> pa.RecordBatch:
        columns = [pa.array(np.ascontiguousarray(c), pa.int64()) for c in (variant, a, b)]
        return pa.RecordBatch.from_arrays(columns, ["variant", "a", "b"])

    def settle(rows) -> Iterator[pa.RecordBatch]:
        variant, node, check = rows
        if len(variant) > 1:
            sizes = np.diff(np.concatenate([[0], np.flatnonzero(np.diff(variant)) + 1, [len(variant)]]))
            large = np.repeat(sizes > limit, sizes)
            if large.any():
                yield table(variant[large], node[large], check[large])
                variant, node, check = (c[~large] for c in rows)
            a, b = _candidates(variant, node, check.view(np.uint64))
            if len(a):
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                pairs = pairs[pairs[:, 0] < pairs[:, 1]]
                yield table(np.full(len(pairs), PAIR), pairs[:, 0], pairs[:, 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passing = [np.empty(0, np.int64)] * 3, None
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if passing is not None:
                same = int(np.searchsorted(new[0], passing, "right"))
                yield table(*(c[:same] for c in new))
                new = [c[same:] for c in new]
                passing = passing if not len(new[0]) else None
            held = [np.concatenate([h, n]) for h, n in zip(held, new, strict=True)]
            if not len(held[0]):
                continue
            last = int(np.searchsorted(held[0], held[0][-1], "left"))
            done, held = [h[:last] for h in held], [h[last:] for h in held]
            yield from settle(done)
            if len(held[0]) > limit:
                passing = held[0][0]
                yield table(*held)
                held = [h[:0] for h in held]
        yield from settle(held)

    return run


def _sweep(rows: DataFrame, key: str, limit: int) -> DataFrame:
    sorted_rows = rows.select(key, "node", "bits").repartition(key).sortWithinPartitions(key, "node")
    return saved(sorted_rows.mapInArrow(_sweeping(limit), SWEPT))


def candidates(nodes: DataFrame) -> DataFrame:
    """Distinct pairs ``a < b`` of nodes (``node, prints``) worth verifying."""
    each = nodes.select("node", F.posexplode(F.slice("prints", 1, INDEXED)).alias("n", "_print"), F.col("prints")[INDEXED].alias("check"))
    keyed = variants(each.select(F.struct("node", "n", "check").alias("node"), F.col("_print").alias("bits")))
    rows = keyed.select(
        F.expr("variant | shiftleft(CAST(node.n AS BIGINT), 40)").alias("variant"), F.col("node.node").alias("node"), F.col("node.check").alias("bits")
    )
    swept = _sweep(rows, "variant", SWEEP)
    pairs = swept.where(F.col("variant") == PAIR).select("a", "b")
    hot = swept.where(F.col("variant") != PAIR).select("variant", F.col("a").alias("node"), F.col("b").alias("bits"))
    # what hubs miss is found by the shingles
    least = F.min(F.struct(F.xxhash64("node").alias("_draw"), "node", "bits")).alias("_hub")
    hubs = saved(hot.groupBy("variant", F.pmod(F.xxhash64("node"), F.lit(HUBS))).agg(least))
    near = hot.join(hubs, "variant").where(F.expr(f"node <> _hub.node AND bit_count(bits ^ _hub.bits) <= {NEAR_BITS}"))
    more = near.select(F.least("node", "_hub.node").alias("a"), F.greatest("node", "_hub.node").alias("b"))
    found = saved(pairs.unionByName(more).distinct())
    discarded(swept)
    discarded(hubs)
    return found


def _shingling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        sets = [shingles(h).tobytes() for _, h in _texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])


def _verifying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
            both = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(both >= SIMILARITY * (len(x) + len(y) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose texts are alike."""
    asked = saved(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    texts = rows.join(asked.withColumnRenamed("node", "key"), "key", "left_semi").select("key", "text")
    # the text of a key with several rows: any of them may be the node's, so all are tried
    sets = saved(texts.mapInArrow(_shingling, "node long, shingles binary"))
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    alike = saved(both.mapInArrow(_verifying, "a long, b long"))
    discarded(asked)
    discarded(sets)
    return alike


def shared_grams(nodes: DataFrame) -> DataFrame:
    """``gram, place, node, size, rows`` of the first shingles that several nodes have."""
    each = nodes.select("node", "size", F.posexplode("grams").alias("place", "gram"))
    several = each.groupBy("gram").agg(F.count("*").alias("rows")).where("rows > 1")
    return saved(each.join(several, "gram"))


def _meeting(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of different components that share a shingle and may be alike by their sizes
    and by what can follow their first shared shingle (9 times the overlap is at least 4
    times the sum of the sizes)."""
    other = right.select("gram", *(F.col(c).alias(f"_{c}") for c in ("place", "node", "size", "component")))
    sizes = "5 * least(size, _size) >= 4 * greatest(size, _size) AND 9 * least(size - place, _size - _place) >= 4 * (size + _size)"
    met = left.join(other, "gram").where(f"component <> _component AND {sizes}")
    return met.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()


def _hubs(open_rows: DataFrame, turn: int) -> DataFrame:
    """A few nodes of every shingle, other ones each turn."""
    draw = F.xxhash64("node", F.lit(turn))
    least = F.min(F.struct(draw.alias("_draw"), "place", "node", "size", "component")).alias("_hub")
    return open_rows.groupBy("gram", F.pmod(F.xxhash64("node"), F.lit(HUBS))).agg(least).select("gram", "_hub.*")


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        a, b, sizes, x, y = (c.to_pylist() for c in batch.columns)
        mask = pa.array([9 * parity_distance(*z) <= n for n, *z in zip(sizes, x, y, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def _not_apart(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that differ in at most a ninth of the sum of their sizes, by parity."""
    left = pairs.join(nodes.select(F.col("node").alias("a"), F.col("size").alias("_n"), F.col("parity").alias("x")), "a")
    both = left.join(nodes.select(F.col("node").alias("b"), F.col("size").alias("_m"), F.col("parity").alias("y")), "b")
    return both.select("a", "b", F.expr("_n + _m"), "x", "y").mapInArrow(_apart, "a long, b long").distinct()


def completed(nodes: DataFrame, tested: DataFrame, links: DataFrame, rows: DataFrame) -> DataFrame:
    """``node, component`` once no two components have texts that are alike.

    Alike texts share one of their first shingles. In each turn nodes that share one and
    are of different components are compared: in small groups all of them and in large ones
    each with the hubs, and in the last turn all that are left."""
    met, reached = shared_grams(nodes), components(links)
    for turn in range(TURNS + 1):
        named = met.join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
        named = saved(named if not turn else named.where(F.col("rows") > PAIRWISE))
        several = named.groupBy("gram").agg(F.min("component").alias("_least"), F.max("component").alias("_most")).where("_least < _most")
        open_rows = saved(named.join(several.select("gram"), "gram"))
        discarded(named)
        if open_rows.isEmpty():
            discarded(open_rows)
            break
        if turn == TURNS:
            pairs = _meeting(open_rows, open_rows)
        else:
            large = open_rows.where(F.col("rows") > PAIRWISE)
            pairs = _meeting(large, saved(_hubs(large, turn)))
            if not turn:
                small = open_rows.where(F.col("rows") <= PAIRWISE)
                pairs = pairs.unionByName(_meeting(small, small)).distinct()
        pairs = saved(pairs.join(tested, ["a", "b"], "left_anti"))
        discarded(open_rows)
        tested = tested.unionByName(pairs)
        close = saved(_not_apart(pairs, nodes))
        found = verified(close, rows)
        discarded(close)
        if not found.isEmpty():
            links = links.unionByName(found)
            reached = components(links)
    discarded(met)
    return reached


def groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, component`` of every distinct key: the smallest key of its group."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull())
    printed = saved(rows.mapInArrow(_printing(common_grams(rows)), PRINTED))
    kept = [F.first(c).alias(c) for c in ("prints", "size", "grams", "parity")]
    nodes = saved(printed.groupBy("h1", "h2").agg(F.min("key").alias("node"), *kept))
    pairs = candidates(nodes)
    reached = completed(nodes, pairs, verified(pairs, rows), rows)
    named = saved(nodes.join(reached, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component")))
    told = saved(printed.join(named, ["h1", "h2"]).groupBy("key").agg(F.min("component").alias("component")))
    for table in (printed, nodes, pairs, named):
        discarded(table)
    return told


def deduplicate(df: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``df`` that stay, one of each group."""
    kept = groups(df, key, text).where(F.col("key") == F.col("component")).select("key")
    rows = df.select(whole_row(df), F.col(key).cast("long").alias("key")).join(kept, "key", "left_semi")
    place = F.row_number().over(Window.partitionBy("key").orderBy(own_column(text)))
    return rows.withColumn("place", place).where("place = 1").select(*[own_column(c) for c in df.columns])
