"""SentencePiece encoding and decoding over a lattice of pieces.

A text gets a dummy space in front and its spaces become ``▁``; as no piece has that mark
after another character, it falls apart into *units* (a run of marks and what follows), which
are encoded on their own. The lattice of a unit has an edge for every substring that is a
piece. It is built relationally: bounded-length substrings, an equality join with the piece
table, edges grouped by unit; then a fold over it gives the ids.

The fold depends on the kind of model. A unigram model takes the path with the largest sum
of scores (Viterbi). A BPE model defines its result by merges, highest score first, and the
best path is another one for many words, so there the fold replays the merges on the edges.

``encode_units`` does all this with DataFrame functions, folds by ``aggregate``. Documents
are encoded in two steps: the most frequent units (``COMMON``, a bounded table) that way,
once; the rest, which are too many to join back to every place they occur, in the tasks by
``Lattice``, the same join and fold on numpy arrays, with a bounded cache.

Defined results: a null or empty text has no ids; characters without a piece become byte
pieces; ids that are no piece decode to nothing, bytes that are no UTF-8 to U+FFFD.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.tables import saved
from textloom.llm.words import mix, powers

MARK = "▁"
COMMON = 50_000
CACHE_UNITS, CACHE_CHARS, LONG_UNIT = 600_000, 64, 200
LATTICE_CHARS = 200_000
CHAR_BASE = 0x9FB21C651E98DF25


@dataclass
class Pieces:
    """A model: pieces by id with their scores, byte pieces apart."""

    texts: list[str]  # empty for control, unknown and byte pieces
    scores: list[float]
    bytes_: list[int]  # ids of the byte pieces
    is_bpe: bool

    @classmethod
    def from_file(cls, path: str) -> Pieces:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            spec = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        plain = spec.normalizer_spec
        if plain.precompiled_charsmap or plain.remove_extra_whitespaces or not plain.add_dummy_prefix:
            raise ValueError("only models without normalisation and with a dummy prefix")
        n = processor.get_piece_size()
        odd = [processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) for i in range(n)]
        texts = ["" if odd[i] else processor.id_to_piece(i) for i in range(n)]
        if any(MARK in t.lstrip(MARK) for t in texts):
            raise ValueError("a piece has a space after another character")
        bytes_ = [processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        scores = [processor.get_score(i) for i in range(n)]
        return cls(texts, scores, bytes_, spec.trainer_spec.model_type == 2)

    @property
    def longest(self) -> int:
        return max(map(len, self.texts))

    def priority(self) -> np.ndarray:
        """Rank of each piece by falling score, the smaller id first."""
        rank = np.empty(len(self.texts), np.int64)
        rank[np.lexsort((np.arange(len(self.texts)), -np.array(self.scores)))] = np.arange(len(self.texts))
        return rank

    def spelled(self, char: str, found: dict[str, int]) -> list[int]:
        """Ids of a character: its piece, or its bytes."""
        return [found[char]] if char in found else [self.bytes_[b] for b in char.encode("utf-8", "surrogatepass")]

    def byte_strings(self) -> list[bytes]:
        out = [t.replace(MARK, " ").encode() for t in self.texts]
        for b, i in enumerate(self.bytes_):
            out[i] = bytes([b])
        return out


def units(text: str) -> list[str]:
    """The units of a text; all but the first without the mark they start with."""
    parts = text.replace(MARK, " ").split(" ")
    out: list[str] = []
    marks = 0
    for part in parts:
        if part == "":
            marks += 1
        else:
            out.append(MARK * marks + part if marks else part)
            marks = 0
    if marks:
        out.append(MARK * (marks - 1))
    return out


# --- DataFrame form -----------------------------------------------------------------


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """``piece, id, score, rank``; as many rows as the vocabulary."""
    rank = pieces.priority()
    rows = [(t, i, float(pieces.scores[i]), int(rank[i])) for i, t in enumerate(pieces.texts) if t]
    return spark.createDataFrame(rows, "piece string, id int, score double, rank long")


def lattice(words: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """``unit, n, edges``: all substrings of each distinct ``unit`` that are pieces."""
    starts = words.select("unit", F.length("unit").alias("n"), F.explode(F.sequence(F.lit(1), F.length("unit"))).alias("start"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.col("n") - F.col("start") + 1))
    cut = starts.select("unit", "n", "start", F.explode(sizes).alias("size")).withColumn(
        "piece", F.col("unit").substr(F.col("start"), F.col("size"))
    )
    # the vocabulary is bounded; single characters without a piece stay as edges without id
    met = cut.join(F.broadcast(table), "piece", "left").where(F.col("id").isNotNull() | (F.col("size") == 1))
    edge = F.struct("start", "size", "id", "score", "rank", F.when(F.col("id").isNull(), F.col("piece")).alias("odd"))
    return met.groupBy("unit", "n").agg(F.array_sort(F.collect_list(edge)).alias("edges"))


def _viterbi() -> Column:
    """The best path: per end the best sum of scores and the edge that reaches it. A
    character without a piece costs ten less than the least score."""
    worst = F.array_min(F.transform("edges", lambda e: F.coalesce(e["score"], F.lit(0.0)))) - 10
    start = F.array(F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at")))

    def step(best: Column, end: Column) -> Column:
        into = F.filter("edges", lambda e: e["start"] + e["size"] == end + 1)
        scored = F.transform(
            into,
            lambda e: F.struct((F.element_at(best, e["start"])["sum"] + F.coalesce(e["score"], worst)).alias("sum"), (e["start"] - 1).alias("at")),
        )
        return F.concat(best, F.array(F.array_max(scored)))

    best = F.aggregate(F.sequence(F.lit(1), F.col("n")), start, step)
    back = F.aggregate(
        F.sequence(F.lit(1), F.col("n")),
        F.array(F.col("n")),
        lambda path, _: F.when(path[0] > 0, F.concat(F.array(F.element_at(best, path[0] + 1)["at"]), path)).otherwise(path),
    )
    return back


def _merges() -> Column:
    """Cuts after replaying the merges: again and again the neighbours whose union is
    the piece of the least rank, the first of them on ties, become one."""
    ranks = F.map_from_entries(
        F.transform(
            F.filter("edges", lambda e: (e["size"] > 1) & e["id"].isNotNull()),
            lambda e: F.struct((e["start"] - 1) * 1024 + e["size"], e["rank"]),
        )
    )

    def step(cuts: Column, _: Column) -> Column:
        inner = F.slice(cuts, 2, F.greatest(F.size(cuts) - 2, F.lit(0)))
        scored = F.filter(
            F.transform(
                inner,
                lambda c, i: F.struct(F.element_at(ranks, cuts[i] * 1024 + cuts[i + 2] - cuts[i]).alias("rank"), c.alias("cut")),
            ),
            lambda s: s["rank"].isNotNull(),
        )
        least = F.array_min(scored)
        return F.when(F.size(scored) > 0, F.array_remove(cuts, least["cut"])).otherwise(cuts)

    return F.aggregate(F.sequence(F.lit(1), F.col("n")), F.sequence(F.lit(0), F.col("n")), step)


def encode_units(words: DataFrame, spark: SparkSession, pieces: Pieces) -> DataFrame:
    """``unit, ids`` of a table with a column ``unit`` of distinct, non-empty units."""
    edges = lattice(words, piece_table(spark, pieces), pieces.longest)
    cut = edges.withColumn("_cuts", _merges() if pieces.is_bpe else _viterbi())
    spans = F.transform(
        F.slice("_cuts", 1, F.size("_cuts") - 1),
        lambda c, i: F.filter("edges", lambda e: (e["start"] == c + 1) & (e["size"] == F.col("_cuts")[i + 1] - c))[0],
    )
    by_byte = F.array(*[F.lit(i) for i in pieces.bytes_])
    spelled = F.transform(
        spans,
        lambda e: F.when(e["id"].isNotNull(), F.array(e["id"])).otherwise(
            F.transform(
                F.sequence(F.lit(1), F.octet_length(e["odd"])),
                lambda k: F.get(by_byte, F.conv(F.substring(F.hex(F.encode(e["odd"], "utf-8")), 2 * k - 1, F.lit(2)), 16, 10).cast("int")),
            )
        ),
    )
    return cut.select("unit", F.flatten(spelled).alias("ids"))


# --- the same on arrays -------------------------------------------------------------


class Lattice:
    """Units against the piece table, many at a time."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.found = {t: i for i, t in enumerate(pieces.texts) if t}
        self.rank = pieces.priority()
        self.ids_by_rank = np.argsort(self.rank)
        hashes = np.array([self._hash(t) for t in self.found], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(list(self.found.values()))[order]
        self.longest = pieces.longest

    @staticmethod
    def _prefix(codes: np.ndarray) -> np.ndarray:
        power, _ = powers(CHAR_BASE, len(codes) + 1)
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix(codes.astype(np.uint64)) * power[:-1], out=total[1:])
        return total

    @classmethod
    def _hash(cls, text: str) -> int:
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        return int(cls._prefix(codes)[-1])

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of non-empty units."""
        out: list[list[int]] = [[]] * len(texts)
        held, size = [], 0
        for i, text in enumerate(texts):
            if len(text) > LONG_UNIT:
                out[i] = self._one(text)
                continue
            held.append(i)
            size += len(text)
            if size >= LATTICE_CHARS:
                self._many(texts, held, out)
                held, size = [], 0
        if held:
            self._many(texts, held, out)
        return out

    def _edges(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rank of the piece at each place and of each size, or a very large number."""
        n = len(codes)
        total = self._prefix(codes)
        _, inverse = powers(CHAR_BASE, n + 1)
        ranks = np.full((n, self.longest + 1), np.iinfo(np.int64).max)
        for size in range(1, self.longest + 1):
            at = np.flatnonzero(np.arange(n) + size <= ends)
            if not len(at):
                break
            hashes = (total[at + size] - total[at]) * inverse[at]
            place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[place] == hashes
            ranks[at[hit], size] = self.rank[self.ids[place[hit]]]
        return ranks

    def _many(self, texts: list[str], which: list[int], out: list[list[int]]) -> None:
        joined = "".join(texts[i] for i in which)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.array([len(texts[i]) for i in which])
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        of = np.repeat(np.arange(len(which)), lengths)
        ranks = self._edges(codes, bounds[of + 1])
        starts = self._merge(ranks, of) if self.pieces.is_bpe else self._best(ranks, bounds)
        sizes = np.diff(np.concatenate([starts, [len(codes)]]))
        chosen = ranks[starts, sizes]
        known = chosen < np.iinfo(np.int64).max
        ids = np.where(known, self.ids_by_rank[np.where(known, chosen, 0)], -1).tolist()
        cut = np.searchsorted(starts, bounds).tolist()
        odd = set(np.unique(of[starts[~known]]).tolist())
        for n, i in enumerate(which):
            own = ids[cut[n] : cut[n + 1]]
            if n in odd:
                places = starts[cut[n] : cut[n + 1]]
                own = [x for p, k in zip(places, own, strict=True) for x in ([k] if k >= 0 else self.pieces.spelled(joined[p], self.found))]
            out[i] = own

    def _merge(self, ranks: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Starts of the symbols left when no neighbours merge; one merge a unit and round."""
        never = np.iinfo(np.int64).max
        starts, done = np.arange(len(of)), []
        ends = starts + 1
        unit = of
        while len(starts) > 1:
            together = np.full(len(starts), never)
            size = ends[1:] - starts[:-1]
            able = np.flatnonzero((unit[1:] == unit[:-1]) & (size <= self.longest))
            together[able] = ranks[starts[able], size[able]]
            first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            least = np.minimum.reduceat(together, first)
            group = np.cumsum(np.concatenate([[0], (unit[1:] != unit[:-1]).astype(np.int64)]))
            active = least[group] < never
            done.append(starts[~active])
            hits = np.flatnonzero(active & (together == least[group]))
            _, one = np.unique(group[hits], return_index=True)
            left = hits[one]
            ends[left] = ends[left + 1]
            keep = active
            keep[left + 1] = False
            starts, ends, unit = starts[keep], ends[keep], unit[keep]
        done.append(starts)
        return np.sort(np.concatenate(done))

    def _best(self, ranks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Starts of the pieces of the best path of every unit."""
        scores = np.array(self.pieces.scores)[self.ids_by_rank]
        starts = []
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = ranks[low:high]
            known = own[own < np.iinfo(np.int64).max]
            worst = min(scores[known].min() if len(known) else 0.0, 0.0) - 10
            best, back = [0.0], [0]
            for end in range(1, high - low + 1):
                options = []
                for size in range(1, min(self.longest, end) + 1):
                    rank = own[end - size, size]
                    if rank < np.iinfo(np.int64).max or size == 1:
                        score = scores[rank] if rank < np.iinfo(np.int64).max else worst
                        options.append((best[end - size] + score, end - size))
                top = max(options)
                best.append(top[0])
                back.append(top[1])
            at = high - low
            while at:
                at = back[at]
                starts.append(low + at)
        return np.sort(np.array(starts, np.int64))

    def _one(self, text: str) -> list[int]:
        """A long unit by a queue of merges."""
        if not self.pieces.is_bpe:
            out = [[]]
            self._many([text], [0], out)
            return out[0]
        n = len(text)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue: list[tuple[int, int, int]] = []

        def offer(at: int) -> None:
            if at >= 0 and after[at] < n:
                end = after[after[at]]
                i = self.found.get(text[at:end]) if end - at <= self.longest else None
                if i is not None:
                    heapq.heappush(queue, (int(self.rank[i]), at, end))

        for at in range(n - 1):
            offer(at)
        while queue:
            _, at, end = heapq.heappop(queue)
            if not alive[at] or after[at] >= n or after[after[at]] != end:
                continue
            gone = after[at]
            alive[gone] = False
            after[at] = end
            if end < n:
                before[end] = at
            offer(before[at])
            offer(at)
        out, at = [], 0
        while at < n:
            piece = text[at : after[at]]
            out += [self.found[piece]] if piece in self.found else self.pieces.spelled(piece, self.found)
            at = after[at]
        return out


class Encoder:
    """Texts through a cache of units."""

    def __init__(self, pieces: Pieces, common: dict[str, bytes]):
        self.lattice, self.common = Lattice(pieces), common
        self.cache = dict(common)

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [units(t) if t else [] for t in texts]
        cache = self.cache
        used = {u for own in cut for u in own}
        missing = list(used.difference(cache))
        ids = self.lattice.encode([MARK + u for u in missing])
        cache.update(zip(missing, (np.array(i, "<u4").tobytes() for i in ids), strict=True))
        out = [b"".join([cache[u] for u in own]) for own in cut]
        for unit in missing:
            if len(unit) > CACHE_CHARS:
                del cache[unit]
        if len(cache) > CACHE_UNITS + len(self.common):
            # the common units and what the last texts used stay
            self.cache = self.common | {u: cache[u] for u in used if u in cache}
        return out


def decode(ids: np.ndarray, strings: list[bytes]) -> str:
    """The text of ids, without the dummy space."""
    text = b"".join([strings[i] for i in ids.tolist() if 0 <= i < len(strings)]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def common_units(rows: DataFrame, text: str, limit: int = COMMON) -> DataFrame:
    """The most frequent units of a corpus, counted over all of it: those that occur so
    often that at most ``limit`` units occur as often. The bound comes from a table of
    counts per count, so no task ever holds a share of every other task's units."""
    words = rows.select(F.explode(F.split(F.translate(F.col(text), MARK, " "), " ")).alias("unit"))
    counts = words.where(F.length("unit").between(1, CACHE_CHARS)).groupBy("unit").agg(F.count("*").alias("n"))
    repeated = saved(counts.where(F.col("n") > 1))
    sizes = repeated.groupBy("n").agg(F.count("*").alias("m"))
    running = F.sum("m").over(Window.orderBy(F.desc("n")))
    least = sizes.withColumn("r", running).where(F.col("r") <= limit).agg(F.min("n").alias("n")).first()["n"]
    kept = repeated.where(F.col("n") >= least) if least is not None else repeated.limit(0)
    return kept.select(F.concat(F.lit(MARK), "unit").alias("unit"))


_encoders: dict[int, Encoder] = {}


def _encoding(pieces: Pieces, common: dict[str, bytes], with_ids: bool):
    token = zlib.crc32("".join(pieces.texts).encode()) ^ zlib.crc32(b"".join(common.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _encoders:
            _encoders.clear()
            _encoders[token] = Encoder(pieces, common)
        encoder, strings = _encoders[token], pieces.byte_strings()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= 4_000_000):
                    size += len(texts[to])
                    to += 1
                found = encoder.encode(texts[at:to])
                ids = [np.frombuffer(raw, "<u4") for raw in found]
                columns = [
                    batch.column(0).slice(at, to - at),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([zlib.crc32(raw) for raw in found], pa.int64()),
                    pa.array([hashlib.sha256(decode(i, strings).encode("utf-8", "surrogatepass")).hexdigest() for i in ids], pa.string()),
                ]
                names = ["key", "n_ids", "ids_crc32", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([i.tolist() for i in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
                at = to

    return run


ENCODED = "key long, n_ids long, ids_crc32 long, decoded_sha256 string"


def encode(df: DataFrame, key: str, text: str, pieces: Pieces, with_ids: bool = False) -> DataFrame:
    """Per row the number of ids, the CRC-32 of the ids as little-endian unsigned 32-bit
    integers, the SHA-256 of the text decoded from them and, on request, the ids."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    frequent = saved(common_units(rows, "text"))
    encoded = encode_units(frequent, df.sparkSession, pieces).collect()  # at most COMMON short rows
    common = {r["unit"][1:]: np.array(r["ids"], "<u4").tobytes() for r in encoded}
    return rows.mapInArrow(_encoding(pieces, common, with_ids), ENCODED + (", ids array<int>" if with_ids else ""))
