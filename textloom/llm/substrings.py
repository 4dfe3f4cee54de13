"""Removal of repeated passages, found by automata over recurring phrases.

A word goes if a window of 50 words around it also starts in a document with a smaller
key. Work is kept to where documents repeat:

1. Documents with equal word sequences are one; the later copies go as a whole.
2. *Seeds*: of every 41 neighbouring 10-word phrases of a document the one with the least
   hash. Two documents with a common window share a seed of it, whatever its place.
3. Seeds of more than one document recur; each document gets its recurring ones.
4. Documents with recurring seeds are streamed through Aho-Corasick automata over word
   numbers. A shard is a slice of documents; its automaton holds the recurring phrases
   of these documents, so its size is bounded by the slice, not by the corpus.
5. Every window around an occurrence is confirmed by the 128-bit hash of its words: it
   repeats if the smallest document that has it is smaller than its own. Hashes are
   pre-aggregated before they are shuffled, so a passage of very many documents is one row
   per task.

Defined results: a null text has no words; documents under 50 words lose nothing; rows
with equal key and text are judged alike and do not remove each other; rows without a
key are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.llm import words
from textloom.llm.tables import discarded, saved, whole_row

WINDOW, PHRASE = 50, 10
PHRASE_BASE, FIRST_BASE, SECOND_BASE = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3
#: A mark is the start of a repeated window, with 15 bits of the document's hash above.
PLACE_BITS = 48
WHOLE = (1 << PLACE_BITS) - 1


def _raw(texts: pa.Array) -> list[bytes]:
    return pc.fill_null(texts, "").cast(pa.binary()).to_pylist()


def _longs(values) -> pa.Array:
    return pa.array(np.ascontiguousarray(values, dtype=np.uint64).view(np.int64), pa.int64())


def _tag(first_hash: int) -> int:
    return (first_hash & 0x7FFF) << PLACE_BITS


def _per_text(of: np.ndarray, n: int) -> np.ndarray:
    """Where the words of each text begin, and the end."""
    return np.searchsorted(of, np.arange(n + 1))


SEEDED = "key long, n_words long, h1 long, h2 long, seeds array<long>"


def _seeding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = _raw(batch.column(1))
        for at, to, of, _, _, hashes in words.word_tables(raw):
            bounds = _per_text(of, to - at)
            least = words.sliding_min(words.runs(hashes, PHRASE, PHRASE_BASE), WINDOW - PHRASE + 1)
            seeds, sizes, first, second = [], [], [], []
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                own = least[low : max(low, high - WINDOW + 1)]
                own = own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
                seeds.append(own)
                sizes.append(len(own))
                first.append(words.sequence(hashes[low:high], FIRST_BASE))
                second.append(words.sequence(hashes[low:high], SECOND_BASE))
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), _longs(np.concatenate(seeds))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, to - at), pa.array(np.diff(bounds), pa.int64()), _longs(first), _longs(second), lists],
                ["key", "n_words", "h1", "h2", "seeds"],
            )


def _occurrences(numbers: np.ndarray, phrase_at: np.ndarray) -> np.ndarray:
    """Starts of every occurrence of the phrases that start at ``phrase_at``."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for at in phrase_at.tolist():
        automaton.add_word(tuple(numbers[at : at + PHRASE].tolist()))
    automaton.make_automaton()
    ends = [end for end, _ in automaton.iter(tuple(numbers.tolist()))]
    return np.array(ends, dtype=np.int64) - PHRASE + 1


LOCATED = "w1 long, w2 long, key long, mark long"


def _locating(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0).to_numpy()
        raw, lists = _raw(batch.column(1)), batch.column(2)
        for at, to, of, _, _, hashes in words.word_tables(raw):
            known = np.unique(lists.slice(at, to - at).flatten().to_numpy().view(np.uint64))
            phrases = words.runs(hashes, PHRASE, PHRASE_BASE)
            same = of[: len(phrases)] == of[PHRASE - 1 :]
            recurring = np.flatnonzero(np.isin(phrases, known) & same)
            _, one_each = np.unique(phrases[recurring], return_index=True)
            if not len(one_each):
                continue
            numbers = np.unique(hashes, return_inverse=True)[1]
            # a number of its own between texts keeps phrases inside them
            gaps = np.flatnonzero(np.diff(of)) + 1
            spaced = np.insert(numbers, gaps, len(numbers))
            shift = np.searchsorted(gaps, np.arange(len(numbers)), "right")
            found = _occurrences(spaced, (recurring + shift[recurring])[one_each])
            starts = found - np.searchsorted(gaps + np.arange(len(gaps)), found, "left")
            if len(hashes) < WINDOW:
                continue
            marked = np.zeros(len(hashes) + 1, np.int64)
            marked[starts + 1] = 1
            before = np.cumsum(marked)
            n = len(hashes) - WINDOW + 1
            held = before[WINDOW - PHRASE + 1 :][:n] > before[:n]
            windows = np.flatnonzero(held & (of[:n] == of[WINDOW - 1 :]))
            bounds = _per_text(of, to - at)
            tags = np.array(
                [_tag(words.sequence(hashes[a:b], FIRST_BASE)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.int64
            )
            text = of[windows]
            yield pa.RecordBatch.from_arrays(
                [
                    _longs(words.runs(hashes, WINDOW, FIRST_BASE)[windows]),
                    _longs(words.runs(hashes, WINDOW, SECOND_BASE)[windows]),
                    pa.array(keys[at:to][text], pa.int64()),
                    pa.array(tags[text] | (windows - bounds[text]), pa.int64()),
                ],
                ["w1", "w2", "key", "mark"],
            )


KEPT = "key long, n_words long, n_removed long, kept_sha256 string"


def _removing(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, lists = _raw(batch.column(1)), batch.column(2)
            for at, to, of, starts, ends, hashes in words.word_tables(raw):
                bounds = _per_text(of, to - at)
                removed, digests, texts = [], [], []
                for i in range(at, to):
                    low, high = bounds[i - at], bounds[i - at + 1]
                    keep = np.ones(high - low, bool)
                    if lists[i].is_valid:
                        marks = lists[i].values.to_numpy()
                        tag = _tag(words.sequence(hashes[low:high], FIRST_BASE))
                        places = marks[(marks & ~WHOLE) == tag] & WHOLE
                        if (places == WHOLE).any():
                            keep[:] = False
                        else:
                            change = np.zeros(high - low + 1, np.int64)
                            np.add.at(change, places, 1)
                            np.add.at(change, places + WINDOW, -1)
                            keep = np.cumsum(change[:-1]) == 0
                    if keep.all():
                        kept = b" ".join(raw[i].split())
                    else:
                        kept = b" ".join(np.array(raw[i].split(), dtype=object)[keep].tolist())
                    removed.append(len(keep) - int(keep.sum()))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        texts.append(kept if removed[-1] else raw[i])
                columns = [
                    batch.column(0).slice(at, to - at),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(digests, pa.string()),
                    *(c.slice(at, to - at) for c in batch.columns[3:]),
                ]
                names = ["key", "n_words", "n_removed", "kept_sha256", *batch.schema.names[3:]]
                if with_text:
                    columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def repeated(rows: DataFrame) -> DataFrame:
    """``key, marks`` of the documents in ``rows`` (``key, text``) that lose words."""
    seeded = saved(rows.mapInArrow(_seeding, SEEDED))
    long_enough = seeded.where(F.col("n_words") >= WINDOW)
    # aggregates that meet many rows of one key are tables of their own, so that Spark
    # can split such a key in the join
    first = saved(long_enough.groupBy("h1", "h2").agg(F.min("key").alias("first")))
    judged = long_enough.join(first, ["h1", "h2"])
    tag = F.shiftleft(F.col("h1").bitwiseAND(0x7FFF), PLACE_BITS)
    copies = judged.where(F.col("key") > F.col("first")).select("key", tag.bitwiseOR(F.lit(WHOLE)).alias("mark"))
    seeds = saved(judged.where(F.col("key") == F.col("first")).select("key", F.explode("seeds").alias("seed")))
    recurring = saved(
        seeds.groupBy("seed").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("seed")
    )
    phrases = seeds.join(recurring, "seed").groupBy("key").agg(F.collect_set("seed").alias("phrases"))
    windows = saved(rows.join(phrases, "key").select("key", "text", "phrases").mapInArrow(_locating, LOCATED))
    source = saved(
        windows.groupBy("w1", "w2").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").drop("high")
    )
    marks = windows.join(source, ["w1", "w2"]).where(F.col("key") > F.col("low")).select("key", "mark")
    lost = saved(copies.unionByName(marks).groupBy("key").agg(F.collect_list("mark").alias("marks")))
    for table in (seeded, first, seeds, recurring, windows, source):
        discarded(table)
    return lost


def remove_repeats(df: DataFrame, key: str, text: str, with_text: bool = False, with_row: bool = False) -> DataFrame:
    """``key, n_words, n_removed, kept_sha256`` of every row; on request its other columns
    as one, ``row``, and ``text``: the kept words joined by one space, or the text as it
    was where none was removed."""
    others = [whole_row(df, key, text)] if with_row and len(df.columns) > 2 else []
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), *others)
    rows = rows.where(F.col("key").isNotNull())
    marked = rows.join(repeated(rows.select("key", "text")), "key", "left")
    marked = marked.select("key", "text", "marks", *(["row"] if others else []))
    schema = StructType.fromDDL(KEPT)
    for field in marked.schema.fields[3:]:
        schema = schema.add(field)
    if with_text:
        schema = schema.add("text", "string")
    return marked.mapInArrow(_removing(with_text), schema)
