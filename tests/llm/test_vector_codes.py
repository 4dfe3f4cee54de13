"""Codes against plain loops over all entries, and odd tables."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import vector_codes
from textloom.llm.vector_codes import Book

SMALL = st.integers(-4, 4)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(SMALL, min_size=3, max_size=3), min_size=1, max_size=150), st.lists(st.lists(SMALL, min_size=3, max_size=3), min_size=1, max_size=20))
def test_nearest_is_the_first_of_the_nearest(entries, rows):
    """Many ties, and more entries than a mask has bits."""
    book, rows = Book(np.array(entries)), np.array(rows)
    best, least = book.nearest(rows)
    for i, row in enumerate(rows):
        apart = ((np.array(entries) - row) ** 2).sum(1)
        assert (best[i], least[i]) == (apart.argmin(), apart.min())


def test_candidates_are_few():
    rng = np.random.default_rng(3)
    book = Book(rng.integers(-1000, 1000, (64, 8)))
    rows = book.entries[rng.integers(0, 64, 500)] + rng.integers(-20, 20, (500, 8))
    masks = book.candidates(rows, vector_codes.int_roots(book.distances(rows, book.probe(rows))))
    assert np.bitwise_count(masks).sum() < 0.7 * 500 * 64


def plain(rows, rounds=6, parts=8, n=16):
    """Codes by loops: rows of (key, vector of floats, label)."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[int(np.floor(4096 * float(np.float32(c)))) for c in v] for _, v, _ in rows]
    size = len(x[0])
    out = [["", 0] for _ in rows]
    numbers = []
    for p in range(parts):
        own = [v[p * size // parts : (p + 1) * size // parts] for v in x]
        book = [list(v) for v in own[:n]]
        for turn in range(rounds + 1):
            apart = [[sum((a - b) ** 2 for a, b in zip(v, e, strict=True)) for e in book] for v in own]
            chosen = [d.index(min(d)) for d in apart]
            if turn == rounds:
                break
            for k in range(len(book)):
                mine = [v for v, c in zip(own, chosen, strict=True) if c == k]
                if mine:
                    book[k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        for i, c in enumerate(chosen):
            out[i][0] += f"{c:02x}"
            out[i][1] += apart[i][c]
        numbers += [v for e in book for v in e]
    by_label = {}
    for (_, _, label), (_, error) in zip(rows, out, strict=True):
        by_label[label] = by_label.get(label, 0) + error
    digest = hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()
    return sorted(
        ((key, code, error, by_label[label], digest) for (key, _, label), (code, error) in zip(rows, out, strict=True)), key=str
    )


def got(df):
    return sorted((tuple(r) for r in vector_codes.report(df, "vec_id", "embedding", "label").collect()), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_codes_are_those_of_plain_loops(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(size=16).astype(np.float32).tolist(), [None, 1, 2][int(i) % 3]) for i in rng.permutation(120)]
    rows += rows[:10] + [(None, rows[0][1], 1), (None, rows[1][1], None)]
    rows += [(1000 + i, rows[5][1], 2) for i in range(60)]  # a hot group of copies
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df.repartition(7)) == plain(rows)
    assert got(df.coalesce(1)) == plain(rows)
    assert got(spark.createDataFrame(rows[:5], SCHEMA)) == plain(rows[:5])


def test_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 3), -0.5] * 4, None) for i in range(4)]
    bad = [(9, None, 1), (10, [nan] * 8, 1), (11, [inf] + [0.0] * 7, 1), (12, [None] * 8, 1), (13, [], 1), (14, [1.0], 1)]
    df = spark.createDataFrame(good + bad, SCHEMA)
    for name in ("key", "x", "_x", "k0", "k1", "code", "error", "_label", "label_error", "part"):
        df = df.withColumn(name, F.lit("mine"))
    assert got(df) == plain(good)
    assert got(df.limit(0)) == []
    with pytest.raises(Exception, match="do not fit 64 bits"):
        got(spark.createDataFrame([(1, [1e12] * 8, 1)], SCHEMA))


def test_decoding_gives_the_nearest_entries(spark):
    rows = spark.createDataFrame([(i, [i % 5 * 10, i % 7, 3, -i]) for i in range(40)], "key long, x array<long>")
    books = vector_codes.train(rows, "key", "x", parts=2, entries=8)
    for r in vector_codes.encode(rows, "x", books, ["key", "x"]).collect():
        assert ((vector_codes.decode(r["code"], books) - np.array(r["x"])) ** 2).sum() == r["error"]
