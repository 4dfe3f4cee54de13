"""Extendible hashing and best-fit packing against plain loops."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import best_fit, sharding
from textloom.llm.tables import word_count


def bits(key) -> int:
    return int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:15], 16)


def brute_shards(rows, limit):
    """Split a bucket on one more bit while it is too large and holds two hashes."""
    out, todo = {}, [(0, list(rows))]
    while todo:
        depth, rows = todo.pop()
        if sum(b for _, b in rows) > limit and len({bits(k) for k, _ in rows}) > 1:
            for bit in (0, 1):
                inside = [r for r in rows if (bits(r[0]) >> (59 - depth)) & 1 == bit]
                if inside:
                    todo.append((depth + 1, inside))
        elif rows:
            prefix = bits(rows[0][0]) >> (60 - depth) if depth else 0
            out[format(prefix, f"0{depth}b") if depth else ""] = sorted(rows, key=str)
    return out


def test_shards_equal_splitting_by_hand(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 5, 40, 300, 5000])) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, n long").withColumn("bytes", F.lit("clash"))
    got = {}
    for r in sharding.assign_shards(df, "k", F.col("n"), 2500).collect():
        got.setdefault(r["shard"], []).append((r["k"], r["bytes"]))
        assert r["page"] == 0 or r["bytes"] > 2500
    assert {s: sorted(v, key=str) for s, v in got.items()} == brute_shards(rows, 2500)


def test_one_key_with_most_rows_is_cut_into_pages(spark):
    rows = [(7, 30)] * 500 + [(7, 900)] * 3 + [(i, 10) for i in range(100, 150)] + [(None, None)]
    df = spark.createDataFrame(rows, "k long, n long").repartition(3)
    out = sharding.assign_shards(df, "k", F.col("n"), 1000).collect()
    assert sorted((r["k"], r["bytes"]) for r in out if r["k"] is not None) == sorted(rows[:-1])
    sums = {}
    for r in out:
        sums.setdefault((r["shard"], r["page"]), []).append(r)
    for part in sums.values():
        assert sum(r["bytes"] for r in part) <= 1000
        assert {r["shard_bytes"] for r in part} == {sum(r["bytes"] for r in part)}


def test_no_rows(spark):
    empty = spark.createDataFrame([], "k long, n long")
    assert sharding.assign_shards(empty, "k", F.col("n"), 10).count() == 0
    text = spark.createDataFrame([(1, None), (2, "")], "k long, t string")
    assert best_fit.pack(text, "k", word_count(F.col("t"))).count() == 0


def brute_bins(lengths, sizes, cost):
    """Best-fit decreasing, piece by piece; the size opened is chosen per length."""
    bins = []  # [size, used, contents]
    top = max(sizes)
    below = [sum(n for n in lengths if n <= limit) for limit in range(top + 1)]
    for length in sorted(set(lengths), reverse=True):
        left = lengths.count(length)
        size = None
        while left:
            fitting = [b for b in bins if b[0] - b[1] >= length]
            if not fitting:
                if size is None:
                    size = best_fit.best_size(length, left, below, sizes, cost)
                bins.append([size, 0, []])
                fitting = [bins[-1]]
            target = min(fitting, key=lambda b: b[0] - b[1])
            target[1] += length
            target[2].append(length)
            left -= 1
    return sorted((min(s for s in sizes if s >= b[1]), tuple(b[2])) for b in bins)


def expand(groups, sizes):
    out = []
    for g in groups:
        contents = tuple(length for length, _, k, _ in g.runs for _ in range(k))
        out += [(min(s for s in sizes if s >= g.used), contents)] * g.n
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=60), st.sampled_from([(8, 16, 24), (24,), (6, 24)]))
def test_plan_is_best_fit_decreasing(lengths, sizes):
    counts = {n: lengths.count(n) for n in lengths}

    def cost(n):
        return n * (1 + n / 20)

    groups = best_fit.plan_bins(counts, sizes, cost)
    assert expand(groups, sizes) == brute_bins(lengths, sizes, cost)


@pytest.mark.parametrize("bucket_rows", [7, 100_000])
def test_placements_fill_bins_without_overlap(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(best_fit, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 3, 3, 9, 20, 41, 70]))) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, t string").withColumn("rank", F.lit("clash"))
    sizes = (8, 16, 32)
    placed = best_fit.pack(df, "k", word_count(F.col("t")), sizes).collect()
    words = {k: len(t.split()) for k, t in rows}
    covered = {}
    bins = {}
    for r in placed:
        covered.setdefault(r["k"], []).append((r["start"], r["n_words"]))
        bins.setdefault(r["seq_id"], []).append(r)
    assert {k for k, n in words.items() if n} == set(covered)
    for k, spans in covered.items():
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at == words[k]
    for contents in bins.values():
        at = 0
        for r in sorted(contents, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["n_words"]
        assert {(r["used"], r["capacity"]) for r in contents} == {(at, min(s for s in sizes if s >= at))}
    assert sorted(bins) == list(range(len(bins)))
    lengths = [r["n_words"] for r in placed]
    shapes = sorted(
        (c[0]["capacity"], tuple(sorted((r["n_words"] for r in c), reverse=True))) for c in bins.values()
    )
    assert shapes == brute_bins(lengths, sizes, best_fit.training_cost)


def test_sequences_hold_the_words(spark):
    rows = [(1, "a  b\nc"), (2, "d e f g h"), (3, None), (4, " ")]
    df = spark.createDataFrame(rows, "k long, t string")
    placed = best_fit.pack(df, "k", word_count(F.col("t")), (4, 8))
    out = best_fit.sequences(df, placed, "k", "t").collect()
    assert sorted(w for r in out for w in r["text"].split()) == list("abcdefgh")
    assert sum(len(r["ks"]) for r in out) == placed.count()
    for r in out:
        assert len(r["text"].split()) == r["used"] <= r["capacity"]


def test_of_equal_rooms_the_bin_opened_first_is_filled():
    lengths, sizes = [1, 3, 6, 19], (8, 16, 24)
    cost = lambda n: n * (1 + n / 20)
    groups = best_fit.plan_bins({n: 1 for n in lengths}, sizes, cost)
    assert expand(groups, sizes) == brute_bins(lengths, sizes, cost) == [(8, (6,)), (24, (19, 3, 1))]
