"""Near-copies by brute force over all pairs, and what stays."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import near_copies


def shingle_set(text, k=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)])


def brute(rows):
    sets = {k: shingle_set(t) for k, t in rows}
    label = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if label[b] < label[a] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                    label[a], changed = label[b], True
    return label


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"edit{rng.random()}"
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows = []
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.choice([60, 200, 500]))
        for _ in range(rng.choice([1, 2, 6])):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 0, 1, 2])) if len(base) > 100 else base))
    base = rng.choices(vocabulary, k=400)
    rows += [" ".join(edited(rng, base, 2)) for _ in range(60)]  # one large group of near-copies
    rows += ["", None, " ", "one two", "one  TWO", "one three", "a b c d e", "a b c d e f"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("sweep", "pairwise"), [(8192, 16), (20, 4)])
def test_groups(spark, monkeypatch, sweep, pairwise):
    monkeypatch.setattr(near_copies, "SWEEP", sweep)
    monkeypatch.setattr(near_copies, "PAIRWISE", pairwise)
    rows = corpus(sweep)
    df = spark.createDataFrame(rows, "doc long, text string").withColumn("node", F.lit("clash")).repartition(4)
    got = {r["key"]: r["component"] for r in near_copies.groups(df, "doc", "text").collect()}
    want = brute(rows)
    # nothing is linked that is not alike; nearly all that is alike is linked
    assert got.keys() == want.keys()
    assert all(want[k] == want[c] for k, c in got.items())
    assert sum(got[k] == want[k] for k in want) >= 0.98 * len(want)


def test_rows_that_stay(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(5, text, "x"), (5, text, "x"), (3, text.upper(), "y"), (9, "other words entirely here now", None), (None, "q", "z")]
    df = spark.createDataFrame(rows, "doc long, text string, place string")
    assert sorted(tuple(r) for r in near_copies.deduplicate(df, "doc", "text").collect()) == [(3, text.upper(), "y"), rows[3]]
    assert near_copies.deduplicate(df.limit(0), "doc", "text").count() == 0


def test_prints_move_little():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 400).astype(np.uint64)
    changed = h.copy()
    changed[:3] += np.uint64(1)
    for a, b in zip(near_copies.prints(h), near_copies.prints(changed), strict=True):
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= near_copies.NEAR_BITS
    assert near_copies.prints(h[:0]) == [0] * (near_copies.INDEXED + 1)


def cut_corpus():
    """Pairs of a page and the page with a passage appended, at a similarity just over 0.8."""
    rng, rows = random.Random(7), []
    for n, more in [(100, 23), (300, 70), (60, 10), (30, 4), (10, 1), (1000, 240)]:
        for _ in range(25):
            page = [f"w{rng.random()}" for _ in range(n + more)]
            rows += [" ".join(page), " ".join(page[:n])]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_appended_passages(spark):
    rows = cut_corpus()
    df = spark.createDataFrame(rows, "doc long, text string").repartition(4)
    assert {r["key"]: r["component"] for r in near_copies.groups(df, "doc", "text").collect()} == brute(rows)


def test_parity_is_a_bound():
    rng = np.random.default_rng(1)
    for n in (1, 5, 70, 1000):
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        y = np.concatenate([x[n // 9 :], rng.integers(0, 2**63, n // 4).astype(np.uint64)])
        differ = len(np.setxor1d(x, y))
        assert near_copies.parity_distance(near_copies.parity(x), near_copies.parity(y)) <= differ


def test_links_of_hot_variants_are_linear(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SWEEP", 20)
    nodes = spark.range(400).selectExpr("id AS node", "array(0L, 0L, 0L, 0L) AS prints")
    assert 399 <= near_copies.candidates(nodes).count() <= 400 * near_copies.HUBS


def test_revisions_stay_one_group(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "PAIRWISE", 4)
    rng, rows = random.Random(3), []
    page = [f"w{rng.random()}" for _ in range(300)]
    for _ in range(8):
        rows += [" ".join(edited(rng, page, 1)) for _ in range(20)]
        page = edited(rng, page, 4)
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc long, text string").repartition(4)
    assert {r["key"]: r["component"] for r in near_copies.groups(df, "doc", "text").collect()} == brute(rows)


def test_tables_between_the_steps_go(spark):
    """Of the tables of the search those about links stay, none with prints, shingles or grams."""
    import pathlib

    from textloom.session import shared_folder

    folder = pathlib.Path(shared_folder(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    df = spark.createDataFrame(corpus(3), "doc long, t string")
    near_copies.groups(df, "doc", "t")
    left = [set(spark.read.parquet(str(f)).columns) for f in set(folder.iterdir()) - before]
    assert not [c for c in left if c & {"prints", "shingles", "grams", "gram", "parity", "variant"}]
