"""Removal of repeated passages against the definition."""

import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import substrings, words


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, window=50):
    first = {}
    for key, text in rows:
        w = split(text)
        for i in range(len(w) - window + 1):
            s = tuple(w[i : i + window])
            first[s] = min(first.get(s, key), key)
    out = []
    for key, text in rows:
        w = split(text)
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < key:
                keep[i : i + window] = [False] * window
        kept = " ".join(x for x, k in zip(w, keep, strict=True) if k)
        out.append((key, len(w), keep.count(False), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aé \n\x0b\x1c b"), max_size=30), max_size=6), st.integers(2, 40))
def test_words_of_slices(texts, size):
    before, words.SLICE = words.SLICE, size
    try:
        raw = [t.encode() for t in texts]
        got = {i: [] for i in range(len(texts))}
        hashes = {}
        for at, _, of, starts, ends, h in words.word_tables(raw):
            for i, s, e, x in zip(of.tolist(), starts.tolist(), ends.tolist(), h.tolist(), strict=True):
                word = raw[at + i][s:e]
                got[at + i].append(word)
                assert hashes.setdefault(word, x) == x
        assert [got[i] for i in range(len(texts))] == [r.split() for r in raw]
        assert len(set(hashes.values())) == len(hashes)
    finally:
        words.SLICE = before


def test_runs_and_minima():
    h = words.mix(np.arange(1, 200, dtype=np.uint64))
    twice = np.concatenate([h, h])
    runs = words.runs(twice, 7, substrings.PHRASE_BASE)
    assert (runs[: 199 - 6] == runs[199:]).all() and len(set(runs.tolist())) == 199
    for n in (1, 2, 5, 41):
        assert words.sliding_min(h, n).tolist() == [min(h[i : i + n].tolist()) for i in range(len(h) - n + 1)]


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(300)]

    def prose(n):
        return rng.choices(vocabulary, k=n)

    shared = [prose(n) for n in (49, 50, 51, 70, 200)]
    rows = []
    for key in range(120):
        parts = [prose(rng.choice([0, 5, 60, 300]))]
        for _ in range(rng.choice([0, 1, 3])):
            passage = rng.choice(shared)
            if rng.random() < 0.3:
                passage = passage[rng.randrange(20) :]
            parts += [passage, prose(rng.choice([0, 7]))]
        rows.append((key * 3 + 1, rng.choice([" ", "\n", "  "]).join(w for p in parts for w in p)))
    texts = [t for _, t in rows]
    rows += [(2, texts[50]), (500, texts[3]), (501, texts[3].replace(" ", "\n")), (0, None), (3, ""), (5, " \n ")]
    rows += [(600, "a " * 130), (601, "a " * 90), (602, " ".join(shared[4] * 2)), (603, " ".join(shared[4]))]
    rows += [(603, " ".join(shared[4])), (700, "x" * 9000 + " end")]
    return rows


def test_kept_words(spark):
    rng = random.Random(11)
    rows = corpus(rng)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc long, text string").withColumn("key", F.lit("x")).repartition(6)
    got = sorted(tuple(r) for r in substrings.remove_repeats(df, "doc", "text").collect())
    assert got == brute(rows)
    texts = {r["key"]: r for r in substrings.remove_repeats(df, "doc", "text", with_text=True).collect()}
    by_key = dict(rows)
    for key, r in texts.items():
        if r["n_removed"] == 0:
            assert r["text"] == (by_key[key] or "")
        else:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"]


def test_versions_of_one_key_and_missing_keys(spark):
    rng = random.Random(2)
    a, b = ([str(rng.random()) for _ in range(120)] for _ in range(2))
    rows = [(1, " ".join(a)), (2, " ".join(b[:30] + a[10:80])), (2, " ".join(b)), (None, " ".join(a))]
    df = spark.createDataFrame(rows, "doc long, text string")
    got = sorted(tuple(r) for r in substrings.remove_repeats(df, "doc", "text").collect())
    assert got == brute(rows[:3])
    assert substrings.remove_repeats(df.limit(0), "doc", "text").count() == 0


def test_tables_between_the_steps_go(spark):
    import pathlib

    from textloom.session import shared_folder

    folder = pathlib.Path(shared_folder(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, text), (2, "x " + text)], "doc long, t string")
    out = substrings.remove_repeats(df, "doc", "t")
    assert len(set(folder.iterdir()) - before) == 1
    assert {r["key"]: r["n_removed"] for r in out.collect()} == {1: 0, 2: 80}
