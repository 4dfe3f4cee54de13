"""Order MinHash against its definition, and the edited and next texts of every row."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import order_minhash as omh
from textloom.llm.words import mix


def brute_kmers(raw):
    seen, out = {}, []
    for i in range(len(raw) - 7):
        value = np.frombuffer(raw[i : i + 8], "<u8")
        n = seen.get(raw[i : i + 8], 0)
        seen[raw[i : i + 8]] = n + 1
        own = mix(value)
        out.append(int((mix(own ^ mix(np.array([n], np.uint64))) if n else own)[0]))
    return out


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=12).map(lambda b: b * 3) | st.text("ab", min_size=8, max_size=60).map(str.encode))
def test_kmers_are_numbered_by_occurrence(raw):
    if len(raw) >= 8:
        assert omh.kmers(raw).tolist() == brute_kmers(raw)


@pytest.mark.parametrize("stride", [3, 50, 1 << 13])
def test_selected_pairs(monkeypatch, stride):
    monkeypatch.setattr(omh, "STRIDE", stride)
    rng = random.Random(stride)
    for size in (8, 9, 10, 40, 400):
        raw = bytes(rng.choices(b"abc ", k=size))
        ids = brute_kmers(raw)
        got = omh.fingerprint(raw)
        for f in range(omh.FUNCTIONS):
            values = [((i >> 32) ^ int(omh._flips[f, 0])) * int(omh._factors[f, 0]) % 2**32 for i in ids]
            order = sorted(range(len(ids)), key=lambda p: (values[p], p))[:2]
            first, second = (min(order), max(order)) if len(ids) > 1 else (0, 0)
            pair = (ids[first] * 3 + int(mix(np.array([ids[second]], np.uint64))[0]) + f) % 2**64
            assert got[f] == int(mix(np.array([pair], np.uint64))[0]) >> 48


def test_order_and_edits_matter():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
    text = " ".join(words)
    swapped = " ".join(words[200:] + words[:200])
    half = " ".join(words[:200] + ["".join(rng.choices("abcdefgh", k=6)) for _ in range(200)])
    one = text.replace(words[7], "zzzzzz", 1)
    f = [omh.fingerprint(t.encode()) for t in (text, one, swapped, half, "other " + "qrs tuv " * 90)]
    near = [omh.likeness(f[0], x) for x in f]
    assert near[0] == 1 and near[1] > 0.8 and near[1] > near[2] > near[4] and near[1] > near[3] > near[4] == 0
    assert omh.likeness(omh.fingerprint(b""), omh.fingerprint(b"")) == 1
    assert omh.likeness(omh.fingerprint(b"a"), omh.fingerprint(b"a\0")) == 0


@pytest.mark.parametrize("size", [200, 1 << 24])
def test_every_row_meets_the_next(spark, monkeypatch, size):
    monkeypatch.setattr(omh, "RANGE_BYTES", size)
    texts = [None, "", "a", "élan " * 9, "漢字" * 21, "word " * 700, "plain text of some length"]
    rows = [(i * 37 % 211 - 40, texts[i % 7]) for i in range(90)] + [(7, "again"), (7, "twice"), (None, "no key")]
    df = spark.createDataFrame(rows, "doc long, text string").withColumn("part", F.lit(0)).repartition(5)
    got = sorted(tuple(r) for r in omh.compare_with_next(df, "doc", "text").collect())
    ordered = sorted((k, t or "") for k, t in rows if k is not None)
    want = []
    for (key, text), (_, following) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        half = len(text) // 2
        edited = (text[: len(text) - half] + following[:half]).encode()
        a, b, c = (omh.fingerprint(x) for x in (text.encode(), edited, following.encode()))
        sha = hashlib.sha256(edited).hexdigest()
        want.append((key, len(text), sha, omh.as_text(a), omh.as_text(b), (a == b).mean(), (a == c).mean()))
    assert got == sorted(want)


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(5, "some words of one text")], "doc long, text string")
    (row,) = omh.compare_with_next(df, "doc", "text").collect()
    assert row["near_next"] == 1
    assert omh.compare_with_next(df.limit(0), "doc", "text").count() == 0
