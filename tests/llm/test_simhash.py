"""Fingerprints, links and components against plain loops."""

import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import simhash
from textloom.llm.components import components


def brute_fingerprint(text, k=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if label[b] < label[a] and linked(a, b):
                    label[a], changed = label[b], True
    return label


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aBÉ \n\x0b\x1c x")), st.integers(8, 20))
def test_fingerprint(text, span):
    whole = simhash.majority(simhash.shingle_hashes(text.encode(), 3))
    assert whole == brute_fingerprint(text)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("ab \n"), max_size=60), st.integers(1, 9))
def test_spans_keep_words(text, size):
    parts = [w for p in simhash.spans(text.encode(), size) for w in p.split()]
    assert parts == text.encode().split()


def near_prints(rng, n):
    """Clusters of fingerprints a few bits apart, and strangers."""
    out = set()
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 3, 40])):
            out.add(base)
            for _ in range(rng.choice([1, 2, 3])):
                base ^= 1 << rng.randrange(64)
    return sorted(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize(("sweep", "pairwise"), [(8192, 16), (8192, 2), (3, 2)])
def test_links_reach_what_all_pairs_reach(spark, monkeypatch, sweep, pairwise):
    monkeypatch.setattr(simhash, "SWEEP", sweep)
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    prints = near_prints(random.Random(sweep + pairwise), 250)
    dense = 0x0123456789ABCDEF
    prints = sorted({*prints, *(dense ^ (1 << b) for b in range(64)), *(dense ^ (3 << b) for b in range(32))})
    nodes = {i: p for i, p in enumerate(prints)}
    df = spark.createDataFrame([(i, signed(p)) for i, p in nodes.items()], "node long, bits long")
    links = simhash.links(df)
    for a, b in links.collect():
        assert (nodes[a] ^ nodes[b]).bit_count() <= 2
    got = {r["node"]: r["component"] for r in components(links).collect()}
    want = brute_components(list(nodes), lambda a, b: (nodes[a] ^ nodes[b]).bit_count() <= 2)
    assert {n: got.get(n, n) for n in nodes} == want


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (100, 95), (90, 90), (95, 100)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "x long, y long")).collect()}
    assert got == {i: 0 for i in range(61)} | {90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_groups_of_texts(spark):
    rng = random.Random(1)
    base = " ".join(rng.choices("lorem ipsum dolor sit amet elit sed".split(), k=400))
    texts = [None, "", " \n", "one", "ONE", "one two", base, base.upper(), base + " tail", *["same text of all"] * 40]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(50, base), (50, base), (None, base)]
    df = spark.createDataFrame(rows, "doc long, text string").withColumn("node", F.lit(0)).repartition(4)
    out = simhash.groups(df, "doc", "text").collect()
    assert len(out) == len(rows) - 1
    prints = {i: brute_fingerprint(t) for i, t in rows if i is not None}
    want = brute_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    for r in out:
        assert r["fingerprint"] & ((1 << 64) - 1) == prints[r["key"]]
        assert r["component"] == want[r["key"]]
    assert simhash.groups(df.limit(0), "doc", "text").count() == 0


def test_stars_are_not_walked_again(spark, monkeypatch):
    from textloom.llm import components as module

    written = []
    monkeypatch.setattr(module, "saved", lambda df, saved=module.saved: written.append(1) or saved(df))
    stars = [(1, 2), (3, 1), (7, 8), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(stars, "x long, y long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7} and len(written) == 1
