"""Counts against a loop, codes, decoding, and accuracy on held-out documents."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import language, queries

DOCS = "/root/testdata/sf0.01"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBé 1\n漢İ") | st.characters(codec="utf-8"), max_size=20), min_size=1, max_size=5))
def test_counts_of_parts_do_not_mix(parts):
    counts, letters = language.gram_counts(parts)
    for i, part in enumerate(parts):
        alone, n = language.gram_counts([part])
        assert (alone[0] == counts[i]).all() and n[0] == letters[i]
        low = [c if c.isalpha() else " " for c in part.lower() + " "]
        grams = ["".join(low[j : j + k]) for k in (1, 2, 3) for j in range(len(low) - k + 1)]
        assert counts[i].sum() == sum(1 for g in grams if g.strip(" "))
        assert letters[i] == sum(c.isalpha() for c in part.lower())


@pytest.mark.parametrize("n", [1, 2, 4, 7, 8, 30])
def test_codewords_differ(n):
    code = language.codewords(n)
    assert len({tuple(r) for r in code.tolist()}) == n
    if n > 1:
        apart = min((a != b).sum() for i, a in enumerate(code) for b in code[:i])
        assert apart >= (1 if n == 2 else 2 ** (n - 2) if n <= 7 else 5)


def test_one_wrong_bit_is_corrected():
    rng = np.random.default_rng(0)
    counts = {f"l{i}": rng.integers(0, 1000, language.BUCKETS) ** 2 for i in range(4)}
    model = language.fit(counts)
    for i, name in enumerate(model.languages):
        best, chance, second = model.decide(counts[name][None, :])
        assert best[0] == i and chance[0] > 0.8 > second[0]
        for bit in range(model.code.shape[1]):
            wrong = language.Model(model.languages, model.code, model.weights.copy(), model.trust)
            wrong.weights[:, bit] *= -0.5
            assert wrong.decide(counts[name][None, :])[0][0] == i


def test_defined_results(spark, monkeypatch):
    rows = [(None, "en"), ("", "en"), ("12 !?", "en"), ("the cat and the hat " * 30, "en"), ("der hut und die katze " * 30, "de")]
    rows += [("THE CAT", None), ("x" * 50, None), ("the hat " * 20_000, None)]
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], "id long, text string, lang string")
    df = df.withColumn("score", F.lit("clash")).repartition(3)
    model = language.train(df, "text", "lang")
    for part in (1 << 20, 1000):
        monkeypatch.setattr(language, "PART", part)
        out = {r["id"]: r for r in language.predict(df, "text", model, {"id": F.col("id")}).collect()}
        assert [out[i]["lang_pred"] for i in range(8)][:6] == ["und", "und", "und", "en", "de", "en"]
        assert out[7]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in out.values())
        assert [out[i]["score"] for i in range(3)] == [0, 0, 0]
    none = language.predict(df, "text", language.train(df.limit(0), "text", "lang"), {"id": F.col("id")}).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert language.predict(df.limit(0), "text", model, {"id": F.col("id")}).count() == 0


def test_a_mix_of_two_languages_is_ambiguous(spark):
    rng = random.Random(1)
    a = " ".join(rng.choices("ab bc cd de".split(), k=500))
    b = " ".join(rng.choices("vw wx xy yz".split(), k=500))
    df = spark.createDataFrame([(0, a, "one"), (1, b, "two"), (2, a + " " + b, None)], "id long, text string, lang string")
    out = {r["id"]: r for r in language.predict(df, "text", language.train(df, "text", "lang"), {"id": F.col("id")}).collect()}
    assert out[2]["ambiguous"] and not out[0]["ambiguous"] and not out[1]["ambiguous"]


def test_held_out_accuracy(spark):
    out = queries.QUERIES["op2_language_codes"](spark, DOCS)
    truth = spark.read.parquet(f"{DOCS}/documents.parquet").select("doc_id", "lang")
    rows = out.where("held_out").join(truth, "doc_id").collect()
    right = Counter(r["lang"] == r["lang_pred"] for r in rows)
    assert right[True] >= 0.97 * len(rows)
