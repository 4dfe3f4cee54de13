"""Base spans against the patterns as given, learning from contexts, and masking."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from textloom.llm import contextual_pii as pii

GIVEN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def stands(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in GIVEN.items()
        for m in re.finditer(pattern, text or "", re.ASCII)
        if stands(kind, m[0])
    ]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def check_base(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").withColumn("kind", F.lit("clash"))
    out = {r["key"]: r for r in pii.report(df.repartition(3), "doc", "text").collect()}
    assert len(out) == len(texts)
    for i, text in enumerate(texts):
        want = brute(text)
        assert out[i]["base_sha256"] == hashlib.sha256(joined(want).encode()).hexdigest(), (text, want, out[i]["spans"])
        assert [out[i][f"n_{k}"] for k in GIVEN] == [sum(s[0] == k for s in want) for k in GIVEN]
        spans = out[i]["spans"].split(",") if out[i]["spans"] else []
        assert set(joined(want).split(",") if want else []) <= set(spans) and len(spans) == len(want) + out[i]["n_added"]


def test_base_spans(spark):
    rng = random.Random(6)
    texts = [None, "", "no data", "é漢\U0001f600 x.y@mail-1.example.com. 10.0.0.1, 4111 1111 1111 1111; +49 (30) 1234-567."]
    texts += ["a@b.c.@d.e", "a@b_c@d.e", "..a@b.c@d.e.f@g.h", "@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.000.1.007", "1.2.3.999.1.1.1"]
    texts += ["4012-8888 8888-1881 7", "1--2 3  4 5", "+1 + 1 +1-2(3)4.5 6 7 8)", "+1 (988) 555-2485 +44 20 7946 0958", "++123456789"]
    texts += ["7" * 30_000, "a." * 20_000 + "@x", "a@" + "b." * 20_000 + "c", "+1" + "(" * 20_000 + "2", "1." * 20_000, "x" * 50_000 + "@y.z"]
    alphabet = ["a", "Z", "@", ".", "-", "1", "22", "+", " ", "(", ")", "%", "4111111111111111", "é", "\n", "10.1.2.3", "_"]
    texts += ["".join(rng.choices(alphabet, k=rng.randrange(1, 40))) for _ in range(600)]
    check_base(spark, texts)


def test_contexts_bring_in_what_the_patterns_miss(spark):
    rng = random.Random(8)
    rows = []
    for i in range(30):
        rows.append(f"noise w{i} reach me under user{i}@mail.example.com please")
        rows.append(f"calls go to phone: +1 (555) 010-{1000 + i} daily w{i}")
        rows.append(f"random w{i} number {rng.randrange(10**6)} in text, chapter {i}")
    rows += ["reach me under root@localhost please", "calls go to phone: 555 010 7777 daily", "see chapter 555 010 7777 there"]
    rows += ["chapter 12", "reach me under 17 please"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc long, text string")
    out = {r["key"]: r for r in pii.report(df, "doc", "text").collect()}
    assert out[90]["spans"] == "email:15:29" and out[91]["spans"] == "phone:19:31"
    assert out[92]["spans"] == "phone:12:24"  # a core once learned is found everywhere
    assert [out[i]["spans"] for i in (93, 94)] == ["", ""]
    assert sum(r["n_added"] for r in out.values()) == 3
    text = {r["doc"]: r["text"] for r in pii.masked(df, "doc", "text").collect()}
    assert text[90] == "reach me under <EMAIL> please" and text[91] == "calls go to phone: <PHONE> daily"
    assert text[0] == "noise w0 reach me under <EMAIL> please" and text[93] == rows[93]


def test_masking_merges_overlaps_and_keeps_rows(spark):
    rows = [(1, "a1.2.3.4@x.y 10.0.0.1, é +4111111111111111x", "k"), (1, "a1.2.3.4@x.y 10.0.0.1, é +4111111111111111x", "k"), (2, None, None), (None, "10.0.0.1", "q")]
    df = spark.createDataFrame(rows, "doc long, text string, key string")
    out = [tuple(r) for r in pii.masked(df, "doc", "text").collect()]
    assert sorted(out, key=str) == sorted(
        [(1, "<EMAIL> <IP>, é +<CARD>x", "k")] * 2 + [(2, None, None), (None, "10.0.0.1", "q")], key=str
    )
    assert pii.report(df.limit(0), "doc", "text").count() == 0
    assert len(pii.report(df, "doc", "text").collect()) == 3
