"""The index against brute force: footrule, answers, recall, copies and odd vectors."""

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import permutation_index as index
from textloom.llm import queries


def brute(rows, top, is_query):
    sound = [
        (i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)
    ]
    out = {}
    for q, v in sound:
        if is_query(q):
            ranked = sorted((-float(np.dot(v, w)), i) for i, w in sound if i != q)
            out[q] = [(i, -s) for s, i in ranked[:top]]
    return out


def collect(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_agreement_orders_by_footrule():
    rng = np.random.default_rng(0)
    prefix, pivots = 5, 12
    found = np.array([rng.permutation(pivots)[:prefix] for _ in range(60)], np.int16)
    files = index.InvertedFiles(found, pivots)
    ranks = np.full((60, pivots), prefix)
    np.put_along_axis(ranks, found.astype(np.int64), np.arange(prefix)[None, :].repeat(60, 0), 1)
    for q in range(60):
        footrule = np.abs(ranks - ranks[q]).sum(1)
        # sum of both prefixes' distances to "absent", less twice what is shared
        assert (footrule == prefix * (prefix + 1) - 2 * files.agreement(found[q])).all()


def test_exact_when_all_are_reranked(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 40)
    monkeypatch.setattr(index, "QUERIES", 10)
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(150)]
    rows += [(200 + i, [1.0] * 6) for i in range(120)]  # one very common vector
    rows += [(400, None), (401, [0.0] * 6), (402, [1.0, None, 2.0, 0.0, 0.0, 1.0]), (403, [float("nan")] + [1.0] * 5)]
    rows += [(404, [float("inf")] + [1.0] * 5), (405, []), (406, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "v long, e array<double>").withColumn("vector", F.lit("x")).repartition(5)
    got = collect(index.search(df, "v", "e", F.col("id") % 4 == 0, top=7))
    want = brute([r for r in rows if r[0] != 406], 7, lambda i: i % 4 == 0)
    assert got.keys() == want.keys()
    for q, answer in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in answer]
        assert np.allclose([s for _, s in got[q]], [s for _, s in answer])


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (20, [0.5, 1.0])], "v long, e array<float>")
    got = collect(index.search(df, "v", "e", F.col("id") % 20 == 0))
    assert [i for i, _ in got[0]] == [1, 20] and [i for i, _ in got[20]] == [1, 0]
    assert index.search(df.limit(0), "v", "e", F.col("id") % 20 == 0).count() == 0


def test_recall_with_production_parameters(spark):
    folder = "/root/testdata/sf0.1"
    got = collect(queries.QUERIES["op1_permutation_index"](spark, folder).withColumnRenamed("vec_id", "id"))
    table = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = brute([(r[0], r[1]) for r in table], 20, lambda i: i % 20 == 0)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
