"""Whitening against exact sums and eigenvectors of the covariance, and odd tables."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import whitening
from textloom.llm.vectors import finite, floored


def table(spark, x, parts=5):
    rows = [(i, [int(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x array<long>").repartition(parts)


def data(n=300, size=6, seed=1):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, size)) @ rng.normal(size=(size, size)) * 40
    return np.floor(mixed).astype(np.int64) + 1_000_000


def centred(x):
    """Rows less their mean, rounded once."""
    means = [Fraction(int(s), len(x)) for s in x.sum(0)]
    return np.array([[float(int(v) - m) for v, m in zip(r, means, strict=True)] for r in x])


def components_of(x, squared):
    """Eigenvalues and -vectors of the covariance, from it or, more exactly, from the rows."""
    if squared:
        values, axes = np.linalg.eigh(centred(x).T @ centred(x) / len(x))
        return values[::-1], axes[:, ::-1]
    _, singular, axes = np.linalg.svd(centred(x), full_matrices=False)
    return singular**2 / len(x), axes.T


def compared(spark, x, k, squared=True):
    rows = {}
    for r in whitening.report(table(spark, x), "id", "x", k).collect():
        rows.setdefault(r["key"], {})[r["component"]] = r
    values, axes = components_of(x, squared)
    n = len(x)
    assert sorted(rows) == list(range(n))
    for key, of in rows.items():
        assert sorted(of) == list(range(1, k + 1))
        deviation = sum((n * int(v) - int(s)) ** 2 for v, s in zip(x[key], x.sum(0), strict=True))
        assert {(r["n"], r["deviation"]) for r in of.values()} == {(n, deviation)}
    got = np.array([[rows[i][c]["whitened"] for c in range(1, k + 1)] for i in range(n)])
    want = centred(x) @ axes[:, :k] / np.sqrt(values[:k])
    want *= np.sign((got * want).sum(0))
    np.testing.assert_allclose(got, want, atol=1e-6)
    np.testing.assert_allclose([rows[0][c]["explained"] for c in range(1, k + 1)], values[:k] / values.sum(), rtol=1e-6)
    errors = {r["identity_error"] for of in rows.values() for r in of.values()}
    assert len(errors) == 1 and errors.pop() < 1e-6


def test_components_are_those_of_the_covariance(spark):
    compared(spark, data(), 6)
    compared(spark, data(seed=2), 3)


def test_badly_conditioned_rows(spark):
    x = data(400, 5)
    wide = (x - 1_000_000) * np.array([1, 1, 100, 1, 5000]) + 1_000_000
    wide[:, 1] = wide[:, 0] + np.arange(400) % 2  # nearly the same
    compared(spark, wide, 5, squared=False)


def test_dimensions_without_variance_have_no_component(spark):
    x = data(200, 4)
    x[:, 1] = 7
    x[:, 3] = x[:, 0] + x[:, 2]
    rows = whitening.report(table(spark, x), "id", "x", 32).collect()
    assert {r["component"] for r in rows} == {1, 2} and len(rows) == 400
    assert rows[0]["identity_error"] < 1e-9
    total = sum({r["component"]: r["explained"] for r in rows}.values())
    assert total == pytest.approx(1)


def test_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    given = [(1, [0.5, 0.1]), (1, [0.5, 0.1]), (None, [0.2, -0.3]), (2, None), (3, [nan, 0.0]), (4, [inf, 0.0]),
             (5, [None, 0.0]), (6, []), (7, [1.0]), (8, [-0.7, 0.9])]
    df = spark.createDataFrame(given, "vec_id int, embedding array<float>").select(
        "*", *[F.lit("mine").alias(c) for c in ("key", "x", "n", "deviation", "whitened", "component", "part", "values")]
    )
    rows = df.where(finite(F.col("embedding"))).select("vec_id", floored(F.col("embedding"), 64, 1_000_000).alias("x"))
    got = whitening.report(rows, "vec_id", "x", 32).collect()
    assert sorted((r["key"] is None, r["key"] or 0) for r in got) == sorted(2 * [(False, 1), (False, 1), (True, 0), (False, 8)])
    assert {r["n"] for r in got} == {4}
    same = df.withColumn("embedding", F.expr("array(1.0f, 2.0f)")).select("vec_id", floored(F.col("embedding"), 64).alias("x"))
    assert whitening.report(same, "vec_id", "x", 32).collect() == []
    for none in (same.limit(0), same.limit(1)):
        assert whitening.report(none, "vec_id", "x", 32).collect() == []


def test_sums_that_do_not_fit_are_an_error(spark):
    df = table(spark, [[1 << 62, 0], [1 << 62, 1]])
    with pytest.raises(Exception, match="do not fit 64 bits"):
        whitening.report(df, "id", "x", 2).collect()
