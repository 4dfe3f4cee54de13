import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import batching, labels, metrics, ordering


def test_label_map_sorts_by_type(spark):
    words = spark.createDataFrame([("b",), ("a",), ("10",), ("2",), ("a",)], "label string")
    assert [(r.label, r.id) for r in labels.label_map(words).collect()] == [("10", 0), ("2", 1), ("a", 2), ("b", 3)]
    ints = spark.createDataFrame([(10,), (2,), (2,)], "label int")
    assert [(r.label, r.id) for r in labels.label_map(ints).collect()] == [(2, 0), (10, 1)]


def test_many_labels(spark):
    df = spark.range(3000).selectExpr("id AS key", "concat('l', lpad(id % 1000, 4, '0')) AS label")
    assert [(r.label, r.id) for r in labels.label_map(df).orderBy("id").collect()] == [(f"l{i:04}", i) for i in range(1000)]
    # three rows each: a share of 0.6 for all, so the first labels get the rows that floors leave over
    out = labels.stratified_split(df, "key").groupBy("label").agg(F.sum(F.col("is_test").cast("int")).alias("n")).collect()
    assert {r.label: r.n for r in out} == {f"l{i:04}": int(i < 600) for i in range(1000)}


def test_split_without_labels(spark):
    rows = spark.createDataFrame([(1, None), (2, None)], "key long, label string")
    assert [r.is_test for r in labels.stratified_split(rows, "key").collect()] == [False, False]
    assert labels.stratified_split(rows.limit(0), "key").collect() == []
    assert labels.label_map(rows).collect() == []


def test_unknown_label_is_an_error(spark):
    known = labels.label_map(spark.createDataFrame([("a",)], "label string"))
    rows = spark.createDataFrame([("a",), ("b",)], "label string")
    assert [r.label for r in labels.encode_labels(rows.where("label = 'a'"), known).collect()] == [0]
    with pytest.raises(Exception, match="unknown label"):
        labels.encode_labels(rows, known).collect()


@pytest.mark.parametrize("sizes", [{"a": 50, "b": 50}, {"a": 97, "b": 2, "c": 1}, {"a": 1}, {"a": 333, "b": 334, "c": 333}])
def test_stratified_split_is_exact(spark, sizes):
    rows = [(f"{k}{i}", k) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "key string, label string")
    out = labels.stratified_split(df, "key", seed=7).collect()
    assert len(out) == len(rows) == len({r.key for r in out})
    total = sum(sizes.values())
    n_test = math.ceil(total * 0.2)
    assert sum(r.is_test for r in out) == n_test
    for k, n in sizes.items():
        got = sum(r.is_test for r in out if r.label == k)
        assert abs(got - n * n_test / total) < 1
    again = labels.stratified_split(df.repartition(5), "key", seed=7).collect()
    assert {r.key for r in again if r.is_test} == {r.key for r in out if r.is_test}
    other = labels.stratified_split(df, "key", seed=8).collect()
    if total > 50:
        assert {r.key for r in other if r.is_test} != {r.key for r in out if r.is_test}


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "label int, prediction int")


def test_binary_metrics(spark):
    pairs = [(1, 1)] * 6 + [(1, 0)] * 2 + [(0, 1)] * 3 + [(0, 0)] * 9
    row = metrics.binary_metrics(frame(spark, pairs)).first()
    assert row.accuracy == pytest.approx(15 / 20)
    assert row.precision == pytest.approx(6 / 9) and row.recall == pytest.approx(6 / 8)
    assert row.f1 == pytest.approx(2 * 6 / (2 * 6 + 2 + 3))
    assert row.matthews_corrcoef == pytest.approx((6 * 9 - 3 * 2) / math.sqrt(9 * 8 * 12 * 11))
    assert row.roc_auc == pytest.approx((6 / 8 + 9 / 12) / 2)


def test_binary_metrics_with_one_class(spark):
    row = metrics.binary_metrics(frame(spark, [(0, 0)] * 4)).first()
    assert (row.accuracy, row.precision, row.recall, row.f1, row.matthews_corrcoef) == (1.0, 0.0, 0.0, 0.0, 0.0)
    assert row.roc_auc is None


def test_macro_f1_counts_predicted_only_classes(spark):
    pairs = [(0, 0), (0, 0), (1, 2), (2, 2), (2, 3)]
    row = metrics.macro_metrics(frame(spark, pairs)).first()
    assert row.accuracy == pytest.approx(3 / 5)
    assert row["f1-macro"] == pytest.approx((1.0 + 0.0 + 0.5 + 0.0) / 4)


def test_report_picks_the_metric_set(spark):
    two = {r.metric: r.value for r in metrics.classification_report(frame(spark, [(0, 0), (1, 1), (1, 2)])).collect()}
    assert set(two) == {"accuracy", "precision", "recall", "f1", "matthews_corrcoef", "roc_auc", "best_score"}
    assert two["best_score"] == two["f1"] == 66.67
    three = {r.metric: r.value for r in metrics.classification_report(frame(spark, [(0, 0), (1, 1), (2, 0)])).collect()}
    assert set(three) == {"accuracy", "f1-macro", "best_score"} and three["accuracy"] == 66.67


def test_metrics_by_name(spark):
    cells = metrics.confusion(frame(spark, [(0, 0), (1, 1), (1, 2)]))
    assert [tuple(r) for r in metrics.metric(cells, "f1").collect()] == [("f1", pytest.approx(2 / 3))]
    assert metrics.metric(cells, "accuracy", "multi").first().value == pytest.approx(2 / 3)
    with pytest.raises(ValueError, match="unknown metric f1-macro"):
        metrics.metric(cells, "f1-macro")


def test_masked_lm_metrics(spark):
    rows = [(0, [1, 2], [1, 3], [1.0, 1.0], [-0.5, -1.0]), (0, [4, 4], [4, 0], [1.0, 0.0], [-2.0, -9.0]), (1, [0], [1], [1.0], [-3.0])]
    df = spark.createDataFrame(
        rows, "batch int, predicted array<int>, labels array<int>, weights array<double>, log_probs array<double>"
    )
    row = metrics.masked_lm_metrics(df, "batch").first()
    assert row.masked_lm_accuracy == pytest.approx(2 / 4)
    assert row.masked_lm_loss == pytest.approx((3.5 / (3 + 1e-5) + 3.0 / (1 + 1e-5)) / 2)
    ns = spark.createDataFrame([(0, [-0.1, -2.0], 0), (0, [-0.7, -0.7], 1)], "batch int, log_probs array<double>, label int")
    row = metrics.next_sentence_metrics(ns, "batch").first()
    assert row.next_sentence_accuracy == 0.5 and row.next_sentence_loss == pytest.approx(0.4)


def run_log(spark, n=300):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"r{i % 5}", i, rng.choice([0.0, 1.5, 2.0, 3.25, rng.random()])) for i in range(n)]
    rows += [("zero", 1, 0.0), ("zero", 2, 0.0), ("late", 1, 0.0), ("late", 2, 4.0), ("late", 3, 0.0)]
    return rows, spark.createDataFrame(rows, "run string, step int, value double")


def test_best_checkpoint_equals_the_loop(spark):
    rows, df = run_log(spark)
    want = {}
    for run in {r[0] for r in rows}:
        best, saved = 0, []
        for _, step, value in sorted(r for r in rows if r[0] == run):
            if value >= best:
                best = value
                saved.append((step, value))
        want[run] = (len(saved), *saved[-1])
    got = {r.run: (r.n_saved, r.step, r.value) for r in metrics.best_checkpoint(df, "run", ["step"], "value").collect()}
    assert got == want


def test_running_loss_equals_the_loop(spark):
    rows, df = run_log(spark)
    got = {r.run: r.avg_loss for r in metrics.running_loss(df, "run", ["step"], "value").collect()}
    for run in {r[0] for r in rows}:
        avg = 0
        for _, _, value in sorted(r for r in rows if r[0] == run):
            avg = value if avg == 0 else avg * 0.99 + (1 - 0.99) * value
        assert got[run] == pytest.approx(avg, rel=1e-9), run


def test_running_sum_across_blocks(spark):
    df = spark.createDataFrame([(i * 37 % 101, float(i)) for i in range(101)], "k int, v double")
    blocked = ordering.ordered_blocks(df, "k", blocks=6)
    assert blocked.select("block").distinct().count() > 1
    rows = ordering.running_sum(blocked, F.col("v"), [F.col("k")], "s").orderBy("k").collect()
    total = 0
    for r in rows:
        total += r.v
        assert r.s == total


def test_hash_rank_is_a_permutation(spark):
    out = batching.shuffled_batches(spark.range(1003), F.col("id"), 10, epoch=0).collect()
    assert len(out) == 1000 and sorted((r.batch, r.slot) for r in out) == [(b, s) for b in range(100) for s in range(10)]
    again = batching.shuffled_batches(spark.range(1003).repartition(7), F.col("id"), 10, epoch=0).collect()
    assert {(r.id, r.batch, r.slot) for r in again} == {(r.id, r.batch, r.slot) for r in out}
    other = batching.shuffled_batches(spark.range(1003), F.col("id"), 10, epoch=1).collect()
    assert {(r.id, r.batch) for r in other} != {(r.id, r.batch) for r in out}


def test_collate(spark):
    df = spark.createDataFrame([(i, [i, i + 1]) for i in range(6)], "id int, xs array<int>")
    rows = batching.shuffled_batches(df, F.col("id"), 3, epoch=0)
    out = batching.collate(rows, {"id": "bigint", "xs": "array<bigint>"}).collect()
    assert sorted(i for r in out for i in r.id) == list(range(6)) and all(r.xs == [[i, i + 1] for i in r.id] for r in out)


@pytest.mark.parametrize("n,batch,devices,total", [(10, 4, 2, 16), (16, 4, 2, 24), (3, 4, 1, 4), (8, 8, 1, 16)])
def test_padding(spark, n, batch, devices, total):
    df = spark.createDataFrame([(i + 5, f"v{i}") for i in range(n)], "id int, v string")
    out = batching.pad_for_devices(df, "id", batch, devices).collect()
    pads = [r for r in out if r.is_pad]
    assert len(out) == total and len(pads) == total - n
    assert {(r.id, r.v) for r in pads} == ({(5, "v0")} if n >= batch else {(None, None)})
