"""What features and tokenisation cost beside their results."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import queries.evaluation as evaluation
from textloom.functions import draws
from textloom.operators import qa_features as qa
from textloom.operators import masking, packing
from textloom.operators import qa_predict as pr
from textloom.operators import wordpiece as wp
from textloom.operators.examples import ExampleConfig
from textloom.operators.vocabulary import SPECIAL_TOKENS, Vocabulary
from textloom.plans import pretraining

WORDS = [f"w{i}" for i in range(40)]


def vocabulary():
    tokens = [*SPECIAL_TOKENS.values(), *WORDS]
    return Vocabulary(tokens, {t: i for i, t in enumerate(tokens)})


def paragraphs(spark):
    context = " ".join(WORDS * 3)
    row = (1, context, [("1-0", "w1 w2", False, [("w3", 6)])])
    qas = qa.QAS_TYPE
    return spark.createDataFrame([row], f"doc_id bigint, context string, qas {qas}")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_feature_table_holds_what_is_read(spark, monkeypatch):
    written = []
    monkeypatch.setattr(evaluation, "write_through", lambda df: written.append(df.columns) or df)
    monkeypatch.setattr(evaluation, "question_set", lambda *_: paragraphs(spark))
    monkeypatch.setattr(evaluation, "vocabulary", lambda *_: vocabulary())
    monkeypatch.setattr(evaluation, "results", lambda s, d, w: w.select(
        "unique_id", *[F.array(*[F.lit(float(i)) for i in range(64)]).alias(c) for c in ("start_logits", "end_logits")]))
    assert evaluation.complete_questions(spark, "").count() == 1
    assert evaluation.candidate_spans(spark, "").count() > 0
    assert written[0] == ["id", "unique_id"]
    assert not {"attention_mask", "input_ids", "window_words"} & set(written[1])


def test_flags_are_left_out_for_readers_without_a_use(spark):
    config = qa.WindowConfig(max_seq_length=24, doc_stride=8, max_query_length=4)
    rows = qa.eval_features(paragraphs(spark), vocabulary(), config, ["doc_id"])
    assert "forall" in plan_of(rows.select("token_is_max_context"))
    assert "forall" not in plan_of(rows.select("unique_id", "input_ids"))


def test_remembered_words_are_bounded():
    words = pa.array([[[w] for w in WORDS], [[w, w] for w in WORDS[::-1]]])
    known, ids = {}, vocabulary().ids
    out = wp._pieces_of_batch(words, known, lambda w: [ids[w]], 10)
    assert list(known) == WORDS[:10]
    assert out.to_pylist() == [[[ids[w] for w in unit] for unit in row] for row in words.to_pylist()]


def test_rows_are_sliced_by_words():
    rows = [[["a"] * 3], None, [], [["b"] * 9, ["c"]], [["d"]], [["e"], None]]
    parts = list(wp._slices(pa.array(rows), 4))
    assert [len(p) for p in parts] == [3, 1, 2]
    assert [r for p in parts for r in p.to_pylist()] == rows


def test_words_cross_the_exchange_as_one_text(spark):
    config = qa.WindowConfig(max_seq_length=24, doc_stride=8, max_query_length=4)
    windows = qa.eval_features(paragraphs(spark), vocabulary(), config, ["doc_id"])
    logits = F.array(*[F.lit(float(i % 7)) for i in range(24)])
    results = windows.select("unique_id", logits.alias("start_logits"), logits.alias("end_logits"))
    best = pr.best_of_windows(windows, results, pr.PredictConfig(n_best_size=5, max_answer_length=4))
    assert "window_text" in plan_of(best)
    texts = [t["entry"]["text"] for r in best.collect() for t in r["top"]]
    assert texts and all(t in " ".join(WORDS * 3) for t in texts)


def test_no_array_is_made_for_a_run_of_words(spark):
    words = spark.createDataFrame([([(0, 2), (2, 3), (4, 6), (6, 7)],)], "s array<struct<b:int,e:int>>")
    rows = words.select(masking.ngram_spans(F.col("s"), 2).alias("g"))
    assert "slice" not in plan_of(rows)
    assert [tuple(g) for g in rows.first()["g"]] == [(0, 2), (2, 3), (4, 6), (6, 7), (0, 3), (4, 7)]


def test_only_lengths_of_pieces_are_tried():
    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            Counted.asked += 1
            return super().get(key, default)

    ids = Counted({"a": 0, "##a": 1, "##ab": 2})
    assert wp.longest_match("a" * 60, ids, 9) == [0] + [1] * 59
    assert Counted.asked <= 60
    assert wp.longest_match("aab", ids, 9) == [0, 2] and wp.longest_match("abb", ids, 9) == [9]


def test_units_are_split_by_the_batch(spark):
    texts = [["w1  w2　w3\n", "", None, "w4\x0bw5 (w6)"], [], None, [" w7"]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t array<string>")
    split = rows.select("i", wp.tokenise_units(vocabulary(), F.col("t")).alias("p"))
    assert "lambdafunction" not in plan_of(split)
    plain = rows.select("i", wp.wordpiece(vocabulary())(F.transform("t", wp.whitespace_words)).alias("p"))
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, plain.collect()))


def test_spans_of_batches_are_those_of_the_expression(spark):
    kinds = np.array([0, 1, 2], dtype=np.int8)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(0, 3, n).tolist()) for i, n in enumerate([0, 1, 1, 2, 0, 9, 40, 0])]
    table = spark.createDataFrame(rows, "i int, ids array<int>").coalesce(1)
    found = table.select("i", masking.find_spans(kinds)(F.col("ids")).alias("w"))
    assert found.collect() == table.select("i", masking.word_spans(F.col("ids")).alias("w")).collect()


def test_masks_are_made_by_the_batch(spark):
    vocab = vocabulary()
    rows = [(i, [7 + (i * 5 + k) % 40 for k in range(n)], [(b, b + 1 + b % 2) for b in range(0, n - 1, 3)], 77 * i) for i, n in enumerate([12, 1, 30, 0, 5])]
    table = spark.createDataFrame(rows, "i int, ids array<int>, s array<struct<b:int,e:int>>, seed bigint").coalesce(1)
    masked = table.withColumn("m", masking.corrupt_spans(F.col("ids"), F.col("s"), vocab, F.col("seed")))
    masked = masked.withColumn("new", masking.apply_corruption(F.col("ids"), F.col("m")))
    assert "lambdafunction" not in plan_of(masked)
    usable = vocab.replacement_ids()
    for (_, ids, spans, seed), row in zip(rows, masked.collect(), strict=True):
        want = []
        for b, e in spans:
            u = draws.to_unit(draws.mix_numpy(seed, np.array([b * 2])))[0]
            for p in range(b, e):
                token = usable[draws.mix_numpy(seed, np.array([p * 2 + 1]))[0] % len(usable)]
                want.append((p, ids[p], vocab.ids["[MASK]"] if u < 0.8 else ids[p] if u < 0.9 else token))
        assert [tuple(m) for m in row["m"]] == want
        assert row["new"] == [dict((p, n) for p, _, n in want).get(k, t) for k, t in enumerate(ids)]


def test_stored_lengths_are_packed(spark, monkeypatch):
    """The packing reads neither tokens nor their lengths again for its order."""
    seen = []
    real = packing.ordered_blocks
    monkeypatch.setattr(packing, "ordered_blocks", lambda df, *a, **k: seen.append(plan_of(df)) or real(df, *a, **k))
    tokens = spark.createDataFrame([("s", i, [[1, 2], [3]]) for i in range(5)], "shard string, doc_id bigint, lines array<array<int>>")
    groups = pretraining.packed_groups(pretraining.with_lengths(tokens), ExampleConfig(max_seq_length=8, short_seq_prob=0.0))
    assert "lambdafunction" not in seen[0]
    assert sorted((r["grp"], r["lines"]) for r in groups.collect()) == [(0, [[1, 2], [3]] * 2 + [[1, 2]]), (1, [[3]] + [[1, 2], [3]] * 2)]
