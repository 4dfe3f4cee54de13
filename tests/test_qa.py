import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import qa_features as qa
from textloom.operators import qa_predict as pr
from textloom.operators import qa_scores as sc

CONTEXT = "That little blue truck. the red boat, the little boat"
PARAGRAPHS = "context string, qas array<struct<id:string,question:string,is_impossible:boolean,answers:array<struct<text:string,answer_start:int>>>>"


def paragraph(spark, *qas):
    return spark.createDataFrame([(CONTEXT, list(qas))], PARAGRAPHS)


def question(qid, text, start, question="the boat", impossible=False):
    return (qid, question, impossible, [] if impossible else [(text, start)])


def test_answer_spans_are_tightened(spark, vocab):
    rows = paragraph(
        spark,
        question("exact", "truck", CONTEXT.index("truck")),
        question("words", "little blue", CONTEXT.index("little")),
        question("end", "boat", CONTEXT.rindex("boat")),
        question("inside", "oat", CONTEXT.rindex("oat")),
        question("wrong", "truck", 0),
        question("none", "", 0, impossible=True),
    )
    tokens = qa.answer_words(qa.tokenise_paragraphs(rows, vocab, True, []))
    out = qa.token_span(tokens)
    found = qa.answer_found(F.col("start_word"), F.col("end_word"), F.col("words"), F.col("answer_text"))
    got = {r.id: r for r in out.withColumn("found", found).collect()}
    text = lambda r: [vocab.tokens[i] for i in r.tokens[r.tok_start : r.tok_end + 1]]
    assert text(got["exact"]) == ["tru", "##ck"]  # the full stop is left out
    assert text(got["words"]) == ["lit", "##tle", "blue"]
    assert text(got["end"]) == ["boa", "##t"] and got["end"].tok_end == len(got["end"].tokens) - 1
    assert text(got["inside"]) == ["boa", "##t"]
    assert not got["wrong"].found and got["end"].found
    assert (got["none"].start_word, got["none"].end_word) == (0, 0)


def test_training_windows(spark, vocab):
    config = qa.WindowConfig(max_seq_length=12, doc_stride=3, max_query_length=2)
    rows = paragraph(
        spark,
        question("a", "red", CONTEXT.index("red")),
        question("n", "", 0, impossible=True),
        question("wrong", "truck", 0),
    )
    out = qa.train_features(rows, vocab, config, []).collect()
    assert {r.id for r in out} == {"a", "n"}
    for r in out:
        real = [vocab.tokens[i] for i, m in zip(r.input_ids, r.attention_mask, strict=True) if m]
        assert len(r.input_ids) == len(r.token_type_ids) == 12
        assert real[0] == "[CLS]" and real[1:3] == ["the", "boa"] and real[3] == "[SEP]" == real[-1]
        assert r.token_type_ids[: len(real)] == [0] * 4 + [1] * (len(real) - 4)
        inside = "red" in real
        if r.id == "a" and inside:
            assert real[r.start_position] == "red" == real[r.end_position]
        else:
            assert (r.start_position, r.end_position) == (0, 0)
    assert any("red" in [vocab.tokens[i] for i in r.input_ids] for r in out)


@pytest.mark.parametrize("n,cap,stride", [(1, 10, 4), (10, 10, 4), (11, 10, 4), (37, 10, 4), (40, 10, 10), (25, 7, 3)])
def test_window_count_covers_the_document(one, n, cap, stride):
    count, covered = 0, 0
    while covered < n:
        covered = count * stride + cap
        count += 1
    assert one(qa.window_count(F.lit(n), F.lit(cap), stride).alias("c")).c == count


@pytest.mark.parametrize("n,cap,stride", [(5, 10, 4), (37, 10, 4), (40, 10, 9), (101, 23, 6)])
def test_max_context_equals_the_scan(spark, one, n, cap, stride):
    count = one(qa.window_count(F.lit(n), F.lit(cap), stride).alias("c")).c
    spans = [(i * stride, min(n - i * stride, cap)) for i in range(count)]
    rows = spark.range(count).select(
        F.col("id").cast("int").alias("w"),
        qa.max_context(F.col("id").cast("int"), F.lit(n), F.lit(cap), stride).alias("flags"),
    )
    for r in rows.collect():
        start, length = spans[r.w]
        assert len(r.flags) == length
        for j, flag in enumerate(r.flags):
            p, best, winner = start + j, None, None
            for i, (s, size) in enumerate(spans):
                if s <= p < s + size:
                    score = min(p - s, s + size - 1 - p) + 0.01 * size
                    if best is None or score > best:
                        best, winner = score, i
            assert flag == (winner == r.w)


def test_empty_context_gives_no_features(spark, vocab):
    rows = spark.createDataFrame([("  ", [question("x", "", 0, impossible=True)])], PARAGRAPHS)
    assert qa.eval_features(rows, vocab, qa.WindowConfig(16, 4, 4), []).count() == 0


def test_question_chunks(spark):
    rows = spark.createDataFrame([(k, list(range(k))) for k in (1, 2, 2, 5)], "k int, qas array<int>")
    got = collections.defaultdict(list)
    for r in qa.question_chunks(rows).collect():
        got[r.k].append(r.qas)
    assert sorted(got[5]) == [[0, 1], [2, 3], [4]] and got[1] == [[0]] and got[2] == [[0, 1], [0, 1]]


def test_byte_annotations(spark):
    text = "가나다 abc"
    spans = [(0, 6, "NONE"), (-1, -1, "NONE"), (10, 13, "NONE")]
    note = lambda s, e, y: ((s, e), y)
    schema = (
        "t string, a array<struct<minimal_answer:struct<plaintext_start_byte:int,plaintext_end_byte:int>,yes_no_answer:string>>"
    )
    df = spark.createDataFrame(
        [(text, [note(*s) for s in spans]), (text, [note(0, 3, "YES")]), (text, [note(-1, -1, "NONE")])], schema
    )
    kept, answers = qa.byte_annotation_answers(F.col("t"), F.col("a"))
    rows = df.select(kept.alias("k"), answers.alias("x")).collect()
    # the end may equal the length of the document
    assert [(a.text, a.answer_start) for a in rows[0].x] == [("가나", 0), ("abc", 4)]
    assert rows[0].k and not rows[1].k and rows[2].k and rows[2].x == []


# --- prediction -----------------------------------------------------------------


def brute_predictions(features, logits, words, n_best, max_len, negative, threshold):
    """By definition: of every text its best valid span, in order, the first ``n_best``."""
    spans = {}
    for w, (f, (s, e)) in enumerate(zip(features, logits, strict=True)):
        starts, ends = (sorted(range(len(x)), key=lambda i: (-x[i], i))[:n_best] for x in (s, e))
        for (a, i), (b, j) in itertools.product(enumerate(starts), enumerate(ends)):
            low, high = i - f["doc_offset"], j - f["doc_offset"]
            if 0 <= low <= high < f["paragraph_len"] and high - low < max_len and f["token_is_max_context"][low]:
                text = " ".join(words[f["token_to_orig_map"][low] : f["token_to_orig_map"][high] + 1])
                spans.setdefault(text, []).append((-(s[i] + e[j]), w, a, b, s[i], e[j]))
    empty = min((s[0] + e[0], w, s[0], e[0]) for w, (s, e) in enumerate(logits))
    if negative:
        spans[""] = [(-empty[0], len(features), 0, 0, *empty[2:])]
    kept = sorted((min(of), text) for text, of in spans.items())[:n_best]
    best = [(*span[4:], text) for span, text in kept]
    if negative and all(text for _, _, text in best):
        best.append((*empty[2:], ""))
    if len(best) == negative:
        best.insert(0, (0.0, 0.0, "empty"))
    top = next(entry for entry in best if entry[2])
    return best, "" if negative and empty[0] - top[0] - top[1] > threshold else top[2]


@pytest.mark.parametrize("negative", [True, False])
def test_predictions_equal_the_loop(spark, negative):
    rng = random.Random(11 + negative)
    feats, results, want, want_best = [], [], {}, {}
    for q in range(40):
        words = [rng.choice(["a", "b", "c", "d"]) for _ in range(rng.randint(1, 12))]
        qid = f"q_{q}"
        own, logits = [], []
        for w in range(rng.randint(1, 3)):
            size = rng.randint(1, 9)
            f = {
                "id": qid,
                "unique_id": f"{qid}_{w}",
                "window": w,
                "doc_offset": 3,
                "paragraph_len": size,
                "token_to_orig_map": sorted(rng.randrange(len(words)) for _ in range(size)),
                "token_is_max_context": [rng.random() < (0.8 if q else 0.0) for _ in range(size)],
                "input_ids": list(range(14)),
            }
            f["window_words"] = words[f["token_to_orig_map"][0] : f["token_to_orig_map"][-1] + 1]
            # few distinct values, so that ties matter
            sl, el = ([float(rng.randint(-3, 3)) for _ in range(14)] for _ in range(2))
            own.append(f)
            logits.append((sl, el))
            feats.append(tuple(f.values()))
            results.append((f["unique_id"], sl, el))
        want_best[qid], want[qid] = brute_predictions(own, logits, words, 4, 3, negative, 0.0)
    f = spark.createDataFrame(
        feats,
        "id string, unique_id string, window int, doc_offset int, paragraph_len int, token_to_orig_map array<int>, "
        "token_is_max_context array<boolean>, input_ids array<int>, window_words array<string>",
    )
    r = spark.createDataFrame(results, "unique_id string, start_logits array<double>, end_logits array<double>")
    config = pr.PredictConfig(4, 3, negative)
    tops = pr.best_of_windows(f, r.union(r.limit(3)), config)
    assert all(len(row.top) <= 4 for row in tops.collect())
    ranked = pr.n_best(tops, config)
    for row in ranked.collect():
        assert [(x.start_logit, x.end_logit, x.text) for x in row.nbest] == want_best[row.id], row.id
        assert sum(row.probabilities) == pytest.approx(1.0)
    got = {r.id: r.text for r in pr.decide(ranked, config).collect()}
    assert got == {k: "" if v == "empty" else v for k, v in want.items()}


def test_incomplete_questions_are_left_out(spark):
    f = spark.createDataFrame([("a_b", "a_b_0"), ("a_b", "a_b_1"), ("c", "c_0")], "id string, unique_id string")
    r = spark.createDataFrame([("a_b_0",), ("c_0",), ("c_0",)], "unique_id string")
    assert [x.id for x in pr.complete_questions(f, r).collect()] == ["c"]


@pytest.mark.parametrize(
    "predicted,original,lower,expected",
    [
        ("blue truck", "blue truck,", False, "blue truck"),
        ("steve smith", "Steve Smith's", True, "Steve Smith"),
        ("x", "no match", False, "no match"),
        ("cafe", "Café (old)", True, "Café"),
        ("( old )", "Café (old)", False, "(old)"),
        ("", "", False, ""),
    ],
)
def test_align_text(predicted, original, lower, expected):
    assert pr.align_text(predicted, original, lower) == expected


def out_table(spark):
    return spark.createDataFrame([("q-1", "truck")], "id string, text string")


def test_equal_probabilities_follow_the_order_of_the_files(spark, vocab):
    asked = [("z", [("red",)], 0), ("a", [], 1)]
    predictions = spark.createDataFrame([("z", "red"), ("a", "red")], "id string, text string")
    best = {}
    for flip in (False, True):
        rows = [(i, a, 1 - n if flip else n) for i, a, n in asked]
        examples = spark.createDataFrame(rows, "id string, answers array<struct<text:string>>, arrival int")
        best[flip] = {r.metric: r.value for r in sc.question_report(examples, predictions).collect()}["best_f1"]
    assert best == {False: 100.0, True: 50.0}


def test_predict_end_to_end(spark, vocab):
    rows = paragraph(spark, question("q-1", "truck", CONTEXT.index("truck")))
    config = qa.WindowConfig(32, 16, 4)
    features = qa.eval_features(rows, vocab, config, [])
    f = features.first()
    tokens = [vocab.tokens[i] for i in f.input_ids]
    at = tokens.index("tru")
    sl = [5.0 if i == at else 0.0 for i in range(32)]
    el = [5.0 if i == at + 1 else 0.0 for i in range(32)]
    results = spark.createDataFrame([(f.unique_id, sl, el)], "unique_id string, start_logits array<double>, end_logits array<double>")
    out = pr.predict(features, results, vocab, pr.PredictConfig(5, 8, True)).first()
    # the word is "truck." and the tokens are "tru ##ck"
    assert (out.id, out.text) == ("q-1", "truck")
    with pytest.raises(ValueError, match="order"):
        sc.question_report(qa.eval_examples(rows, []), out_table(spark))
    report = sc.question_report(
        qa.eval_examples(rows.withColumn("place", F.lit(0)), []),
        pr.predict(features, results, vocab, pr.PredictConfig(5, 8, True)),
        version_2=True,
    )
    values = {r.metric: r.value for r in report.collect()}
    assert values["best_f1"] == values["best_exact"] == values["best_score"] == 100.0
    assert values["HasAns_total"] == 1 and "NoAns_total" not in values and values["missing"] == 0


# --- scoring ----------------------------------------------------------------------


def scores(spark, rows):
    return spark.createDataFrame(rows, "has_answer boolean, answered boolean, exact double, f1 double, no_answer_prob double, arrival int")


@pytest.mark.parametrize("blocks", [1, 5])
def test_best_threshold_equals_the_scan(spark, blocks):
    rng = random.Random(4)
    for case in range(2):
        rows = [
            (rng.random() < 0.5, rng.random() < 0.7, float(rng.random() < 0.4), rng.choice([0.0, 0.25, 0.5, 1.0]), rng.choice([0.0, 0.1, 0.2, 0.9]) * case, i)
            for i in range(80)
        ]
        got = sc.best_thresholds(scores(spark, rows), blocks=blocks).first()
        for k, col in (("exact", 2), ("f1", 3)):
            cur = best = sum(not r[0] for r in rows)
            thresh = 0.0
            for r in sorted(rows, key=lambda r: (r[4], r[5])):
                cur += r[col] if r[0] else (-1 if r[1] else 0)
                if cur > best:
                    best, thresh = cur, r[4]
            assert got[f"best_{k}"] == pytest.approx(100 * best / len(rows)) and got[f"best_{k}_thresh"] == thresh


def test_scores_of_empty_answers(spark):
    examples = spark.createDataFrame(
        [("none", []), ("blank", [(" ,.",)]), ("two", [("xy",), ("Cats",)]), ("lost", [("a",)])],
        "id string, answers array<struct<text:string>>",
    )
    predictions = spark.createDataFrame([("none", ""), ("blank", ""), ("two", "the cats")], "id string, text string")
    got = {r.id: r for r in sc.raw_scores(examples, predictions).collect()}
    # a right empty answer matches, but its F1 is 0
    assert (got["none"].exact, got["none"].f1, got["none"].has_answer) == (1.0, 0.0, False)
    assert (got["blank"].exact, got["blank"].has_answer) == (1.0, True)
    assert got["two"].exact == 0.0 and got["two"].f1 == pytest.approx(2 * 4 / 11)
    assert [r.id for r in sc.missing_predictions(examples, predictions).collect()] == ["lost"]
    summary = sc.score_summary(sc.raw_scores(examples, predictions)).first()
    assert summary.total == 3 and summary.NoAns_exact == 100.0 and summary.HasAns_exact == 50.0


def test_threshold_application(spark):
    rows = [(True, True, 1.0, 1.0, 0.9, 0), (False, True, 0.0, 0.0, 0.9, 1), (True, True, 1.0, 0.5, 0.1, 2)]
    out = sc.apply_threshold(scores(spark, rows), 0.5).orderBy("arrival").collect()
    assert [(r.exact, r.f1) for r in out] == [(0.0, 0.0), (1.0, 1.0), (1.0, 0.5)]
