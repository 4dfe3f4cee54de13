import gzip
import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import examples as ex
from textloom.plans import pretraining, registry
from textloom.sources import corpus, labelled, qa, sinks


def test_corpus_text_and_json_lines(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("one\n\n  two \n\nthree　\n", encoding="utf-8")
    docs = [{"text": "solo"}, {"text": ["p\nq", " ", "r "]}, "bare"]
    raw = "\n\n".join(json.dumps(d) for d in docs).encode()
    (tmp_path / "b.jsonl.gz").write_bytes(gzip.compress(raw))
    (tmp_path / "c.pdf").write_text("no")
    rows = corpus.read_corpus(spark, str(tmp_path)).orderBy("shard", "doc_id").collect()
    by_file = {}
    for r in rows:
        by_file.setdefault(r.shard.rsplit("/", 1)[1], []).extend(r.lines)
    assert by_file == {"x.txt": ["one", "two", "three"], "b.jsonl.gz": ["solo", "p q", "r", "bare"]}
    assert [r.path.rsplit("/", 1)[1] for r in corpus.skipped_files(spark, str(tmp_path)).collect()] == ["c.pdf"]


def test_corpus_without_files(spark, tmp_path):
    (tmp_path / "c.pdf").write_text("no")
    with pytest.raises(FileNotFoundError):
        corpus.read_corpus(spark, str(tmp_path))


def test_text_lines_keep_their_order_over_splits(spark, tmp_path):
    lines = [f"line {i}" for i in range(500_000)]
    (tmp_path / "big.txt").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 21))
    try:
        df = corpus.read_corpus(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 1
        got = [r.lines[0] for r in df.orderBy("doc_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == lines


def test_corpus_to_examples_and_back(spark, vocab, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(4):
        (tmp_path / "in" / f"f{i}.txt").write_text("That little blue truck.\nthe red boat\n" * (5 * i + 1))
    config = ex.ExampleConfig(max_seq_length=24, max_predictions_per_seq=4)
    out = str(tmp_path / "out")
    table = spark.createDataFrame([(t, i) for i, t in enumerate(vocab.tokens)], "token string, id int")
    n = pretraining.build_examples(spark, str(tmp_path / "in"), table, out, config, n_files=3)
    # replaced, not appended
    assert n == pretraining.build_examples(spark, str(tmp_path / "in"), table, out, config, n_files=3)
    batches = pretraining.training_batches(spark, out, config, 4, epoch=0).collect()
    assert len(batches) == n // 4 * 4 and {r.slot for r in batches} == {0, 1, 2, 3}
    assert len(list((tmp_path / "out").glob("*.parquet"))) == 3
    back = sinks.read_examples(spark, out, 24, 4)
    assert back.count() == n and dict(back.dtypes)["input_ids"] == "array<int>"
    with pytest.raises(Exception, match="must have 25 elements"):
        sinks.read_examples(spark, out, 25, 4).collect()


def test_fake_news(spark, tmp_path):
    path = tmp_path / "news.csv"
    rows = [f'"t{i}","line one\nsays ""hi"" {i}",{i % 2}' for i in range(20)]
    path.write_text("title,content,Label\n" + "\n".join(rows) + "\nonly,,1\n")
    train = labelled.read_fake_news(spark, str(path), True).collect()
    valid = labelled.read_fake_news(spark, str(path), False).collect()
    assert len(train) == 16 and len(valid) == 5
    texts = {r.text for r in train} | {r.text for r in valid}
    assert "only nan" in texts and 't3 line one\nsays "hi" 3' in texts and len(texts) == 21


def test_equal_rows_stay_apart(spark, tmp_path):
    path = tmp_path / "news.csv"
    path.write_text("title,content,label\n" + "same,text,a\n" * 10)
    sizes = [labelled.read_fake_news(spark, str(path), side).count() for side in (True, False)]
    assert sizes == [8, 2]


def test_json_label_sources(spark, tmp_path):
    talk = [{"talk": {"content": {"HS02": "b", "HS01": "a", "SS": ""}}, "profile": {"emotion": {"type": "E1"}}}]
    (tmp_path / "talk.json").write_text(json.dumps(talk))
    row = labelled.read_dialogue_emotion(spark, str(tmp_path / "talk.json"), True).first()
    assert (row.text, row.label) == ("b a ", "E1")
    docs = {"document": [{"paragraph": [{"paragraph_form": f"x{i}"}, {"paragraph_form": "y"}], "document_score": i % 2} for i in range(10)]}
    (tmp_path / "docs.json").write_text(json.dumps(docs))
    train = labelled.read_document_sentiment(spark, str(tmp_path / "docs.json"), True).collect()
    valid = labelled.read_document_sentiment(spark, str(tmp_path / "docs.json"), False).collect()
    assert len(train) == 8 and len(valid) == 2 and {r.label for r in valid} == {0, 1}
    assert {r.text for r in train + valid} == {f"x{i} y" for i in range(10)}


def test_reviews(spark, tmp_path):
    path = str(tmp_path / "reviews")
    spark.createDataFrame([("a", 1, "train"), ("b", 0, "test")], "document string, label int, split string").write.parquet(path)
    assert [r.text for r in labelled.read_reviews(spark, path, False).collect()] == ["b"]


ANSWER = {"text": "b<b>x</b>", "answer_start": 12}


def test_qa_sources(spark, tmp_path):
    squad = {"data": [{"paragraphs": [{"context": "c", "qas": [{"id": "1", "question": "q", "answers": [{"text": "c", "answer_start": 0}]}]}]}]}
    (tmp_path / "dir").mkdir()
    for name in ("one", "two"):
        (tmp_path / "dir" / f"{name}.json").write_text(json.dumps(squad))
    (tmp_path / "dir" / "skip.md").write_text("x")
    rows = qa.read_squad(spark, str(tmp_path / "dir"), True).collect()
    assert len(rows) == 2 and rows[0].qas[0].is_impossible is False and rows[0].qas[0].answers[0].text == "c"

    mrc = json.loads(json.dumps(squad).replace('"id"', '"guid"'))
    (tmp_path / "mrc.json").write_text(json.dumps(mrc))
    assert qa.read_mrc(spark, str(tmp_path / "mrc.json"), True).first().qas[0].id == "1"

    ask = lambda i: {"id": str(i), "question": "q", "answer": {"text": "b<b>x</b>", "answer_start": 12, "html_answer_text": "", "html_answer_start": 0}}
    html = {"data": [{"context": "<body><p>a </p>b<b>x</b>", "raw_html": "", "qas": [ask(i) for i in range(k)]} for k in (1, 1, 3)]}
    html["data"][0]["qas"][0]["answer"]["answer_start"] = 15
    (tmp_path / "html.json").write_text(json.dumps(html))
    train = qa.read_html_qa(spark, str(tmp_path / "html.json"), True).collect()
    assert [len(r.qas) for r in train] == [1, 1, 1] and {r.context for r in train} == {"a bx"}
    first = [r.qas[0].answers[0] for r in train]
    assert {a.text for a in first} == {"bx"} and 2 in {a.answer_start for a in first}
    valid = qa.read_html_qa(spark, str(tmp_path / "html.json"), False).collect()
    assert sorted(len(r.qas) for r in valid) == [1, 1, 1, 1, 1]

    note = lambda s, e, y="NONE": {"minimal_answer": {"plaintext_start_byte": s, "plaintext_end_byte": e}, "yes_no_answer": y}
    line = lambda lang, notes: json.dumps({"language": lang, "document_plaintext": "가나", "question_text": "q", "annotations": notes})
    (tmp_path / "tydi.jsonl").write_text(
        "\n".join([line(" Korean", [note(3, 6)]), line("korean", [note(-1, -1)]), line("korean", [note(0, 3, "YES")]), line("thai", [note(0, 3)])] + [line("korean", [note(0, 3)])] * 2)
    )
    rows = sorted(qa.read_byte_qa(spark, str(tmp_path / "tydi.jsonl"), True).collect(), key=lambda r: r.qas[0].is_impossible)
    assert len(rows) == 4 and sorted(a.text for r in rows for a in r.qas[0].answers) == ["가", "가", "나"] and rows[3].qas[0].is_impossible
    assert len({r.qas[0].id for r in rows}) == 4  # equal records stay apart


def test_registry_jobs(spark, vocab, tmp_path):
    path = tmp_path / "news.csv"
    path.write_text("title,content,label\n" + "".join(f"the boat,red {i},{'ab'[i % 2]}\n" for i in range(10)))
    config = registry.FineTuneConfig("cls", "fake_news", max_seq_length=8)
    train_rows, labels = registry.classification_rows(spark, config, str(path), True)
    assert {r.label for r in train_rows.collect()} == {0, 1}
    train = registry.build_features(spark, config, str(path), vocab, True, labels)
    row = train.first()
    assert train.count() == 8 and len(row.input_ids) == 8 and set(train.columns) == {"row_id", "input_ids", "attention_mask", "labels"}
    sinks.write_labelled(train_rows, labels, str(tmp_path / "side"), True)
    assert spark.read.option("header", "true").csv(str(tmp_path / "side_label2id.csv")).count() == 2
    path.write_text("title,content,label\n")
    assert registry.build_features(spark, config, str(path), vocab, True, labels).count() == 8  # from the cache
    with pytest.raises(ValueError):
        registry.build_features(spark, registry.FineTuneConfig("cls", "squad"), str(path), vocab, True)
    with pytest.raises(ValueError):
        registry.build_features(spark, registry.FineTuneConfig("rank", "nsmc"), str(path), vocab, True)


def test_qa_registry_job(spark, vocab, tmp_path):
    squad = {"data": [{"paragraphs": [{"context": "the red boat", "qas": [{"id": "1", "question": "blue", "answers": [{"text": "red", "answer_start": 4}]}]}]}]}
    (tmp_path / "s.json").write_text(json.dumps(squad))
    config = registry.FineTuneConfig("qa", "korquad_1", max_seq_length=16, doc_stride=8, max_query_length=4)
    row = registry.build_features(spark, config, str(tmp_path / "s.json"), vocab, True).first()
    assert row.start_position == row.end_position == 4
    assert registry.build_features(spark, config, str(tmp_path / "s.json"), vocab, False).first().unique_id == "1_0"


def test_results_and_metrics_round_trip(spark, tmp_path):
    part = spark.createDataFrame([("a_0", [1.0], [2.0])], "unique_id string, start_logits array<double>, end_logits array<double>")
    path = str(tmp_path / "results")
    sinks.write_results(part.withColumn("unique_id", F.lit("old")), path, 3)
    sinks.write_results(part, path, 3)
    sinks.write_results(part.withColumn("unique_id", F.lit("a_1")), path, 3, part=1)
    sinks.write_results(part.withColumn("unique_id", F.lit("other")), path, 4)
    assert {r.unique_id for r in sinks.read_results(spark, path, 3).collect()} == {"a_0", "a_1"}
    sinks.clear_results(spark, path, 3)
    assert not (tmp_path / "results" / "step=3").exists()
    assert {r.unique_id for r in sinks.read_results(spark, path, 4).collect()} == {"other"}
    report = spark.createDataFrame([("f1", 1.0), ("accuracy", 2.0)], "metric string, value double")
    sinks.write_metrics(report, str(tmp_path / "metrics"), 3)
    assert [r.metric for r in spark.read.parquet(str(tmp_path / "metrics") + "/step=3").collect()] == ["accuracy", "f1"]
