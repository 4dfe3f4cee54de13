"""Numbers, groups and ids of files must not follow how the files are split for reading."""

import json

import pytest

from textloom.operators import packing
from textloom.sources import corpus, labelled, qa

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def over_splits(spark):
    """Run with files read in small splits and whole; the smaller size makes many."""

    def run(read):
        before = spark.conf.get(SPLIT)
        out = []
        try:
            for size in (1 << 12, 1 << 16, 1 << 27):
                spark.conf.set(SPLIT, str(size))
                out.append(read())
        finally:
            spark.conf.set(SPLIT, before)
        return out

    return run


def write_corpus(folder):
    for name, n in (("a.txt", 3000), ("b.txt", 1), ("c.txt", 700)):
        (folder / name).write_text("\n".join(f"{name} line {i}" + "\n" * (i % 3) for i in range(n)))
    (folder / "d.jsonl").write_text("\n\n".join(json.dumps({"text": [f"t{i}", "u"]}) for i in range(900)))


def test_lines_have_their_number(spark, tmp_path, over_splits):
    write_corpus(tmp_path)

    def read():
        return sorted((r.shard.rsplit("/", 1)[1], r.doc_id, r.lines) for r in corpus.read_corpus(spark, str(tmp_path)).collect())

    few, some, whole = over_splits(read)
    assert few == some == whole
    for name in ("a.txt", "c.txt"):
        lines = (tmp_path / name).read_text().split("\n")
        assert [(n, t) for f, n, (t,) in ((f, n, t) for f, n, t in whole if f == name)] == [(i, t) for i, t in enumerate(lines) if t]
    assert [n for f, n, _ in whole if f == "d.jsonl"] == list(range(0, 1800, 2))


def test_short_targets_stay(spark, tmp_path, over_splits):
    write_corpus(tmp_path)

    def read():
        rows = corpus.read_corpus(spark, str(tmp_path)).selectExpr("shard", "doc_id", "transform(lines, x -> 3 + length(x) % 5) AS lens")
        packed = packing.pack_lines(rows, 40, short_prob=0.3, seed=7, dupe_factor=2, blocks=3)
        return sorted((r.shard, r.dupe, r.doc_id, r.runs) for r in packed.collect())

    few, some, whole = over_splits(read)
    assert few == some == whole
    assert len({run.target for _, _, _, runs in whole for run in runs}) > 10


def test_question_ids_stay(spark, tmp_path, over_splits):
    record = {"language": "Korean ", "document_plaintext": "ab", "question_text": "q",
              "annotations": [{"minimal_answer": {"plaintext_start_byte": 0, "plaintext_end_byte": 1}, "yes_no_answer": "NONE"}]}
    for name in ("x.jsonl", "y.jsonl"):
        # equal records, blank and broken lines
        lines = [json.dumps(record | {"question_text": f"q{i % 2}"}) + "\n" * (i % 2) for i in range(300)]
        (tmp_path / name).write_text("\n".join([*lines, "{broken", ""]))

    def read():
        rows = qa.read_byte_qa(spark, str(tmp_path), False).collect()
        return sorted((r.place.outer, r.qas[0].id, r.qas[0].question) for r in rows)

    few, some, whole = over_splits(read)
    assert few == some == whole
    assert len({i for _, i, _ in whole}) == len(whole) == 600


def test_row_ids_are_unique(spark, tmp_path, over_splits):
    talk = [{"talk": {"content": {"a": "same"}}, "profile": {"emotion": {"type": "E"}}}] * 3
    for name in ("t1.json", "t2.json"):
        (tmp_path / name).write_text(json.dumps(talk))
    docs = {"document": [{"paragraph": [{"paragraph_form": "same"}], "document_score": 1}] * 10}
    (tmp_path / "docs.json").write_text(json.dumps(docs))
    (tmp_path / "news.csv").write_text("title,content,label\n" + "same,text,a\n" * 2000)
    reviews = str(tmp_path / "reviews")
    spark.createDataFrame([("a", 1, "train")] * 7, "document string, label int, split string").repartition(3).write.parquet(reviews)

    def read():
        rows = [labelled.read_dialogue_emotion(spark, str(tmp_path / "t*.json"), True)]
        rows += [labelled.read_document_sentiment(spark, str(tmp_path / "docs.json"), side) for side in (True, False)]
        rows += [labelled.read_fake_news(spark, str(tmp_path / "news.csv"), side) for side in (True, False)]
        rows.append(labelled.read_reviews(spark, reviews, True))
        return [sorted(r.row_id for r in of.collect()) for of in rows]

    few, some, whole = over_splits(read)
    assert few == some == whole
    assert [len(set(ids)) for ids in whole] == [len(ids) for ids in whole] == [6, 8, 2, 1600, 400, 7]
    assert not set(whole[1]) & set(whole[2]) and not set(whole[3]) & set(whole[4])
