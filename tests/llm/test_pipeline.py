"""The pipeline's stages against plain versions of each, on the smallest documents."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_contextual_pii import brute as personal_data
from tests.llm.test_near_copies import brute as near_copies
from tests.llm.test_substrings import split
from textloom.llm import best_fit, sharding

FOLDER = "/root/testdata/sf0.001"


def cut_repeats(rows, window=50):
    first = {}
    for key, text in rows:
        w = split(text)
        for i in range(len(w) - window + 1):
            s = tuple(w[i : i + window])
            first[s] = min(first.get(s, key), key)
    out = {}
    for key, text in rows:
        w = split(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < key:
                gone.update(range(i, i + window))
        if not gone:
            out[key] = text
        elif len(gone) < len(w):
            out[key] = " ".join(x for i, x in enumerate(w) if i not in gone)
    return out


def test_stages(spark, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = [(900, None, "en", None, None), (901, "12 34", None, "s", 5), (902, "", "en", "s", 0), (903, "de la misma manera que los otros " * 9, None, None, None)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_copies", "substrings", "personal_data", "packing"]

    def step(name, given):
        stages[name](spark, given, FOLDER).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    told = step("language", rows)
    before = {r["doc_id"]: r for r in rows.collect()}
    after = {r["doc_id"]: r for r in told.collect()}
    assert told.columns == columns
    assert {900, 901, 902}.isdisjoint(after) and 903 in after and after[903]["lang"] is not None
    assert len(after) >= 0.97 * (len(before) - 3)
    assert all(after[k]["text"] == before[k]["text"] for k in after)

    single = step("near_copies", told)
    label = near_copies([(k, r["text"]) for k, r in after.items()])
    kept = {r["doc_id"]: r for r in single.collect()}
    assert single.columns == columns and len(kept) == single.count()
    assert set(kept) == {k for k, c in label.items() if k == c}

    shorter = step("substrings", single)
    want = cut_repeats([(k, r["text"]) for k, r in kept.items()])
    assert shorter.columns == columns
    assert {r["doc_id"]: r["text"] for r in shorter.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in shorter.collect())

    masked = step("personal_data", shorter)
    text = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert masked.columns == columns and text.keys() == want.keys()
    for key, old in want.items():
        assert not personal_data(text[key])
        if not re.search("[0-9@]", old):
            assert text[key] == old
        elif personal_data(old):
            assert re.search("<(EMAIL|IP|CARD|PHONE)>", text[key])

    packed = step("packing", masked).collect()
    assert sum(r["used"] for r in packed) == sum(len(split(t)) for t in text.values())
    assert all(len(split(r["text"])) == r["used"] <= r["capacity"] for r in packed)
    assert {r["capacity"] for r in packed} <= set(best_fit.LENGTHS)
    assert sorted({d for r in packed for d in r["doc_ids"]}) == sorted(k for k, t in text.items() if split(t))


def test_no_documents(spark, tmp_path):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, given, FOLDER).write.parquet(str(tmp_path / name))
        given = spark.read.parquet(str(tmp_path / name))
    assert given.count() == 0


#: Every name an operator of the stages gives a column of its own.
INTERNAL = """row key text_ told score lang_pred ambiguous lang_ component place kept _kept _place n_words n_removed kept_sha256
marks seeds seed h1 h2 node size grams parity prints variant a b x y gram rows bits first low high mark w1 w2 phrases hash
_hash _key _k _h spans _spans _found merged _merged base added match core pattern kind start end _copy n conf seq_id
capacity used offset _text _part _parts _bucket rank piece shard page part values told_ _told""".split()


def test_columns_of_any_name_pass_through(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    mail = spark.createDataFrame([(950, "write to ann.b@mail.example.org about it, or to the others, de la misma manera", "es", "s", 1)], docs.schema)
    given = docs.unionByName(mail)
    for name in INTERNAL:
        given = given.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    given = given.withColumn("a dot.ted name", F.array("doc_id"))
    columns = given.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, given, FOLDER).write.parquet(str(tmp_path / name))
        given = spark.read.parquet(str(tmp_path / name))
        assert given.columns == columns
        rows = given.collect()
        assert rows
        for r in rows:
            assert all(r[c] == f"{c}{r['doc_id']}" for c in INTERNAL), name
            assert r["a dot.ted name"] == [r["doc_id"]]
    assert "<EMAIL>" in {r["doc_id"]: r["text"] for r in rows}[950]
    assert corpus_pipeline.pack(spark, given, FOLDER).count() > 0
    assigned = sharding.assign_shards(given, "doc_id", F.octet_length("text"), 10_000)
    sharding.write_shards(given, assigned, "doc_id", str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(r["page"] for r in back.collect()) == sorted(r["page"] for r in rows) and "page_" in back.columns
