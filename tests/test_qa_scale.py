"""What a task of the question answering features holds, and that long documents come out whole."""

import re

from pyspark.sql import functions as F

from textloom.functions import text as txt
from textloom.operators import qa_features as qa
from textloom.operators import wordpiece as wp
from textloom.operators.vocabulary import SPECIAL_TOKENS, Vocabulary

WORDS = [f"w{i}" for i in range(40)]
CONFIG = qa.WindowConfig(max_seq_length=24, doc_stride=8, max_query_length=4)
SCHEMA = f"doc_id bigint, context string, qas {qa.QAS_TYPE}"


def vocabulary():
    tokens = [*SPECIAL_TOKENS.values(), *WORDS]
    return Vocabulary(tokens, {t: i for i, t in enumerate(tokens)})


def asked(spark, *contexts):
    rows = [(i, c, [(f"{i}-{k}", " ".join(WORDS[: k + 1]), False, [("w3", 9)]) for k in range(2)]) for i, c in enumerate(contexts)]
    return spark.createDataFrame(rows, SCHEMA)


def python_calls(df):
    return len(re.findall("ArrowEvalPython|MapInArrow|BatchEvalPython", df._jdf.queryExecution().executedPlan().toString()))


def test_a_task_has_one_python_worker(spark):
    rows = asked(spark, " ".join(WORDS))
    assert python_calls(qa.eval_features(rows, vocabulary(), CONFIG, ["doc_id"])) == 1
    assert python_calls(qa.train_features(rows, vocabulary(), CONFIG, ["doc_id"])) == 1


def test_contexts_are_split_as_by_the_expression(spark):
    contexts = ["   w1  w2\t(w3)\r\nw4\xa0w5 x w6\n ", "", None, "w7", " \n", "　w8 \x0b w9"]
    texts = [["w1 (w2)", None], [], None, [""], ["w3"], ["w4 w5"]]
    rows = spark.createDataFrame(list(enumerate(contexts)), "i int, c string").join(
        spark.createDataFrame(list(enumerate(texts)), "i int, t array<string>"), "i"
    )
    for size in (1, 2, 100_000):
        call = wp.tokenise_contexts(vocabulary(), F.col("c"), F.col("t"), max_words=size)
        got = rows.withColumn("got", call).select("i", "got.*")
        apart = F.transform(txt.words(F.col("c")), lambda w: F.array(w))
        pieces = rows.select("i", wp.wordpiece(vocabulary())(apart).alias("p"), wp.tokenise_units(vocabulary(), F.col("t")).alias("t0"))
        number = F.flatten(F.transform("p", lambda p, i: F.array_repeat(i, F.size(p))))
        want = pieces.select("i", F.flatten("p").alias("tokens"), number.alias("token_word"), "t0")
        assert sorted(got.collect()) == sorted(want.collect())


def test_windows_of_long_documents(spark):
    """More windows than a block has, and as many as fill one exactly."""
    stride, length = CONFIG.doc_stride, CONFIG.max_seq_length
    contexts = [" ".join(WORDS[i % 40] for i in range(n)) for n in (1, 20, 15 * stride + 20, 15 * stride + 21, 31 * stride + 20, 400)]
    vocab = vocabulary()
    got = {r.unique_id: r for r in qa.eval_features(asked(spark, *contexts), vocab, CONFIG, ["doc_id"]).collect()}
    seen = 0
    for i, context in enumerate(contexts):
        words = context.split()
        for k in range(2):
            query = WORDS[: k + 1]
            room = length - len(query) - 3
            starts = [0]
            while starts[-1] + room < len(words):
                starts.append(starts[-1] + stride)
            for w, start in enumerate(starts):
                r = got[f"{i}-{k}_{w}"]
                part = words[start : start + room]
                framed = ["[CLS]", *query, "[SEP]", *part, "[SEP]"]
                assert [vocab.tokens[t] for t in r.input_ids] == framed + ["[PAD]"] * (length - len(framed))
                assert sum(r.attention_mask) == len(framed) and sum(r.token_type_ids) == len(part) + 1
                assert r.token_to_orig_map == list(range(start, start + len(part))) and r.window_words == part
                assert (r.doc_offset, r.paragraph_len, len(r.token_is_max_context)) == (len(query) + 2, len(part), len(part))
                seen += 1
    assert seen == len(got)


def test_slices_are_not_taken_for_readers_of_numbers(spark):
    rows = qa.eval_features(asked(spark, " ".join(WORDS)), vocabulary(), CONFIG, ["doc_id"])
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(token_word" in plan(rows.select("token_to_orig_map"))
    assert not re.search("slice\\((tokens|token_word|words)", plan(rows.select("id", "unique_id", "paragraph_len")))
