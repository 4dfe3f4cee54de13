import collections
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom.operators import examples as ex
from textloom.operators import masking, packing, wordpiece
from textloom.operators.vocabulary import Vocabulary, replacement_vocabulary
from textloom.plans import pretraining


def brute_packing(docs, target):
    """One loop per shard."""
    by_shard = collections.defaultdict(list)
    for shard, doc, lens in sorted(docs):
        by_shard[shard].append((doc, lens))
    out = {}
    for shard, rows in by_shard.items():
        total, group = 0, 0
        for doc, lens in rows:
            numbers = []
            for n in lens:
                numbers.append(group)
                total += n
                if total >= target:
                    total, group = 0, group + 1
            out[shard, doc] = numbers
    return out


def numbers(rows):
    return {(r.shard, r.doc_id): [x.grp for x in r.runs for _ in range(x.size)] for r in rows}


@pytest.fixture(scope="module")
def skewed_docs():
    rng = random.Random(3)
    docs = []
    for doc in range(400):
        # one shard holds half of the documents
        shard = "hot" if doc % 2 else f"s{doc % 7}"
        docs.append((shard, doc * 7919 % 100003, [rng.randint(1, 60) for _ in range(rng.randint(1, 12))]))
    docs.append(("long", 1, [500, 1, 1]))
    docs.append(("tiny", 1, [1]))
    return docs


@pytest.mark.parametrize("blocks, fan", [(1, 2), (3, 256), (11, 2), (40, 3)])
def test_packing_equals_the_loop(spark, skewed_docs, blocks, fan):
    df = spark.createDataFrame(skewed_docs, "shard string, doc_id bigint, lens array<int>")
    got = numbers(packing.pack_lines(df, 100, blocks=blocks, fan=fan).collect())
    assert got == brute_packing(skewed_docs, 100)


def test_short_targets_do_not_depend_on_blocks(spark, skewed_docs):
    df = spark.createDataFrame(skewed_docs, "shard string, doc_id bigint, lens array<int>")

    def run(blocks):
        rows = packing.pack_lines(df, 100, 0.5, dupe_factor=2, blocks=blocks, fan=2).collect()
        return {(r.shard, r.dupe, r.doc_id): r.runs for r in rows}

    one, many = run(1), run(9)
    assert one == many and len(one) == 2 * len(skewed_docs)
    assert any(one["hot", 0, d] != one["hot", 1, d] for s, d, _ in skewed_docs if s == "hot")
    lens = {(s, d): n for s, d, n in skewed_docs}
    groups = collections.defaultdict(list)
    for (shard, dupe, doc), runs in one.items():
        for r in runs:
            groups[shard, dupe, r.grp].append((doc, r.target, lens[shard, doc][r.first : r.first + r.size]))
    last = {}
    for shard, dupe, grp in groups:
        last[shard, dupe] = max(last.get((shard, dupe), 0), grp)
    for (shard, dupe, grp), parts in groups.items():
        parts.sort()
        target = max(t for _, t, _ in parts)
        flat = [n for _, _, ns in parts for n in ns]
        assert sum(flat[:-1]) < target
        assert sum(flat) >= target or grp == last[shard, dupe]
        if grp == 0:
            assert target == 100


def test_wordpieces(spark, vocab):
    df = spark.createDataFrame(
        [(["That little blue truck.", "the boat 漢漢", "xyz", "", "a[MASK]b " + "a" * 101],)], "u array<string>"
    )
    row = df.select(wordpiece.tokenise_units(vocab, F.col("u")).alias("p")).first()
    words = [[vocab.tokens[i] for i in unit] for unit in row.p]
    assert words == [
        ["That", "lit", "##tle", "blue", "tru", "##ck", "."],
        ["the", "boa", "##t", "漢", "漢"],
        ["[UNK]"],
        [],
        ["a", "[MASK]", "b", "[UNK]"],
    ]


def test_basic_split_is_the_same_in_both_engines(one):
    raw = "Hi,there\u0007! «é» a_b $5 <s>漢x</s> [UNK]. ½ ・�z"
    row = one(wordpiece.basic_tokens(F.lit(raw)).alias("t"))
    assert row.t == [p for w in raw.split() for p in wordpiece.split_word(w)] == wordpiece.split_word(raw)


def test_replacement_vocabulary(spark):
    table = spark.createDataFrame([("a", 0), ("[unused3]", 1), ("[unusedx", 2), ("[MASK]", 3)], "token string, id int")
    got = {r.token for r in replacement_vocabulary(table).collect()}
    assert got == {"a", "[unusedx", "[MASK]", "[UNK]", "[SEP]", "[PAD]", "[CLS]", "<s>", "</s>"}


def test_vocabulary_checks(spark):
    bad = spark.createDataFrame([("a", 0), ("b", 2)], "token string, id int")
    with pytest.raises(ValueError):
        Vocabulary.from_table(bad)


def grams_of(one, vocab, tokens, whole=True):
    ids = F.array(*[F.lit(vocab.ids[t]) for t in tokens]) if tokens else F.array().cast("array<int>")
    kinds = masking.token_kinds(ids, vocab.kinds(whole))
    return [tuple(s) for s in one(masking.word_spans(kinds).alias("w")).w]


def test_word_spans(one, vocab):
    tokens = ["[CLS]", "That", "lit", "##tle", "blue", "tru", "##ck", "[SEP]"]
    assert grams_of(one, vocab, tokens) == [(1, 2), (2, 4), (4, 5), (5, 7)]
    assert grams_of(one, vocab, tokens, whole=False) == [(i, i + 1) for i in range(1, 7)]
    # a suffix after a special token starts a word, an unknown word belongs to none
    assert grams_of(one, vocab, ["[CLS]", "##ck", "##t", "[UNK]", "##t", "red", "[SEP]"]) == [(1, 3), (4, 5), (5, 6)]
    assert grams_of(one, vocab, ["##t", "red"]) == [(0, 1), (1, 2)]
    assert grams_of(one, vocab, ["[CLS]", "[SEP]"]) == []
    assert grams_of(one, vocab, []) == []


def spans(*pairs):
    return F.array(*[F.struct(F.lit(b).alias("b"), F.lit(e).alias("e")) for b, e in pairs])


def test_ngram_candidates(one):
    row = one(masking.ngram_spans(spans((0, 1), (1, 2), (2, 4)), 3).alias("g"))
    assert [tuple(s) for s in row.g] == [(0, 1), (1, 2), (2, 4), (0, 2), (1, 4), (0, 4)]
    row = one(masking.ngram_spans(spans((0, 1), (2, 3)), 2).alias("g"))
    assert [tuple(s) for s in row.g] == [(0, 1), (2, 3)]
    with pytest.raises(Exception, match="overlapping"):
        one(masking.ngram_spans(spans((0, 2), (1, 3)), 2).alias("g"))


@pytest.mark.parametrize("n,prob,most,expected", [(30, 0.15, 76, 4), (2, 0.15, 76, 1), (512, 0.15, 76, 76), (50, 0.15, 76, 8)])
def test_budget_rounds_half_to_even(one, n, prob, most, expected):
    assert one(masking.mask_budget(F.lit(n), prob, most).alias("b")).b == expected == min(most, max(1, round(n * prob)))


def test_chosen_spans_hold_the_rules():
    rng = random.Random(1)
    for case in range(300):
        edges, at = [], 1
        for _ in range(rng.randint(1, 60)):
            at += rng.random() < 0.1
            size = rng.randint(1, 4)
            edges.append((at, at + size))
            at += size
        begin, end = (np.array(x) for x in zip(*edges, strict=True))
        budget = rng.randint(1, 20)
        chosen = masking.choose_spans(begin, end, 3, budget, case)
        assert sum(e - b for b, e in chosen) <= budget
        for (_, e), (b, _) in zip(chosen, chosen[1:], strict=False):
            assert e <= b
        starts, stops = {b for b, _ in edges}, {e for _, e in edges}
        assert all(b in starts and e in stops for b, e in chosen)


def test_composed_steps_equal_steps_in_a_row():
    rng = random.Random(5)
    for case in range(30):
        blocks = []
        for block in range(rng.randint(2, 6)):
            lens = [rng.randint(1, rng.choice([3, 30])) for _ in range(rng.randint(1, 25))]
            targets = [rng.randint(5, 40) for _ in lens]
            row = {"shard": "s", "dupe": 0, "block": block, "doc_id": 1, "lens": [lens], "targets": [targets], "max_target": 40}
            blocks.append(packing._block_steps(pd.DataFrame(row)))
        steps = pd.concat(blocks, ignore_index=True)
        composed = packing._compose(steps.assign(parent=7)).iloc[0]
        assert composed.block == 7 and composed.upto[-1] >= min(40, composed.total)
        for missing in range(41):
            state, closed = np.array([missing]), 0
            for step in steps.itertuples(index=False):
                state, more = packing._through(step, state)
                closed += more[0]
            assert [x.tolist() for x in packing._through(composed, np.array([missing]))] == [state.tolist(), [closed]]


def test_long_ngrams_are_chosen():
    begin, end = np.arange(200), np.arange(200) + 1
    sizes = {e - b for s in range(40) for b, e in masking.choose_spans(begin, end, 40, 80, s)}
    assert max(sizes) > 20 and 1 in sizes


def test_sizes_are_drawn_with_the_right_weights():
    """Against a direct simulation: draw a size with weight 1/n, pop a candidate."""
    n_words, budget, runs = 400, 80, 300
    begin, end = np.arange(n_words), np.arange(n_words) + 1
    got = [sum(e - b == 1 for b, e in masking.choose_spans(begin, end, 2, budget, s)) for s in range(runs)]
    rng, want = random.Random(0), []
    for _ in range(runs):
        pools = {n: rng.sample(range(n_words - n + 1), n_words - n + 1) for n in (1, 2)}
        taken, used, singles = set(), 0, 0
        while used < budget:
            size = 1 if rng.random() < 2 / 3 else 2
            if not pools[size]:
                continue
            b = pools[size].pop()
            span = set(range(b, b + size))
            if used + size <= budget and not span & taken:
                taken |= span
                used += size
                singles += size == 1
        want.append(singles)
    error = (np.var(got) / runs + np.var(want) / runs) ** 0.5
    assert abs(np.mean(got) - np.mean(want)) < 4 * error


def lines_frame(spark, n_docs=60, seed=5):
    rng = random.Random(seed)
    pick = ["That", "little", "blue", "truck", "red", "boat", "the", ".", "zzz"]
    docs = []
    for d in range(n_docs):
        lines = [" ".join(rng.choice(pick) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 6))]
        docs.append((f"s{d % 3 if d % 2 else 0}", d, lines))
    return spark.createDataFrame(docs, "shard string, doc_id bigint, lines array<string>")


CONFIGS = [
    ex.ExampleConfig(max_seq_length=32, max_predictions_per_seq=6, do_whole_word_mask=True, max_ngram_size=2),
    ex.ExampleConfig(max_seq_length=24, max_predictions_per_seq=4, sentence_pair_prob=1.0, short_seq_prob=0.4),
    ex.ExampleConfig(max_seq_length=8, max_predictions_per_seq=3, long_seq_threshold=1.01, dupe_factor=1),
]


@pytest.mark.parametrize("config", CONFIGS)
def test_examples_hold_the_invariants(spark, vocab, config):
    rows = pretraining.pretraining_examples(lines_frame(spark), vocab, config).collect()
    assert rows
    special = {vocab.ids[t] for t in ("[CLS]", "[SEP]", "[PAD]", "[UNK]", "<s>", "</s>", "[MASK]")}
    assert {r.dupe for r in rows} == set(range(config.dupe_factor))
    for r in rows:
        n = len([w for w in r.masked_lm_weights if w == 1.0])
        assert len(r.input_ids) == len(r.segment_ids) == config.max_seq_length
        assert len(r.masked_lm_positions) == len(r.masked_lm_ids) == config.max_predictions_per_seq
        assert r.next_sentence_labels == [0]
        assert r.masked_lm_positions[:n] == sorted(set(r.masked_lm_positions[:n]))
        assert not special & set(r.masked_lm_ids[:n])
        assert set(r.masked_lm_ids[n:]) <= {0} and set(r.masked_lm_weights[n:]) <= {0.0}
        assert r.input_ids[0] == vocab.ids["[CLS]"]


def test_examples_do_not_depend_on_partitions(spark, vocab):
    def run(parts, blocks):
        df = lines_frame(spark).repartition(parts)
        rows = pretraining.pretraining_examples(df, vocab, CONFIGS[0], blocks=blocks).collect()
        return sorted(map(tuple, rows))

    assert run(1, 1) == run(4, 4) == run(8, 3)


def test_second_segment_appears_with_pairs(spark, vocab):
    rows = pretraining.pretraining_examples(lines_frame(spark), vocab, CONFIGS[1]).collect()
    assert any(1 in r.segment_ids for r in rows)
    for r in rows:
        if 1 in r.segment_ids:
            stop = len(r.segment_ids) - 1 - r.segment_ids[::-1].index(1)
            assert r.input_ids[stop] == vocab.ids["[SEP]"] or stop in r.masked_lm_positions


def test_long_groups_are_cut_and_nothing_is_lost(spark, vocab):
    df = spark.createDataFrame([("s", 1, ["the " * 50])], "shard string, doc_id bigint, lines array<string>")
    config = ex.ExampleConfig(max_seq_length=16, max_predictions_per_seq=4, dupe_factor=1, short_seq_prob=0.0)
    rows = pretraining.pretraining_examples(df, vocab, config).orderBy("chunk").collect()
    assert [sum(i != 0 for i in r.input_ids) for r in rows] == [16, 16, 16, 10]


def test_only_special_tokens_gives_no_masks(spark, vocab):
    df = spark.createDataFrame([("s", 1, ["zzz zzz"])], "shard string, doc_id bigint, lines array<string>")
    rows = pretraining.pretraining_examples(df, vocab, CONFIGS[0]).collect()
    assert rows and all(sum(r.masked_lm_weights) == 0 for r in rows)


def test_config_checks():
    with pytest.raises(ValueError):
        ex.ExampleConfig(max_ngram_size=2)
    with pytest.raises(ValueError):
        ex.ExampleConfig(long_seq_threshold=1.0)
