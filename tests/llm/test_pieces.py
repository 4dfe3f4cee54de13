"""Encoding against the library, the best path against all paths, and round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import example, given, settings
from hypothesis import strategies as st

from textloom.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = pieces.Pieces.from_file(PATH)
ENCODER = pieces.Encoder(MODEL, {})
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
SMALL = pieces.Pieces(["", "▁", "a", "b", "ab", "▁a", "ba", "aba"], [0, -3, -2, -2.5, -3, -4.2, -3.1, -5.4], [0] * 256, False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("the ingab  \n▁é漢\U0001f600") | st.characters(codec="utf-8", exclude_characters="\0")))
@example("  a b\n\tc  d ")
@example("Anlewh sttible " + "x" * 150 + " " + "ab" * 400)
def test_ids_are_those_of_the_library(text):
    ids = np.frombuffer(ENCODER.encode([text])[0], "<u4")
    assert ids.tolist() == LIBRARY.encode(text)
    assert pieces.decode(ids, MODEL.byte_strings()) == text.replace("▁", " ")


def all_paths(unit):
    """Sums of scores of every way to cut a unit, unknown characters ten below the least."""
    found = {t: i for i, t in enumerate(SMALL.texts) if t}
    inside = [SMALL.scores[found[unit[i:j]]] for i in range(len(unit)) for j in range(i + 1, len(unit) + 1) if unit[i:j] in found]
    worst = min([*inside, 0]) - 10

    def walk(at):
        if at == len(unit):
            yield 0.0, []
        for end in range(at + 1, len(unit) + 1):
            piece = unit[at:end]
            if piece in found or end == at + 1:
                for total, rest in walk(end):
                    yield total + (SMALL.scores[found[piece]] if piece in found else worst), [piece, *rest]

    return max(s for s, _ in walk(0))


def path_score(unit, ids):
    found = {i: t for i, t in enumerate(SMALL.texts) if t}
    inside = [SMALL.scores[i] for i, t in found.items() if t in unit]
    worst = min([*inside, 0]) - 10
    return sum(SMALL.scores[i] if i in found else worst for i in ids)


WORDS = ["▁" + "".join(random.Random(i).choices("abc", weights=[5, 5, 1], k=i % 9)) for i in range(60)]


def test_best_path_on_arrays():
    for unit, ids in zip(WORDS, pieces.Lattice(SMALL).encode(WORDS), strict=True):
        assert path_score(unit, ids) == pytest.approx(all_paths(unit))


def test_best_path_by_aggregate(spark):
    words = spark.createDataFrame([(w,) for w in set(WORDS)], "unit string")
    rows = pieces.encode_units(words, spark, SMALL).collect()
    assert len(rows) == len(set(WORDS))
    for r in rows:
        assert path_score(r["unit"], r["ids"]) == pytest.approx(all_paths(r["unit"]))


def test_merges_by_aggregate(spark):
    rng = random.Random(3)
    words = {"".join(rng.choices("theingaloné漢\n", k=rng.randrange(1, 14))) for _ in range(300)} | {"\U0001f600x", "internationalization"}
    table = spark.createDataFrame([("▁" + w,) for w in words], "unit string")
    rows = pieces.encode_units(table, spark, MODEL).collect()
    assert len(rows) == len(words)
    for r in rows:
        assert r["ids"] == LIBRARY.encode(r["unit"][1:])


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(pieces, "COMMON", 5)
    texts = [None, "", "the cat  and the hat\n", "x" * 5000, "the " * 30_000, "same", "same"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").repartition(3)
    out = {r["key"]: r for r in pieces.encode(df, "doc", "text", MODEL, with_ids=True).collect()}
    for i, text in enumerate(texts):
        want = LIBRARY.encode(text or "")
        assert out[i]["ids"] == want and out[i]["n_ids"] == len(want)
        assert out[i]["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        assert out[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert pieces.encode(df.limit(0), "doc", "text", MODEL).count() == 0


def test_common_units_are_bounded(spark):
    text = "a a a a b b b c c d d e"
    df = spark.createDataFrame([(1, text), (2, None)], "doc long, text string")
    for limit, want in ((0, ""), (1, "a"), (2, "ab"), (3, "ab"), (4, "abcd"), (9, "abcd")):
        got = {r["unit"] for r in pieces.common_units(df, "text", limit).collect()}
        assert got == {"▁" + c for c in want}
