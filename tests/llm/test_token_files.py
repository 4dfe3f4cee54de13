"""Token files: chunked encoding, bit packing, and the round trip through files."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import chunks, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab Zé'st1!  \n\t\r\x1c\x85\xa0 ​　漢\U0001f600<|>") | st.characters(codec="utf-8")))
@example("a  b \n c  d <|endoftext|> e<|endoftext|> ")
@example("  x   y ")
@example("ab cd. ef, x's. é! 漢. 1. <|endoftext|>. cd ef.. Z?")
@example(" ")
def test_chunked_ids_are_those_of_the_whole_text(text):
    ids = np.frombuffer(chunks.ChunkEncoder(LIBRARY).encode([text])[0], "<u4").tolist()
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids


def test_the_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(chunks, "CACHE_CHUNKS", 3)
    encoder = chunks.ChunkEncoder(LIBRARY)
    for text in ("a b c d e f", "a b c", "q " + "x" * 500 + " r"):
        got = np.frombuffer(encoder.encode([text])[0], "<u4").tolist()
        assert got == LIBRARY.encode(text, add_special_tokens=False).ids
        assert len(encoder.cache) <= 6 and all(len(c) <= chunks.CACHE_CHARS for c in encoder.cache)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 32), st.data())
def test_bits_round_trip_from_any_place(bits, data):
    ids = data.draw(st.lists(st.integers(0, 2**bits - 1), min_size=1, max_size=200))
    packed = token_files.pack_bits(np.array(ids, dtype=np.uint32), bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    start = data.draw(st.integers(0, len(ids) - 1))
    assert token_files.unpack_bits(packed, bits, start, len(ids) - start).tolist() == ids[start:]


def test_width():
    assert [token_files.bit_width(n) for n in (1, 2, 3, 256, 257, 50_257, 65_536)] == [1, 1, 2, 8, 9, 16, 16]


@pytest.mark.parametrize("bits", [16, 17])
def test_random_access(bits, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 8)
    sink = pa.BufferOutputStream()
    writer = token_files.Writer(sink, bits)
    docs = [(7 * k, np.arange(k, 2 * k, dtype="<u4")) for k in range(12)]
    for key, ids in docs:
        writer.add(key, ids)
    writer.close()
    reader = token_files.Reader(pa.BufferReader(sink.getvalue()))
    flat = np.concatenate([ids for _, ids in docs])
    for start in range(len(flat)):
        for n in (0, 1, 5, 9, len(flat) - start):
            if start + n <= len(flat):
                assert reader.ids(start, n).tolist() == flat[start : start + n].tolist()
    assert [(k, ids.tolist()) for k, _, ids in reader.documents()] == [(k, ids.tolist()) for k, ids in docs]
    with pytest.raises(IndexError):
        reader.ids(len(flat), 1)


def test_documents_come_back_in_key_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_TEXT_BYTES", 300)
    texts = ["", None, "hello  world", "Ünï <|endoftext|> x", "w " * 3000, "same", "same"]
    rows = [(11 * i % 97 - 5, texts[i % len(texts)]) for i in range(60)] + [(3, "same"), (3, "again"), (None, "no key")]
    df = spark.createDataFrame(rows, "doc long, text string").withColumn("key", F.lit(1)).repartition(5)
    with open(PATH) as file:
        manifest = token_files.write_ids(df, "doc", "text", file.read(), 50_257, 2, str(tmp_path / "ids"))
    assert manifest.count() > 1
    got = sorted(tuple(r) for r in token_files.document_checks(manifest).collect())
    want, at = [], 0
    for key, text in sorted(((k, t or "") for k, t in rows if k is not None)):
        ids = np.array([*LIBRARY.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "doc long, text string")
    with open(PATH) as file:
        manifest = token_files.write_ids(empty, "doc", "text", file.read(), 50_257, 2, str(tmp_path))
    assert token_files.document_checks(manifest).count() == 0
