"""Token ids of documents in files of fixed bit width.

A file holds ids in the fewest bits that number the vocabulary. Ids run through the
documents in ascending key order and are cut into blocks of ``BLOCK`` ids, each
starting on a byte; the footer has the offset of every block and the key and length of
every document, so any range of ids is read by a few seeks and unpacked by numpy.

    magic | block … block | block offsets | keys | lengths | header | header length | magic

All integers are little-endian; ids are packed from the lowest bit up. Documents are
dealt by ranges of the key; each task streams its range into one file with a name of its
own, and only files in the manifest (one row per finished task) count, so a lost or
repeated task does no harm. Folders are reached through ``pyarrow.fs``.

Defined results: a null text is empty (the end id alone); rows without a key are left
out; repeated keys stand side by side, ordered by text; no rows give no files.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.chunks import ChunkEncoder
from textloom.llm.tables import saved
from textloom.session import shared_folder

MAGIC = b"TLBITS01"
BLOCK = 1 << 16
FILE_TEXT_BYTES = 32 << 20
SLICE_BYTES = 8_000_000


def bit_width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids (unsigned 32-bit) from the lowest bit up, padded to a byte."""
    raw = np.ascontiguousarray(ids, dtype="<u4")
    if bits in (8, 16, 32):
        return raw.astype(f"<u{bits // 8}").tobytes()
    flags = np.unpackbits(raw.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(flags.reshape(-1), bitorder="little").tobytes()


def unpack_bits(packed: bytes, bits: int, start: int, n: int) -> np.ndarray:
    """Ids ``start`` to ``start + n`` of a block: a 64-bit window per id."""
    if bits in (8, 16, 32):
        return np.frombuffer(packed, f"<u{bits // 8}", n, start * bits // 8).astype("<u4")
    padded = packed + bytes(8)
    windows = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    at = (np.arange(start, start + n, dtype=np.int64)) * bits
    return ((windows[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4")


class Writer:
    def __init__(self, sink, bits: int):
        self.sink, self.bits = sink, bits
        self.offsets, self.keys, self.lengths = [len(MAGIC)], [], []
        self.open: list[np.ndarray] = []
        self.held = self.total = 0
        sink.write(MAGIC)

    def add(self, key: int, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.lengths.append(len(ids))
        self.open.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= BLOCK:
            joined = np.concatenate(self.open)
            whole = len(joined) // BLOCK * BLOCK
            for at in range(0, whole, BLOCK):
                self._block(joined[at : at + BLOCK])
            self.open, self.held = [joined[whole:]], len(joined) - whole

    def _block(self, ids: np.ndarray) -> None:
        packed = pack_bits(ids, self.bits)
        self.sink.write(packed)
        self.offsets.append(self.offsets[-1] + len(packed))

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.open))
        for values, kind in ((self.offsets, "<u8"), (self.keys, "<i8"), (self.lengths, "<u8")):
            self.sink.write(np.array(values, dtype=kind).tobytes())
        header = json.dumps(
            {"bits": self.bits, "block": BLOCK, "ids": self.total, "blocks": len(self.offsets) - 1, "docs": len(self.keys)}
        ).encode()
        self.sink.write(header + struct.pack("<I", len(header)) + MAGIC)


class Reader:
    """Random access: ``ids(start, n)`` of the file, ``keys`` and ``lengths`` of its documents."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError("not a token file")
        (n,) = struct.unpack("<I", tail[:4])
        header = json.loads(source.read_at(n, size - 12 - n))
        self.bits, self.block, self.total = header["bits"], header["block"], header["ids"]
        blocks, docs = header["blocks"], header["docs"]
        length = 8 * (blocks + 1 + 2 * docs)
        footer = np.frombuffer(source.read_at(length, size - 12 - n - length), "<i8")
        self.offsets, self.keys, self.lengths = np.split(footer, [blocks + 1, blocks + 1 + docs])

    def ids(self, start: int, n: int) -> np.ndarray:
        if start < 0 or n < 0 or start + n > self.total:
            raise IndexError("ids outside the file")
        if n == 0:
            return np.empty(0, "<u4")
        first, last = start // self.block, (start + n - 1) // self.block
        begin = int(self.offsets[first])
        raw = self.source.read_at(int(self.offsets[last + 1]) - begin, begin)
        parts = []
        for block in range(first, last + 1):
            low = max(start, block * self.block)
            high = min(start + n, (block + 1) * self.block)
            packed = raw[int(self.offsets[block]) - begin : int(self.offsets[block + 1]) - begin]
            parts.append(unpack_bits(packed, self.bits, low - block * self.block, high - low))
        return np.concatenate(parts)

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Key, start and ids of every document, read in spans of about 64 blocks."""
        starts = np.concatenate([[0], np.cumsum(self.lengths)])
        at, span = 0, 64 * self.block
        while at < len(self.keys):
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + span, "right")) - 1)
            ids = self.ids(int(starts[at]), int(starts[to] - starts[at]))
            for i in range(at, to):
                low = int(starts[i] - starts[at])
                yield int(self.keys[i]), int(starts[i]), ids[low : low + int(self.lengths[i])]
            at = to


def filesystem(uri: str):
    """The file system and the path of a folder named by a URI or a plain path."""
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


_encoders: dict[int, ChunkEncoder] = {}


def _encoder(tokenizer: str) -> ChunkEncoder:
    """One encoder, and so one cache, per Python worker."""
    key = zlib.crc32(tokenizer.encode())
    if key not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _encoders[key] = ChunkEncoder(Tokenizer.from_str(tokenizer))
    return _encoders[key]


def _slices(keys: pa.Array, texts: pa.Array) -> Iterator[tuple[list[int], pa.Array]]:
    """Rows in groups of some million bytes; a null text is empty."""
    texts = pc.fill_null(texts, "")
    before = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    at = 0
    while at < len(keys):
        done = before[at - 1] if at else 0
        to = int(np.searchsorted(before, done + SLICE_BYTES)) + 1
        yield keys.slice(at, to - at).to_pylist(), texts.slice(at, to - at)
        at = to


MANIFEST = "file string, first_key long, part int, n_ids long, n_docs long"


def _writing(tokenizer: str, end_id: int, bits: int, folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer = sink = None
        for batch in batches:
            for keys, texts in _slices(batch.column(0), batch.column(1)):
                if writer is None:
                    files, path = filesystem(folder)
                    name = f"{uuid.uuid4().hex}.ids"
                    files.create_dir(path, recursive=True)
                    sink = files.open_output_stream(f"{path}/{name}")
                    writer = Writer(sink, bits)
                ids, bounds = _encoder(tokenizer).encode_all(texts, end_id)
                for key, low, high in zip(keys, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    writer.add(key, ids[low:high])
        if writer is not None:
            writer.close()
            sink.close()
            row = [f"{folder.rstrip('/')}/{name}", writer.keys[0], TaskContext.get().partitionId(), writer.total, len(writer.keys)]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, kinds, strict=True)], ["file", "first_key", "part", "n_ids", "n_docs"]
            )

    return write


def write_ids(df: DataFrame, key: str, text: str, tokenizer: str, vocabulary: int, end_id: int, folder: str) -> DataFrame:
    """Encode and write; the manifest, one row per file: ``file, first_key, part, n_ids, n_docs``.

    ``tokenizer`` is the JSON of a byte-level BPE tokeniser, which travels with the tasks.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // FILE_TEXT_BYTES))
    ordered = rows.repartitionByRange(parts, "key").sortWithinPartitions("key", "text")
    return saved(ordered.mapInArrow(_writing(tokenizer, end_id, bit_width(vocabulary), folder), MANIFEST))


def file_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``file_start``, the ids of all files before; a row per file."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("file_start", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))


DOCUMENT = "key long, start long, n_tokens long, ids_crc32 long"


def _checks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            files, path = filesystem(file)
            with files.open_input_file(path) as source:
                rows = [
                    (key, base + start, len(ids), zlib.crc32(ids.tobytes()))
                    for key, start, ids in Reader(source).documents()
                ]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "start", "n_tokens", "ids_crc32"])


def document_checks(manifest: DataFrame) -> DataFrame:
    """Every document as the files have it: ``key``, ``start`` among all ids, ``n_tokens``
    and the CRC-32 of its ids as little-endian unsigned 32-bit integers."""
    files = file_starts(manifest).select("file", "file_start")
    return files.repartition("file").mapInArrow(_checks, DOCUMENT)


def ids_folder(df: DataFrame) -> str:
    """A new folder for token files in the shared folder."""
    return f"{shared_folder(df.sparkSession).rstrip('/')}/ids-{uuid.uuid4().hex}"


