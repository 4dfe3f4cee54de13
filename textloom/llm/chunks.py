"""Byte-level BPE of whole texts through a cache of word chunks.

The pre-tokeniser never puts a non-space character and a following white space into
one token and looks only ahead, so a text may be cut before every space that follows
a non-space; each chunk is encoded by the tokenizers library, and a chunk seen before
comes from a bounded cache.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# fixed values: characters some tokeniser counts as white space
WHITE_RANGES = ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E),
                (0x2000, 0x200B), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF))
WHITE = "".join(chr(c) for low, high in WHITE_RANGES for c in range(low, high + 1))
ASCII_WHITE = [c for c in WHITE if ord(c) < 128]
OTHER_WHITE = [c for c in WHITE if ord(c) >= 128]
CACHE_CHUNKS, CACHE_CHARS = 1_000_000, 64
JOINED = 256


def chunks(text: str) -> list[str]:
    """The first chunk as it is, the others without the space they start with."""
    parts = text.split(" ")
    if any(c + " " in text for c in ASCII_WHITE) or (
        not text.isascii() and any(c + " " in text for c in OTHER_WHITE)
    ):
        out = parts[:1]
        for part in parts[1:]:
            before = out[-1]
            if (before == "" and len(out) > 1) or (before and before[-1] in WHITE):
                out[-1] = f"{before} {part}"
            else:
                out.append(part)
        return out
    return parts


def stem(chunk: str) -> str | None:
    """A chunk without the mark at its end, where the two never share a token: no token
    has a letter and then a mark. Only for letters every Unicode version knows."""
    if len(chunk) > 1 and chunk[-1] in ".,;:!?" and chunk[-2] < "\u0250" and chunk[-2].isalpha():
        return chunk[:-1]
    return None


SPACED = f"[{re.escape(WHITE)}] "


def _chunk_lists(texts: pa.Array) -> pa.Array:
    """The chunks of every text: cut at every space, but where white space stands before it."""
    lists = pc.split_pattern(texts, " ")
    odd = pc.match_substring_regex(texts, SPACED).to_numpy(zero_copy_only=False)
    if not odd.any():
        return lists
    at, others = np.flatnonzero(odd), np.flatnonzero(~odd)
    own = pa.array([chunks(t) for t in texts.take(pa.array(at)).to_pylist()], lists.type)
    both = pa.concat_arrays([lists.take(pa.array(others)), own])
    return both.take(pa.array(np.argsort(np.concatenate([others, at]), kind="stable")))


class ChunkEncoder:
    """Token ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.cache: dict[str, bytes] = {}
        (self.feed,) = tokenizer.encode("\n", add_special_tokens=False).ids
        self.marks = dict(zip(".,;:!?", self._ids(list(".,;:!?")), strict=True))

    def _ids(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in encoded]

    def _spaced(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks with the space they start with.

        Plain ones go to the library many to a line, ``" a\\n b\\n c"``: a line feed before
        a space is a token of its own, which no chunk without white space holds."""
        plain = [c for c in chunks if c.split() == [c] and "<|" not in c]
        lines = [plain[at : at + JOINED] for at in range(0, len(plain), JOINED)]
        encoded = self.tokenizer.encode_batch_fast(["\n".join(f" {c}" for c in line) for line in lines], add_special_tokens=False)
        found: dict[str, bytes] = {}
        for line, e in zip(lines, encoded, strict=True):
            ids = np.array(e.ids, dtype="<u4")
            feeds = np.flatnonzero(ids == self.feed).tolist()
            if len(feeds) == len(line) - 1:
                raw = ids.tobytes()
                for chunk, low, high in zip(line, [-1, *feeds], [*feeds, len(ids)], strict=True):
                    found[chunk] = raw[4 * low + 4 : 4 * high]
        rest = [c for c in chunks if c not in found]
        found.update(zip(rest, self._ids([f" {c}" for c in rest]), strict=True))
        return [found[c] for c in chunks]

    def _found(self, used: list[str]) -> list[bytes]:
        """Ids of distinct chunks with the space they start with, through the cache."""
        cache = self.cache
        missing = [c for c in used if c not in cache]
        stems = {c: own for c in missing if (own := stem(c))}
        new = list(dict.fromkeys(own for own in stems.values() if own not in cache))
        plain = {*new}
        new += [c for c in missing if c not in stems and c not in plain]
        cache.update(zip(new, self._spaced(new), strict=True))
        for chunk, own in stems.items():
            cache[chunk] = cache[own] + self.marks[chunk[-1]]
        out = [cache[c] for c in used]
        if len(cache) > CACHE_CHUNKS:
            # what the last texts used stays
            self.cache = {c: ids for c, ids in zip(used, out, strict=True) if len(c) <= CACHE_CHARS}
        else:
            for chunk in [*new, *stems]:
                if len(chunk) > CACHE_CHARS:
                    del cache[chunk]
        return out

    def encode_all(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, with ``end_id`` after each, and where each
        text begins (one more than texts). Every distinct chunk is looked up once, and the
        ids are gathered by number of the chunk."""
        lists = _chunk_lists(texts)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets, flat = offsets - offsets[0], lists.flatten()
        first = offsets[:-1]
        later = np.ones(len(flat), bool)
        later[first] = False
        coded = flat.filter(pa.array(later)).dictionary_encode()
        known = self._found(coded.dictionary.to_pylist())
        known += self._ids(flat.take(pa.array(first)).to_pylist())
        end = [] if end_id is None else [np.array([end_id], "<u4").tobytes()]
        ids = np.frombuffer(b"".join(known + end), "<u4")
        sizes = np.fromiter(map(len, known + end), np.int64, len(known) + len(end)) // 4
        number = np.empty(len(flat), np.int64)
        number[later] = coded.indices.to_numpy()
        number[first] = len(coded.dictionary) + np.arange(len(first))
        if end:
            number = np.insert(number, offsets[1:], len(known))
            offsets = offsets + np.arange(len(offsets))
        before = np.concatenate([[0], np.cumsum(sizes[number])])
        begins = np.cumsum(sizes) - sizes
        at = np.repeat(begins[number] - before[:-1], sizes[number]) + np.arange(before[-1])
        return ids[at], before[offsets]

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, bounds = self.encode_all(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
