"""Words of many texts at once: positions and 64-bit hashes by numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes. A word's hash is a polynomial over
random values of its bytes, taken from prefix sums modulo 2^64 and mixed; runs of words
are hashed the same way over the hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE = 1 << 19
MASK = (1 << 64) - 1
BYTE_BASE = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_byte_values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_white = np.zeros(256, bool)
_white[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base``^i and its inverse modulo 2^64 for i < n, kept in sizes that double."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = tuple(np.full(size, b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        for factors in have:
            factors[0] = 1
            np.multiply.accumulate(factors, out=factors)
        _powers[base] = have
    return have[0][:n], have[1][:n]


def _sums(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[:-1], out=total[1:])
    return total, inverse


def runs(hashes: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbours; empty if there are fewer."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    total, inverse = _sums(hashes, base)
    return mix((total[n:] - total[:-n]) * inverse[: len(hashes) - n + 1])


def sequence(hashes: np.ndarray, base: int) -> int:
    """Hash of a whole sequence; of nothing, too."""
    power, _ = powers(base, len(hashes))
    return int(mix(np.array([(hashes * power).sum(dtype=np.uint64) + np.uint64(len(hashes))], np.uint64))[0])


def _slice_words(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.concatenate([[False], ~_white[buffer], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    total, inverse = _sums(_byte_values[buffer], BYTE_BASE)
    return starts, ends, mix((total[ends] - total[starts]) * inverse[starts])


def word_tables(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The words of texts in slices of about ``SLICE`` bytes.

    Yields first and last text of the slice, and for its words: text number within the
    slice, start and end in the text's bytes, hash. A text longer than a slice comes
    alone, put together from slices cut at white space."""
    at = 0
    while at < len(texts):
        if len(texts[at]) > SLICE:
            starts, ends, hashes, offset = [], [], [], 0
            for part in cut(texts[at], SLICE):
                s, e, h = _slice_words(np.frombuffer(part, np.uint8))
                starts.append(s + offset)
                ends.append(e + offset)
                hashes.append(h)
                offset += len(part)
            h = np.concatenate(hashes)
            yield at, at + 1, np.zeros(len(h), np.int64), np.concatenate(starts), np.concatenate(ends), h
            at += 1
            continue
        to, size = at, 0
        while to < len(texts) and size + len(texts[to]) <= SLICE:
            size += len(texts[to]) + 1
            to += 1
        to = max(to, at + 1)
        s, e, h = _slice_words(np.frombuffer(b" ".join(texts[at:to]), np.uint8))
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[at:to]])])
        of = np.searchsorted(bounds, s, "right") - 1
        yield at, to, of, s - bounds[of], e - bounds[of], h
        at = to


def cut(raw: bytes, size: int) -> Iterator[bytes]:
    """Parts that make up ``raw``, of at most ``size`` bytes where a white space allows."""
    at = 0
    while len(raw) - at > size:
        ends = [raw.rfind(bytes([c]), at, at + size) for c in b" \t\n\v\f\r"]
        end = max(ends) + 1
        if end <= at:
            later = [e for e in (raw.find(bytes([c]), at + size) for c in b" \t\n\v\f\r") if e >= 0]
            if not later:
                break
            end = min(later) + 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every ``n`` neighbours."""
    if len(values) < n:
        return values[:0]
    size, least = 1, values
    while 2 * size <= n:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = n - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
