"""Tokenisation: whitespace words and word pieces in Arrow batches.

A join of exploded words against the vocabulary would shuffle every word of the
corpus twice, with a handful of words holding a large share of the rows. Here
nothing is shuffled: the vocabulary travels with the task, each Arrow batch
dictionary-encodes its words, and punctuation split and greedy match run once per
distinct word.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.operators.vocabulary import SPECIAL_TOKENS, UNK, Vocabulary

MAX_WORD_CHARS = 100
PIECES_TYPE = pa.list_(pa.list_(pa.int32()))

# Code-point ranges split into single characters.
CJK_RANGES = [
    (0x4E00, 0x9FFF),
    (0x3400, 0x4DBF),
    (0x20000, 0x2A6DF),
    (0x2A700, 0x2B73F),
    (0x2B740, 0x2B81F),
    (0x2B820, 0x2CEAF),
    (0xF900, 0xFAFF),
    (0x2F800, 0x2FA1F),
]
_CJK = "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in CJK_RANGES)
_PUNCT = "!-/:-@\\[-`{-~\\p{P}"
_SPACE = "\\t\\n\\r\\p{Z}"
_SPECIAL = "|".join("".join("\\" + c if c in "[]" else c for c in t) for t in SPECIAL_TOKENS.values())
BASIC_PATTERN = f"({_SPECIAL}|[{_PUNCT}{_CJK}]|[^{_SPACE}{_PUNCT}{_CJK}]+)"
_SPECIAL_SET = frozenset(SPECIAL_TOKENS.values())
_SPECIAL_RE = re.compile(f"({_SPECIAL})")
_ASCII_RE = re.compile("[!-/:-@\\[-`{-~]|[^ !-/:-@\\[-`{-~]+")
_ASCII_SPECIAL_RE = re.compile(f"{_SPECIAL}|{_ASCII_RE.pattern}")
# The characters of _SPACE, for the Python side.
_SPACE_RE = re.compile("[\t\n\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
# The characters between the words of a context, WORD_SPACE of the text expressions.
_WORD_SPACE = " \t\r\n\u202f"
_CONTROL = "[\\p{C}\\x{FFFD}&&[^\\t\\n\\r]]"


def basic_tokens(text: Column) -> Column:
    """Whitespace, punctuation and CJK split of one text; case and accents stay."""
    return F.regexp_extract_all(F.regexp_replace(text, _CONTROL, ""), F.lit(BASIC_PATTERN), F.lit(1))


def whitespace_words(text: Column) -> Column:
    """Whitespace words of one text, the units that are encoded."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{_SPACE}]+"), lambda w: w != "")


def _alone(char: str) -> bool:
    """Punctuation and CJK characters are words of their own."""
    code = ord(char)
    if 33 <= code <= 47 or 58 <= code <= 64 or 91 <= code <= 96 or 123 <= code <= 126:
        return True
    return code > 127 and (
        unicodedata.category(char).startswith("P") or any(lo <= code <= hi for lo, hi in CJK_RANGES)
    )


def split_word(word: str, keep_special: bool = True) -> list[str]:
    """The same split as :func:`basic_tokens`, for one word or short text."""
    if word.isascii() and word.isalnum():
        return [word]
    if word.isascii() and word.isprintable():
        return (_ASCII_SPECIAL_RE if keep_special else _ASCII_RE).findall(word)
    word = "".join(c for c in word if c in "\t\n\r" or c != "\ufffd" and unicodedata.category(c)[0] != "C")
    if _SPACE_RE.search(word):
        return [part for w in _SPACE_RE.split(word) if w for part in split_word(w, keep_special)]
    parts = []
    for chunk in _SPECIAL_RE.split(word) if keep_special else [word]:
        if keep_special and chunk in _SPECIAL_SET:
            parts.append(chunk)
        else:
            for alone, run in itertools.groupby(chunk, _alone):
                parts.extend(run if alone else ["".join(run)])
    return parts


#: Pieces by their text, and their lengths by their first character, longest first.
Pieces = tuple[dict[str, int], dict[str, tuple[int, ...]]]


def pieces_by_start(ids: dict[str, int]) -> tuple[Pieces, Pieces]:
    """The pieces that may begin a word, and those inside one, without their mark."""
    inside = {token[2:]: i for token, i in ids.items() if token.startswith("##")}
    tables = []
    for known in (ids, inside):
        sizes: dict[str, set[int]] = {}
        for token in known:
            if token:
                sizes.setdefault(token[0], set()).add(len(token))
        tables.append((known, {c: tuple(sorted(n, reverse=True)) for c, n in sizes.items()}))
    return tables[0], tables[1]


def longest_match(word: str, ids: dict[str, int], unknown: int, tables: tuple[Pieces, Pieces] | None = None) -> list[int]:
    """Greedy longest-match-first pieces of one word: only lengths that some piece with the
    next character has (``tables``, of :func:`pieces_by_start`) are tried."""
    if len(word) > MAX_WORD_CHARS:
        return [unknown]
    (known, sizes), inside = tables or pieces_by_start(ids)
    pieces: list[int] = []
    begin = 0
    while begin < len(word):
        for size in sizes.get(word[begin], ()):
            # at the end of the word this may be shorter: then it is all that is left
            piece = known.get(word[begin : begin + size])
            if piece is not None:
                break
        else:
            return [unknown]
        pieces.append(piece)
        begin += size
        known, sizes = inside
    return pieces


def _pieces_of_words(words: pa.Array, known: dict[str, list[int]], match, max_remembered: int) -> tuple[np.ndarray, np.ndarray]:
    """The piece ids of ``words`` one after the other, and the place at which each word
    begins, with the end behind the last; ``known`` gains words until it has ``max_remembered``."""
    words = words.dictionary_encode()
    distinct = []
    for word in words.dictionary.to_pylist():
        pieces = known.get(word)
        if pieces is None:
            pieces = match(word)
            if len(known) < max_remembered:
                known[word] = pieces
        distinct.append(pieces)
    size = np.array([len(p) for p in distinct], dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    flat = np.array([i for p in distinct for i in p], dtype=np.int32)
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    word_end = np.concatenate([[0], np.cumsum(size[codes])]).astype(np.int64) if len(codes) else np.zeros(1, np.int64)
    take = np.repeat(start[codes] - word_end[:-1], size[codes]) + np.arange(word_end[-1]) if len(codes) else codes
    return flat[take], word_end


def _offsets(lengths: pa.Array) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _pieces_of_batch(batch: pa.ListArray, known: dict[str, list[int]], match, max_remembered: int) -> pa.ListArray:
    """``list<list<string>>`` of words to ``list<list<int>>`` of piece ids."""
    units = batch.flatten()
    pieces, word_end = _pieces_of_words(units.flatten(), known, match, max_remembered)
    inner = pa.ListArray.from_arrays(pa.array(word_end[_offsets(units.value_lengths())].astype(np.int32)), pa.array(pieces))
    return pa.ListArray.from_arrays(pa.array(_offsets(batch.value_lengths()).astype(np.int32)), inner)


def _context_of_batch(batch: pa.ListArray, known: dict[str, list[int]], match, max_remembered: int) -> tuple[pa.ListArray, pa.ListArray]:
    """``list<list<string>>`` with the words of one text a row to its piece ids and, for
    each, the number of its word."""
    first = _offsets(batch.flatten().value_lengths())
    pieces, word_end = _pieces_of_words(batch.flatten().flatten(), known, match, max_remembered)
    number = np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))
    offsets = pa.array(word_end[first].astype(np.int32))
    words = pa.array(np.repeat(number, np.diff(word_end)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(pieces)), pa.ListArray.from_arrays(offsets, words)


def _slices(batch: pa.ListArray, max_words: int) -> Iterator[pa.ListArray]:
    """Neighbouring rows with at most ``max_words`` words together, or one row with more."""
    units = batch.flatten().value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(units, dtype=np.int64)])[np.concatenate([[0], np.cumsum(rows, dtype=np.int64)])]
    begin = 0
    while begin < len(batch):
        end = max(begin + 1, int(np.searchsorted(before, before[begin] + max_words, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def _text_slices(batch: pa.ListArray, max_bytes: int) -> Iterator[pa.ListArray]:
    """Neighbouring rows of texts with at most ``max_bytes`` together, or one row with more."""
    sizes = pc.fill_null(pc.binary_length(batch.flatten()), 0).to_numpy(zero_copy_only=False)
    rows = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[np.concatenate([[0], np.cumsum(rows, dtype=np.int64)])]
    begin = 0
    while begin < len(batch):
        end = max(begin + 1, int(np.searchsorted(before, before[begin] + max_bytes, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def _split_units(batch: pa.ListArray) -> pa.ListArray:
    """``list<string>`` to ``list<list<string>>``: whitespace words of each text, as of
    :func:`whitespace_words` but for empty ones at the ends, which have no pieces."""
    texts = pc.fill_null(batch.flatten(), "")
    words = pc.split_pattern_regex(texts, _SPACE_RE.pattern) if len(texts) else pa.array([], pa.list_(pa.string()))
    rows = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rows)]).astype(np.int32)), words)


def _split_words(batch: pa.ListArray) -> pa.ListArray:
    """``list<string>`` to ``list<list<string>>``: the words of each text; an empty one has
    one empty word, which has no pieces."""
    texts = pc.utf8_trim(batch.flatten(), _WORD_SPACE)
    words = pc.split_pattern_regex(texts, f"[{_WORD_SPACE}]+") if len(texts) else pa.array([], pa.list_(pa.string()))
    return pa.ListArray.from_arrays(pa.array(_offsets(batch.value_lengths()).astype(np.int32)), words)


def wordpiece(vocab: Vocabulary, max_remembered: int = 50_000, max_words: int = 100_000, units: str = "lists"):
    """A column function ``array<array<string>> -> array<array<int>>``: the
    whitespace words of each unit (a line, a text) become its piece ids. Units may also be
    strings (``array<string>``), ``texts``, split by the batch.

    What a worker holds is bounded: the pieces of ``max_remembered`` words (the first ones
    met, among them the frequent ones) and of the words of some rows."""
    match = _matcher(vocab)

    @F.arrow_udf("array<array<int>>")
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, list[int]] = {}
        matched = match()
        for batch in batches:
            if units == "texts":
                yield _pieces_of_texts(batch, known, matched, max_remembered, max_words)
            else:
                parts = [_pieces_of_batch(part, known, matched, max_remembered) for part in _slices(batch, max_words)]
                yield pa.concat_arrays(parts) if parts else pa.array([], PIECES_TYPE)

    # keeps the optimizer from copying the call into filters placed after it
    return pieces.asNondeterministic()


def _matcher(vocab: Vocabulary):
    """Makes, in a worker, the function from a word to its piece ids."""
    ids, unknown = vocab.ids, vocab.ids[UNK]

    def make():
        tables = pieces_by_start(ids)
        return lambda word: [i for part in split_word(word) for i in longest_match(part, ids, unknown, tables)]

    return make


def _pieces_of_texts(batch: pa.ListArray, known: dict[str, list[int]], match, max_remembered: int, max_words: int) -> pa.ListArray:
    """``list<string>`` of texts to ``list<list<int>>`` of piece ids, slice by slice."""
    parts = [
        _pieces_of_batch(part, known, match, max_remembered)
        for texts in _text_slices(batch, 10 * max_words)
        for part in _slices(_split_units(texts), max_words)
    ]
    return pa.concat_arrays(parts) if parts else pa.array([], PIECES_TYPE)


def tokenise_units(vocab: Vocabulary, units: Column) -> Column:
    """Piece ids of each string of an array."""
    return wordpiece(vocab, units="texts")(units)


def tokenise_contexts(vocab: Vocabulary, context: Column, *texts: Column, max_remembered: int = 50_000, max_words: int = 100_000) -> Column:
    """In one call, so that a task has one Python worker and texts go there as they are:
    ``tokens`` of a text, ``token_word`` with the number of each token's word (as of
    :func:`textloom.functions.text.words`), and for each further column of strings the
    piece ids of each of them, as ``t0, t1, …``."""
    match = _matcher(vocab)
    names = ["tokens", "token_word", *[f"t{k}" for k in range(len(texts))]]

    @F.arrow_udf("struct<tokens:array<int>,token_word:array<int>" + "".join(f",t{k}:array<array<int>>" for k in range(len(texts))) + ">")
    def pieces(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        known: dict[str, list[int]] = {}
        matched = match()
        for contexts, *others in batches:
            # a text is the one unit of its row
            alone = pa.ListArray.from_arrays(pa.array(np.arange(len(contexts) + 1, dtype=np.int32)), contexts.fill_null(""))
            parts = [
                _context_of_batch(part, known, matched, max_remembered)
                for some in _text_slices(alone, 10 * max_words)
                for part in _slices(_split_words(some), max_words)
            ]
            lists = [pa.concat_arrays(x) for x in zip(*parts, strict=True)] or [pa.array([], pa.list_(pa.int32()))] * 2
            lists += [_pieces_of_texts(x, known, matched, max_remembered, max_words) for x in others]
            yield pa.StructArray.from_arrays(lists, names)

    return pieces.asNondeterministic()(context, *texts)


def tokenise_text(vocab: Vocabulary, text: Column) -> Column:
    """Piece ids of one text."""
    return wordpiece(vocab, units="texts")(F.array(text))[0]
