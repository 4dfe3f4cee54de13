"""Language identification by error-correcting output codes over character n-grams.

Every language has a codeword of bits. For each bit a naive Bayes classifier over hashed
character n-grams (one to three letters of the lower-cased text, everything else a space)
says how much a text speaks for the languages whose bit is set. Decoding adds up, over
the bits, a logistic loss of the margin against each codeword, weighted by how well the
bit's two sides lie apart in training, and takes the nearest codeword. A text is
ambiguous where the runner-up is nearly as near.

Training needs n-gram counts per language only: they are summed per task, then by Spark,
over all training rows, and as many counts as languages times ``BUCKETS`` reach the driver.
Texts are read whole, in parts of ``PART`` characters.

Defined results: a null text or one without a letter is ``und`` with score 0, and so is
every text if nothing was learned; rows without a language or text teach nothing;
repeated rows count each time.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.tables import free_name

UNDETERMINED = "und"
BUCKET_BITS = 13
BUCKETS = 1 << BUCKET_BITS
PART = 1 << 20
SLICE_CHARS, SLICE_TEXTS = 1 << 18, 128
SHARPNESS = 8.0
AMBIGUOUS = 0.5  # the runner-up's share of the winner's probability

_letters: np.ndarray | None = None


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters[codes]


def _parts(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Parts of texts with the number of their text, in slices."""
    of, held, size = [], [], 0
    for i, text in enumerate(texts):
        text = text or ""
        for at in range(0, max(len(text), 1), PART):
            of.append(i)
            held.append(text[at : at + PART])
            size += len(held[-1])
            if size >= SLICE_CHARS or len(held) >= SLICE_TEXTS:
                yield of, held
                of, held, size = [], [], 0
    if held:
        yield of, held


def gram_counts(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed 1- to 3-grams per part, and of its letters."""
    lowered = [f"{p.lower()} " for p in parts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    of = np.repeat(np.arange(len(parts)), [len(p) for p in lowered])
    letter = _is_letter(codes)
    x = np.where(letter, codes, 32).astype(np.uint32)
    grams = [x * np.uint32(0x9E3779B1)]
    for step in (1, 2):
        before = grams[-1]
        grams.append((before[:-1] ^ (before[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + x[step:] * np.uint32(0xC2B2AE3D))
    counts = np.zeros(len(parts) * BUCKETS, np.int64)
    spoken = letter
    for step, gram in enumerate(grams):
        if step:
            spoken = spoken[:-1] | letter[step:]
        own = of[: len(gram)]
        inside = spoken & (own == of[step:]) if step else spoken
        mixed = (gram ^ (gram >> np.uint32(13))) * np.uint32(0x27D4EB2F)
        bucket = (mixed >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)
        counts += np.bincount(own[inside] * BUCKETS + bucket[inside], minlength=len(counts))
    return counts.reshape(len(parts), BUCKETS), np.bincount(of[letter], minlength=len(parts))


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per language over all rows of a task."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        labels, texts = (c.to_pylist() for c in batch.columns)
        for of, parts in _parts(texts):
            counts, _ = gram_counts(parts)
            names = np.array([labels[i] for i in of], dtype=object)
            for name in set(names):
                sums = counts[names == name].sum(0)
                totals[name] = totals[name] + sums if name in totals else sums
    for name, sums in totals.items():
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(sums[used], pa.int64())],
            ["label", "bucket", "n"],
        )


def codewords(n: int) -> np.ndarray:
    """A bit matrix, one row per language. Up to seven languages: every way to part them
    in two. More: the best of many random codes by the least distance of two rows."""
    if n == 1:
        return np.ones((1, 1), np.int8)
    if n <= 7:
        rest = list(itertools.product((0, 1), repeat=n - 1))[:-1]
        return np.array([[1] * len(rest), *zip(*rest, strict=True)], np.int8)
    rng = np.random.default_rng(7)
    width = int(np.ceil(10 * np.log2(n)))
    best, score = None, -1
    for _ in range(200):
        code = rng.integers(0, 2, (n, width), np.int8)
        code = code[:, (code.min(0) == 0) & (code.max(0) == 1)]
        apart = (code[:, None, :] != code[None, :, :]).sum(2) + np.eye(n, dtype=int) * width
        if apart.min() > score:
            best, score = code, int(apart.min())
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # buckets x bits, log odds scaled to a margin of 1 in training
    trust: np.ndarray  # weight of each bit's loss

    def decide(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its probability and the runner-up's, per row."""
        total = np.maximum(counts.sum(1, keepdims=True), 1)
        margins = (counts / total).astype(np.float32) @ self.weights
        signed = margins[:, None, :] * self.code[None, :, :] * SHARPNESS
        loss = (np.logaddexp(0, -signed) * self.trust).sum(2)
        chance = np.exp(loss.min(1, keepdims=True) - loss)
        chance /= chance.sum(1, keepdims=True)
        best = chance.argmax(1)
        ordered = np.sort(chance, axis=1)
        second = ordered[:, -2] if chance.shape[1] > 1 else np.zeros(len(chance))
        return best, ordered[:, -1], second


def fit(counts: dict[str, np.ndarray]) -> Model | None:
    languages = sorted(counts)
    if not languages:
        return None
    smooth = np.stack([counts[name] + 0.5 for name in languages])
    p = smooth / smooth.sum(1, keepdims=True)
    code = codewords(len(languages))
    weights = []
    for bit in code.T.astype(bool):
        against = p[~bit].mean(0) if (~bit).any() else np.full(BUCKETS, 1 / BUCKETS)
        weights.append(np.log(p[bit].mean(0)) - np.log(against))
    weights = np.stack(weights, 1)
    sign = code.astype(np.int8) * 2 - 1
    margins = p @ weights * sign  # of each language's own counts
    scale = np.maximum(np.abs(margins).mean(0), 1e-9)
    apart = np.maximum(margins.min(0) / scale, 0.05)
    trust = apart / apart.mean() / len(apart) * min(len(apart), 8)
    return Model(languages, sign, (weights / scale).astype(np.float32), trust)


def train(df: DataFrame, text: str, label: str) -> Model | None:
    """Learn from every row with a language and a text."""
    rows = df.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(label).cast("string").alias("label"), F.col(text).alias("text")
    )
    sums = rows.mapInArrow(_counting, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    for r in sums.collect():
        counts.setdefault(r["label"], np.zeros(BUCKETS))[r["bucket"]] = r["n"]
    return fit(counts)


PREDICTED = ["lang_pred", "score", "ambiguous"]


def _predicted(texts: list[str | None], model: Model | None) -> list[pa.Array]:
    """Language, score and ambiguity of every text."""
    names, scores, unsure = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    held: dict[int, tuple[np.ndarray, int]] = {}  # a text in several parts
    for of, parts in _parts(texts) if model else []:
        counts, letters = gram_counts(parts)
        first = {}
        for row, i in enumerate(of):
            if i in first:
                counts[first[i]] += counts[row]
                letters[first[i]] += letters[row]
            else:
                first[i] = row
                if i in held:
                    counts[row] += held[i][0]
                    letters[row] += held[i][1]
        rows = list(first.values())
        best, chance, second = model.decide(counts[rows])
        for n, (i, row) in enumerate(first.items()):
            if letters[row]:
                names[i], scores[i] = model.languages[best[n]], chance[n]
                unsure[i] = second[n] > AMBIGUOUS * chance[n]
        last = of[-1]
        held = {last: (counts[first[last]].copy(), int(letters[first[last]]))}
    return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())]


def told(text: Column, model: Model | None) -> Column:
    """``struct<lang_pred, score, ambiguous>`` of a text. Only texts go to Python; the rest
    of a row stays where it is."""

    @F.arrow_udf("lang_pred string, score double, ambiguous boolean")
    def tell(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = []
            for at in range(0, len(batch), SLICE_TEXTS):
                part = _predicted(batch.slice(at, SLICE_TEXTS).to_pylist(), model)
                found.append(pa.StructArray.from_arrays(part, names=PREDICTED))
            yield pa.concat_arrays(found) if found else pa.StructArray.from_arrays(_predicted([], model), names=PREDICTED)

    # not to be run again where its result is asked for a second time
    return tell.asNondeterministic()(text)


def predict(df: DataFrame, text: str, model: Model | None, kept: dict[str, Column]) -> DataFrame:
    """The columns ``kept`` of every row with ``lang_pred, score, ambiguous``."""
    held = free_name("_told", list(kept))
    rows = df.select(*[c.alias(n) for n, c in kept.items()], told(F.col(text), model).alias(held))
    return rows.select(*[F.col(f"`{n}`") for n in kept], *[F.col(f"{held}.{c}") for c in PREDICTED])
