"""Question answering features: fixed-length windows over tokenised contexts.

A context is tokenised once for all its questions. Everything after the
tokeniser is expressions over arrays and two generators (questions, windows),
so the job has no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrays import let, pad_to
from textloom.functions.text import byte_to_char, strip_tags, strip_unicode, word_at, words
from textloom.operators.vocabulary import CLS, PAD, SEP, Vocabulary
from textloom.operators.wordpiece import tokenise_contexts

QAS_TYPE = (
    "array<struct<id:string,question:string,is_impossible:boolean,"
    "answers:array<struct<text:string,answer_start:int>>>>"
)


@dataclass(frozen=True)
class WindowConfig:
    max_seq_length: int = 512
    doc_stride: int = 384
    max_query_length: int = 64


# --- shaping question sets -------------------------------------------------


def first_question(qas: Column) -> Column:
    return F.slice(qas, 1, 1)


def question_chunks(paragraphs: DataFrame) -> DataFrame:
    """Contexts with more questions than the median are split into chunks of the
    median size. The median comes from counts per size, not from all rows."""
    sizes = paragraphs.groupBy(F.size("qas").alias("k")).agg(F.count("*").alias("m"))
    # one row; percentile interpolates, the result is floored
    median = sizes.agg(F.floor(F.percentile("k", 0.5, F.col("m"))).cast("int").alias("limit"))
    rows = paragraphs.withColumn("_one", F.lit(1)).join(F.broadcast(median.withColumn("_one", F.lit(1))), "_one")
    chunks = F.transform(
        F.sequence(F.lit(0), F.size("qas") - 1, F.col("limit")), lambda i: F.slice("qas", i + 1, F.col("limit"))
    )
    parts = F.when(F.size("qas") > F.col("limit"), chunks).otherwise(F.array("qas"))
    others = [c for c in paragraphs.columns if c != "qas"]
    return rows.select(*others, F.posexplode(parts).alias("chunk", "qas"))


def shift_answer(context: Column, answer_start: Column) -> Column:
    """Start of an answer once the tags before it are gone."""
    head = F.substring(context, F.lit(1), answer_start)
    return answer_start - (F.length(head) - F.length(strip_tags(head)))


def strip_html_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """Tags out of contexts and answers, answer starts moved accordingly."""
    context = F.col("context")
    answers = lambda q: F.transform(
        q["answers"],
        lambda a: F.struct(
            strip_tags(a["text"]).alias("text"), shift_answer(context, a["answer_start"]).cast("int").alias("answer_start")
        ),
    )
    qas = F.transform(
        "qas",
        lambda q: F.struct(
            q["id"].alias("id"),
            q["question"].alias("question"),
            q["is_impossible"].alias("is_impossible"),
            answers(q).alias("answers"),
        ),
    )
    return paragraphs.withColumn("qas", qas).withColumn("context", strip_tags(context))


def byte_annotation_answers(text: Column, annotations: Column) -> tuple[Column, Column]:
    """From byte-offset annotations: whether the question is kept (no yes/no
    answer) and its span answers in code points; no span means impossible."""
    kept = ~F.exists(annotations, lambda a: a["yes_no_answer"] != "NONE")
    spans = F.filter(annotations, lambda a: a["minimal_answer"]["plaintext_start_byte"] != -1)

    def answer(a: Column) -> Column:
        start = byte_to_char(text, a["minimal_answer"]["plaintext_start_byte"])
        end = byte_to_char(text, a["minimal_answer"]["plaintext_end_byte"])
        return F.struct(
            F.substring(text, start + 1, end - start).alias("text"), start.cast("int").alias("answer_start")
        )

    return kept, F.transform(spans, answer)


# --- features ---------------------------------------------------------------


def tokenise_paragraphs(paragraphs: DataFrame, vocab: Vocabulary, is_train: bool, keys: list[str]) -> DataFrame:
    """One row per question with the tokens of its context."""
    base = paragraphs.select(*keys, "context", F.col("qas").cast(QAS_TYPE).alias("qas"))
    texts = [F.transform("qas", lambda q: q["question"])]
    if is_train:
        texts.append(F.transform("qas", lambda q: F.coalesce(F.get(q["answers"], F.lit(0))["text"], F.lit(""))))
    base = base.withColumn("t", tokenise_contexts(vocab, F.col("context"), *texts))
    asked = F.arrays_zip("qas", F.col("t.t0").alias("query"), F.col("t.t1" if is_train else "t.t0").alias("wanted"))
    columns = [*keys, "context", "words", "tokens", "token_word"]
    # the words of a context are split once for all its questions, and only for readers that use them
    return base.select(
        *keys, "context", words(F.col("context")).alias("words"), "t.tokens", "t.token_word", F.explode(asked).alias("z")
    ).select(*columns, "z.qas.*", "z.query", "z.wanted")


def answer_words(rows: DataFrame) -> DataFrame:
    """Add ``start_word, end_word`` of the first answer, 0 when impossible."""
    answer = F.get("answers", F.lit(0))
    last = F.least(answer["answer_start"] + F.length(answer["text"]) - 1, F.length("context") - 1)
    impossible = F.coalesce(F.col("is_impossible"), F.lit(False))
    return (
        rows.withColumn("is_impossible", impossible)
        .withColumn("answer_text", F.when(F.col("is_impossible"), F.lit("")).otherwise(answer["text"]))
        .withColumn(
            "start_word",
            F.when(F.col("is_impossible"), F.lit(0)).otherwise(word_at(F.col("context"), answer["answer_start"])),
        )
        .withColumn("end_word", F.when(F.col("is_impossible"), F.lit(0)).otherwise(word_at(F.col("context"), last)))
    )


def answer_found(start_word: Column, end_word: Column, doc_words: Column, answer_text: Column) -> Column:
    """Whether the answer, whitespace normalised, occurs in its word span."""
    span = F.array_join(F.slice(doc_words, F.greatest(start_word, F.lit(0)) + 1, end_word - start_word + 1), " ")
    clean = F.regexp_replace(strip_unicode(answer_text), "[\\s\\x1C-\\x1F\\x85\\p{Z}]+", " ")
    return F.contains(F.when(start_word < 0, F.lit("")).otherwise(span), clean)


def token_span(rows: DataFrame) -> DataFrame:
    """Add ``tok_start, tok_end``: the tokens of the answer's words, tightened to
    the first run of tokens equal to the tokenised answer."""
    before = lambda word: F.size(F.filter("token_word", lambda w: w < word))
    start = before(F.col("start_word"))
    end = F.when(F.col("end_word") < F.size("words") - 1, before(F.col("end_word") + 1) - 1).otherwise(
        F.size("tokens") - 1
    )
    size = F.size("wanted")

    def tighten(s: Column) -> Column:
        last = s["e"] - size + 1
        starts = F.when(
            (size > 0) & (last >= s["s"]),
            F.filter(F.sequence(s["s"], last), lambda i: F.slice("tokens", i + 1, size) == F.col("wanted")),
        )
        first = F.get(starts, F.lit(0))
        return F.struct(
            F.coalesce(first, s["s"]).alias("s"), F.coalesce(first + size - 1, s["e"]).alias("e")
        )

    span = let(F.struct(start.alias("s"), end.alias("e")), tighten)
    return rows.withColumn("_span", span).select("*", F.col("_span.s").alias("tok_start"), F.col("_span.e").alias("tok_end")).drop("_span")


def window_count(n_tokens: Column, room: Column, stride: int) -> Column:
    """Windows until one reaches the end of the document; none for an empty one."""
    more = F.greatest(F.lit(0), F.ceil((n_tokens - room) / F.lit(stride)).cast("int"))
    return F.when(n_tokens > 0, 1 + more).otherwise(F.lit(0))


def max_context(window: Column, n_tokens: Column, room: Column, stride: int) -> Column:
    """For each token of a window, whether no other window gives it more context:
    the score is ``min(left, right) + 0.01 * length``, the earliest window wins.

    Every window but the last has full length, so between full windows the one
    with the nearest centre wins, which is a range of positions. Scores are only
    computed where the last, shorter window takes part.
    """
    false, true = F.lit(False), F.lit(True)

    def flags(w: Column, total: Column, cap: Column, last: Column) -> Column:
        last_start, last_size = last * stride, total - last * stride
        size = F.when(w == last, last_size).otherwise(cap)
        low = F.when(w == 0, F.lit(0)).otherwise(F.floor((cap - 1 - stride) / 2).cast("int") + 1)
        high = F.when(w + 1 < last, F.floor((cap - 1 + stride) / 2).cast("int")).otherwise(size - 1)
        spots = F.sequence(F.lit(0), size - 1)
        last_score = lambda p: F.least(p - last_start, total - 1 - p) + F.lit(0.01) * last_size

        def full_score(k: Column, p: Column) -> Column:
            return F.least(p - k * stride, k * stride + cap - 1 - p) + F.lit(0.01) * cap

        def beats_last(p: Column) -> Column:
            return full_score(w, p) >= last_score(p)

        def beats_full(j: Column) -> Column:
            p = last_start + j
            first = F.greatest(F.lit(0), F.ceil((p - cap + 1) / F.lit(stride)).cast("int"))
            rivals = F.when(first < last, F.sequence(first, last - 1)).otherwise(F.array().cast("array<int>"))
            return F.forall(rivals, lambda k: full_score(k, p) < last_score(p))

        def span(lo: Column, hi: Column) -> Column:
            return F.concat(
                F.array_repeat(false, lo), F.array_repeat(true, hi - lo + 1), F.array_repeat(false, size - 1 - hi)
            )

        def contested() -> Column:
            # only the positions from the start of the last window on are compared with it
            free = F.greatest(low, (last - w) * stride)
            shared = F.transform(F.sequence(w * stride + free, w * stride + high), beats_last)
            before = F.concat(F.array_repeat(false, low), F.array_repeat(true, free - low))
            return F.concat(before, shared, F.array_repeat(false, size - 1 - high))

        return (
            F.when(w == last, F.transform(spots, beats_full))
            .when((last - w) * stride <= high, contested())
            .otherwise(span(low, high))
        )

    return let(
        F.struct(
            window.alias("w"),
            n_tokens.alias("n"),
            room.alias("r"),
            (window_count(n_tokens, room, stride) - 1).alias("last"),
        ),
        lambda s: flags(s["w"], s["n"], s["r"], s["last"]),
    )


#: Windows are cut from blocks of so many neighbours, not from the whole document.
BLOCK_WINDOWS = 16


def document_windows(rows: DataFrame, config: WindowConfig, carry: list[str], with_flags: bool = True) -> DataFrame:
    """Overlapping windows: one row per window with its slice of the document.

    Window *i* starts at ``i * doc_stride`` and holds what fits next to the query. Both
    generators make numbers only and the slices follow them, so that they are not taken
    for readers without a use for them. A window is cut from the block of its neighbours,
    so no row holds more of a long document than that.
    """
    query = F.slice("query", 1, config.max_query_length)
    rows = rows.withColumn("query", query).withColumn("_room", config.max_seq_length - F.size("query") - 3)
    room, stride, span = F.col("_room"), config.doc_stride, BLOCK_WINDOWS * config.doc_stride
    rows = rows.withColumn("_n", F.size("tokens")).withColumn("_count", window_count(F.col("_n"), room, stride))
    numbers = ["query", "_n", "_room", "_count"]
    texts = ["tokens", "token_word", *["words"] * with_flags]
    per_block = F.when(F.col("_count") > 0, F.sequence(F.lit(0), F.floor((F.col("_count") - 1) / F.lit(BLOCK_WINDOWS)).cast("int")))
    blocks = rows.select(*carry, *numbers, *texts, F.explode(per_block).alias("_block"))
    begin, length = F.col("_block") * span, F.lit(span - stride) + room
    parts = [F.slice(c, begin + 1, length).alias(c) for c in ("tokens", "token_word")]
    if with_flags:
        # the words its tokens are of; the first one has the number of the first token
        first, last = F.col("token_word")[begin], F.col("token_word")[F.least(begin + length, F.col("_n")) - 1]
        parts += [F.slice("words", first + 1, last - first + 1).alias("words"), first.alias("_word")]
    blocks = blocks.select(*carry, *numbers, "_block", *parts)
    first = F.col("_block") * BLOCK_WINDOWS
    per_window = F.sequence(first, F.least(first + BLOCK_WINDOWS, F.col("_count")) - 1)
    windows = blocks.select("*", F.explode(per_window).alias("window"))
    start = F.col("window") * stride
    at, size = start - F.col("_block") * span, F.least(room, F.col("_n") - start)
    fields = [
        start.alias("start"),
        size.alias("paragraph_len"),
        F.slice("tokens", at + 1, room).alias("doc_ids"),
        F.slice("token_word", at + 1, room).alias("doc_words"),
    ]
    if with_flags:
        first, last = F.col("token_word")[at], F.col("token_word")[at + size - 1]
        fields.append(F.slice("words", first - F.col("_word") + 1, last - first + 1).alias("window_words"))
        fields.append(max_context(F.col("window"), F.col("_n"), room, stride).alias("token_is_max_context"))
    return windows.select(*carry, "query", "window", *fields)


def frame_windows(windows: DataFrame, vocab: Vocabulary, config: WindowConfig, carry: list[str]) -> DataFrame:
    """Fixed-length ``input_ids, attention_mask, token_type_ids``, and what
    evaluation needs to map tokens back."""
    length = config.max_seq_length
    cls, sep, pad = F.array(vocab.id(CLS)), F.array(vocab.id(SEP)), vocab.id(PAD)
    ids = F.concat(cls, F.col("query"), sep, F.col("doc_ids"), sep)
    used = F.size("query") + F.col("paragraph_len") + 3
    types = F.concat(
        F.array_repeat(F.lit(0), F.size("query") + 2), F.array_repeat(F.lit(1), F.col("paragraph_len") + 1)
    )
    return windows.select(
        *carry,
        "window",
        "start",
        pad_to(ids, length, pad).alias("input_ids"),
        pad_to(F.array_repeat(F.lit(1), used), length, F.lit(0)).alias("attention_mask"),
        pad_to(types, length, F.lit(0)).alias("token_type_ids"),
        (F.size("query") + 2).alias("doc_offset"),
        "paragraph_len",
        F.col("doc_words").alias("token_to_orig_map"),
        *[c for c in ("token_is_max_context", "window_words") if c in windows.columns],
    )


def real_tokens(ids: Column, vocab: Vocabulary) -> Column:
    """Token strings of a window up to the first padding id."""
    stop = F.array_position(ids, vocab.id(PAD))
    return vocab.decode(F.when(stop > 0, F.slice(ids, F.lit(1), (stop - 1).cast("int"))).otherwise(ids))


def window_labels(windows: DataFrame) -> DataFrame:
    """Add ``start_position, end_position``: the answer inside the window, or the
    classifier token when the answer is impossible or not wholly inside."""
    inside = (
        ~F.col("is_impossible")
        & (F.col("tok_start") >= F.col("start"))
        & (F.col("tok_end") <= F.col("start") + F.col("paragraph_len") - 1)
    )
    at = lambda c: F.when(inside, F.col(c) - F.col("start") + F.col("doc_offset")).otherwise(F.lit(0))
    return windows.withColumn("start_position", at("tok_start")).withColumn("end_position", at("tok_end"))


def train_features(paragraphs: DataFrame, vocab: Vocabulary, config: WindowConfig, keys: list[str]) -> DataFrame:
    """Training features. Answerable questions whose answer is not in the text are dropped."""
    rows = answer_words(tokenise_paragraphs(paragraphs, vocab, True, keys))
    found = answer_found(F.col("start_word"), F.col("end_word"), F.col("words"), F.col("answer_text"))
    rows = token_span(rows.withColumn("_keep", F.col("is_impossible") | found).where("_keep"))
    carry = [*keys, "id", "is_impossible", "tok_start", "tok_end"]
    windows = frame_windows(document_windows(rows, config, carry, with_flags=False), vocab, config, carry)
    return window_labels(windows).select(
        *keys, "id", "window", "input_ids", "attention_mask", "token_type_ids", "start_position", "end_position"
    )


def eval_features(paragraphs: DataFrame, vocab: Vocabulary, config: WindowConfig, keys: list[str]) -> DataFrame:
    """Evaluation features: every question, with the maps back to words."""
    rows = tokenise_paragraphs(paragraphs, vocab, False, keys)
    carry = [*keys, "id"]
    framed = frame_windows(document_windows(rows, config, carry), vocab, config, carry)
    return framed.select(
        *keys,
        "id",
        F.concat_ws("_", "id", "window").alias("unique_id"),
        "window",
        "input_ids",
        "attention_mask",
        "token_type_ids",
        F.lit(0).alias("start_position"),
        F.lit(0).alias("end_position"),
        "doc_offset",
        "paragraph_len",
        "token_to_orig_map",
        "token_is_max_context",
        "window_words",
    )


def eval_examples(paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    """What scoring needs about a question, once per question: answers and words, and
    where it stands in its files (``arrival``) if the reader has told."""
    placed = ["place"] if "place" in paragraphs.columns else []
    base = paragraphs.select(
        *keys, *placed, words(F.col("context")).alias("doc_tokens"), F.posexplode(F.col("qas").cast(QAS_TYPE)).alias("n", "q")
    )
    arrival = [F.struct("place", "n").alias("arrival")] if placed else []
    return base.select(
        *keys,
        F.col("q.id").alias("id"),
        F.coalesce("q.is_impossible", F.lit(False)).alias("is_impossible"),
        "q.answers",
        "doc_tokens",
        *arrival,
    )
