"""Question answering feature queries. The question set is derived from the
documents: every document asks one to three questions about spans of itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.base import documents, given, load, query, vocabulary
from queries.sql import PARTS, SEED, seed
from textloom.functions import draws
from textloom.functions import text as txt
from textloom.operators import qa_features as qa
from textloom.sources import qa as sources
from textloom.sources.qa import of_language

CONFIG = qa.WindowConfig(max_seq_length=128, doc_stride=48, max_query_length=16)


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")

    def question(j):
        start = draws.seed(SEED, "qa-start", F.col("doc_id"), j) % F.length("text")
        size = 1 + draws.seed(SEED, "qa-size", F.col("doc_id"), j) % 40
        answer = F.substring("text", (start + 1).cast("int"), size.cast("int"))
        kind = F.col("doc_id") + j
        answer = F.when(kind % 11 == 5, F.concat(F.lit("zz"), answer)).otherwise(answer)
        answers = F.array(F.struct(answer.alias("text"), start.cast("int").alias("answer_start")))
        return F.struct(
            F.concat_ws("-", "doc_id", j).alias("id"),
            F.substring_index("text", "\n", 1).alias("question"),
            (kind % 7 == 3).alias("is_impossible"),
            F.when(kind % 7 == 3, F.slice(answers, 1, 0)).otherwise(answers).alias("answers"),
        )

    last = (F.col("doc_id") % 3).cast("int")
    return docs.select(
        "doc_id", F.col("text").alias("context"), F.transform(F.sequence(F.lit(0), last), question).alias("qas")
    )


QA_SQL = f"""questions AS (
  SELECT doc_id, j, doc_id || '-' || j AS id, text AS context, split_part(text, chr(10), 1) AS question,
         (doc_id + j) % 7 = 3 AS is_impossible,
         {seed(str(SEED), "'qa-start'", "doc_id", "j")} % len(text) AS raw_start,
         CASE WHEN (doc_id + j) % 11 = 5 THEN 'zz' ELSE '' END
           || substr(text, ({seed(str(SEED), "'qa-start'", "doc_id", "j")} % len(text) + 1)::BIGINT,
                     (1 + {seed(str(SEED), "'qa-size'", "doc_id", "j")} % 40)::BIGINT) AS raw_answer
  FROM (SELECT doc_id, text, unnest(range(doc_id % 3 + 1)) AS j FROM documents)),
asked AS (
  SELECT *, CASE WHEN is_impossible THEN NULL ELSE raw_start END AS answer_start,
         CASE WHEN is_impossible THEN NULL ELSE raw_answer END AS answer FROM questions)"""


@query(
    "qa_flatten",
    f"WITH {QA_SQL} SELECT doc_id, id, question, is_impossible, answer_start, answer FROM asked",
)
def qa_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per question of the nested paragraphs."""
    rows = paragraphs(spark, sf_dir).select("doc_id", F.explode("qas").alias("q")).select("doc_id", "q.*")
    first = F.get("answers", F.lit(0))
    return rows.select(
        "doc_id",
        "id",
        "question",
        "is_impossible",
        first["answer_start"].cast("bigint").alias("answer_start"),
        first["text"].alias("answer"),
    )


@query("first_question", f"WITH {QA_SQL} SELECT doc_id, id FROM asked WHERE j = 0")
def first_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the first question of each context."""
    rows = paragraphs(spark, sf_dir).select("doc_id", F.explode(qa.first_question(F.col("qas"))).alias("q"))
    return rows.select("doc_id", "q.id")


TURNS_SQL = """turns AS (
  SELECT conv_id, list(conv_id || '-' || turn ORDER BY turn) AS ids FROM conversations WHERE role = 'user' GROUP BY conv_id)"""


@query(
    "question_chunks",
    f"""WITH {TURNS_SQL}, lim AS (SELECT floor(quantile_cont(len(ids)::DOUBLE, 0.5))::BIGINT AS k FROM turns),
        cut AS (
          SELECT conv_id, ids, k, unnest(range(CASE WHEN len(ids) > k THEN (len(ids) + k - 1) // k ELSE 1 END)) AS chunk
          FROM turns, lim)
        SELECT conv_id, chunk, array_to_string(CASE WHEN len(ids) > k THEN ids[chunk * k + 1 : chunk * k + k] ELSE ids END, ',')
          AS ids FROM cut""",
)
def question_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as the questions of a conversation, chunked at the median count."""
    turns = load(spark, sf_dir, "conversations", "conv_id", "turn", "role").where("role = 'user'")
    asked = turns.groupBy("conv_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("turn", F.concat_ws("-", "conv_id", "turn").alias("id")))),
            lambda t: t["id"],
        ).alias("qas")
    )
    chunks = qa.question_chunks(asked)
    return chunks.select("conv_id", F.col("chunk").cast("bigint").alias("chunk"), F.array_join("qas", ",").alias("ids"))


def _strip_sql(x: str) -> str:
    out = f"regexp_replace({x}, '<title>[^\\n]*?</title>', ' ', 'g')"
    out = f"replace(replace({out}, 'rowspan=\"', 'r'), 'colspan=\"', 'c')"
    for tag in txt.HTML_LITERALS:
        out = f"replace({out}, '{tag}', '')"
    return f"regexp_replace(regexp_replace({out}, ' +', ' ', 'g'), '\\n+', chr(10), 'g')"


@query("strip_tags", f"SELECT page_id, {_strip_sql('html')} AS text FROM pages")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare markup out of whole pages."""
    pages = given(load(spark, sf_dir, "pages", "page_id", "html"), "page_id")
    return pages.select("page_id", txt.strip_tags(F.col("html")).alias("text"))


@query(
    "answer_offset_shift",
    f"""WITH s AS (SELECT page_id, html, {seed(str(SEED), "'page'", "page_id")} % len(html) AS c0 FROM pages),
        h AS (SELECT *, substr(html, 1, c0::BIGINT) AS head FROM s)
        SELECT page_id, c0 AS answer_start, c0 - (len(head) - len({_strip_sql('head')})) AS new_start FROM h""",
)
def answer_offset_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer starts moved by the markup removed before them."""
    pages = given(load(spark, sf_dir, "pages", "page_id", "html"), "page_id")
    start = draws.seed(SEED, "page", F.col("page_id")) % F.length("html")
    rows = pages.select("page_id", "html", start.cast("int").alias("at"))
    shifted = qa.shift_answer(F.col("html"), F.col("at"))
    return rows.select("page_id", F.col("at").cast("bigint").alias("answer_start"), shifted.cast("bigint").alias("new_start"))


BYTES_SQL = f"""spans AS (
  SELECT doc_id, lang, text, i,
         {seed(str(SEED), "'byte'", "doc_id", "i")} % len(text) AS c0,
         1 + {seed(str(SEED), "'bytes'", "doc_id", "i")} % 30 AS n,
         CASE WHEN {seed(str(SEED), "'yes'", "doc_id", "i")} % 10 = 0 THEN 'YES' ELSE 'NONE' END AS yes_no,
         {seed(str(SEED), "'none'", "doc_id", "i")} % 3 = 0 AS none
  FROM documents, (SELECT unnest([0, 1]) AS i))"""


@query(
    "byte_to_char",
    f"""WITH {BYTES_SQL} SELECT doc_id, i::BIGINT AS i, strlen(substr(text, 1, c0::BIGINT)) AS start_byte, c0 AS start_char
        FROM spans""",
)
def byte_to_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-8 byte offsets back to code points, on accented text."""
    rows = annotated(spark, sf_dir).select("doc_id", "text", F.posexplode("annotations").alias("i", "a"))
    byte = F.col("a.start_byte")
    return rows.select(
        "doc_id",
        F.col("i").cast("bigint").alias("i"),
        byte.cast("bigint").alias("start_byte"),
        txt.byte_to_char(F.col("text"), byte).cast("bigint").alias("start_char"),
    )


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with two byte-offset annotations each."""
    docs = documents(spark, sf_dir, "doc_id", "lang", "text")

    def annotation(i):
        key = F.col("doc_id")
        start = (draws.seed(SEED, "byte", key, i) % F.length("text")).cast("int")
        size = (1 + draws.seed(SEED, "bytes", key, i) % 30).cast("int")
        first = F.octet_length(F.substring("text", F.lit(1), start))
        last = first + F.octet_length(F.substring("text", start + 1, size))
        none = draws.seed(SEED, "none", key, i) % 3 == 0
        return F.struct(
            first.alias("start_byte"),
            F.struct(
                F.when(none, F.lit(-1)).otherwise(first).alias("plaintext_start_byte"),
                F.when(none, F.lit(-1)).otherwise(last).alias("plaintext_end_byte"),
            ).alias("minimal_answer"),
            F.when(draws.seed(SEED, "yes", key, i) % 10 == 0, F.lit("YES")).otherwise(F.lit("NONE")).alias("yes_no_answer"),
        )

    return docs.select("doc_id", "lang", "text", F.transform(F.sequence(F.lit(0), F.lit(1)), annotation).alias("annotations"))


@query(
    "answerability",
    f"""WITH {BYTES_SQL}
        SELECT doc_id, count(*) FILTER (WHERE NOT none) = 0 AS is_impossible,
               coalesce(string_agg(c0 || ':' || substr(text, (c0 + 1)::BIGINT, n::BIGINT), '|' ORDER BY i) FILTER (WHERE NOT none), '')
                 AS answers
        FROM spans WHERE lower(trim(lang)) = 'fr'
        GROUP BY doc_id HAVING count(*) FILTER (WHERE yes_no <> 'NONE') = 0""",
)
def answerability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One language; yes/no questions are skipped; no span answer left means impossible."""
    rows = annotated(spark, sf_dir).where(of_language(F.col("lang"), "fr"))
    kept, answers = qa.byte_annotation_answers(F.col("text"), F.col("annotations"))
    rows = rows.where(kept).select("doc_id", answers.alias("answers"))
    text = F.transform("answers", lambda a: F.concat_ws(":", a["answer_start"], a["text"]))
    return rows.select("doc_id", (F.size("answers") == 0).alias("is_impossible"), F.array_join(text, "|").alias("answers"))


WORDS_SQL = """ws AS (
  SELECT *, regexp_extract_all(context, '[^ \\t\\r\\n]+') AS ws,
         len(regexp_extract_all(substr(context, 1, (answer_start + 1)::BIGINT), '[^ \\t\\r\\n]+')) - 1 AS sw,
         len(regexp_extract_all(substr(context, 1, (least(answer_start + len(answer) - 1, len(context) - 1) + 1)::BIGINT),
                                '[^ \\t\\r\\n]+')) - 1 AS ew
  FROM asked),
spanned AS (
  SELECT *, CASE WHEN is_impossible THEN 0 ELSE sw END AS start_word, CASE WHEN is_impossible THEN 0 ELSE ew END AS end_word,
         is_impossible OR contains(array_to_string(ws[sw + 1 : ew + 1], ' '),
                                   trim(regexp_replace(answer, '\\s+', ' ', 'g'))) AS found
  FROM ws)"""


@query(
    "word_offsets",
    f"""WITH {QA_SQL}, {WORDS_SQL} SELECT id, len(ws)::BIGINT AS n_words, start_word::BIGINT AS start_word,
        end_word::BIGINT AS end_word FROM spanned""",
)
def word_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word positions of answers."""
    rows = _questions_with_words(spark, sf_dir)
    big = lambda c: F.col(c).cast("bigint").alias(c)
    return rows.select("id", F.size("words").cast("bigint").alias("n_words"), big("start_word"), big("end_word"))


def _questions_with_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paragraphs(spark, sf_dir).select(
        "doc_id", "context", txt.words(F.col("context")).alias("words"), F.explode("qas").alias("q")
    )
    return qa.answer_words(rows.select("doc_id", "context", "words", "q.*"))


@query("unfindable_filter", f"WITH {QA_SQL}, {WORDS_SQL} SELECT id, found FROM spanned WHERE NOT is_impossible")
def unfindable_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an answer occurs in the words it points at."""
    rows = _questions_with_words(spark, sf_dir).where("not is_impossible")
    found = qa.answer_found(F.col("start_word"), F.col("end_word"), F.col("words"), F.col("answer_text"))
    return rows.select("id", found.alias("found"))


WORD_RE = "[!-/:-@\\[-`{-~\\pP]|[^\\s!-/:-@\\[-`{-~\\pP]+"
# tokens of contexts, questions and answers
def tokens_sql(length: int, stride: int, max_query: int) -> str:
    return (
    "WITH RECURSIVE"
    + PARTS["lines"]
    + ","
    + PARTS["words"]
    + ","
    + PARTS["vocab"]
    + ", "
    + QA_SQL
    + f""", extra_words AS (
  SELECT unnest(regexp_extract_all(question || ' ' || coalesce(answer, ''), '{WORD_RE}')) AS word FROM asked),"""
    + PARTS["pieces"].replace(
        "SELECT DISTINCT word FROM words", "SELECT word FROM words UNION SELECT word FROM extra_words"
    )
    + ", "
    + WORDS_SQL
    + f""", doc_ws AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS wi FROM spanned WHERE j = 0),
doc_basic AS (
  SELECT doc_id, wi, unnest(bs) AS word, unnest(range(len(bs))) AS bi
  FROM (SELECT *, regexp_extract_all(w, '{WORD_RE}') AS bs FROM doc_ws)),
doc_tokens AS (
  SELECT doc_id, flatten(list(toks ORDER BY wi, bi)) AS toks,
         flatten(list(list_transform(toks, lambda t: wi) ORDER BY wi, bi)) AS tw
  FROM doc_basic JOIN pieces USING (word) GROUP BY doc_id),
side AS (
  SELECT id, 'q' AS side, regexp_extract_all(question, '{WORD_RE}') AS bs FROM asked
  UNION ALL SELECT id, 'a', regexp_extract_all(coalesce(answer, ''), '{WORD_RE}') FROM asked),
side_words AS (SELECT id, side, unnest(bs) AS word, unnest(range(len(bs))) AS bi FROM side),
side_tokens AS (
  SELECT id, side, flatten(list(toks ORDER BY bi)) AS toks FROM side_words JOIN pieces USING (word) GROUP BY id, side),
full_q AS (
  SELECT s.*, d.toks, d.tw, coalesce(q.toks, [])[1:{max_query}] AS query, coalesce(a.toks, []) AS wanted
  FROM spanned s JOIN doc_tokens d USING (doc_id)
  LEFT JOIN side_tokens q ON q.id = s.id AND q.side = 'q' LEFT JOIN side_tokens a ON a.id = s.id AND a.side = 'a'),
rough AS (
  SELECT *, len(list_filter(tw, lambda w: w < start_word)) AS s0,
         CASE WHEN end_word < len(ws) - 1 THEN len(list_filter(tw, lambda w: w < end_word + 1)) - 1
              ELSE len(toks) - 1 END AS e0
  FROM full_q),
tight AS (
  SELECT *, CASE WHEN len(wanted) = 0 THEN NULL
                 ELSE list_filter(range(s0, e0 - len(wanted) + 2), lambda s: toks[s + 1 : s + len(wanted)] = wanted)[1] END AS hit
  FROM rough),
token_spans AS (
  SELECT *, coalesce(hit, s0) AS tok_start, coalesce(hit + len(wanted) - 1, e0) AS tok_end,
         {length} - len(query) - 3 AS room FROM tight),
windows AS (
  SELECT *, win * {stride} AS start, least(len(toks) - win * {stride}, room) AS plen
  FROM (SELECT *, unnest(range((1 + greatest(0, ceil((len(toks) - room) / {stride}.0::DOUBLE)))::BIGINT)) AS win FROM token_spans))
"""
)


TOKENS_SQL = tokens_sql(128, 48, 16)


@query(
    "subtoken_spans",
    TOKENS_SQL + """SELECT id, len(toks)::BIGINT AS n_tokens, tok_start::BIGINT AS tok_start, tok_end::BIGINT AS tok_end
                    FROM token_spans WHERE found AND NOT is_impossible""",
)
def subtoken_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as token spans, tightened to the tokenised answer."""
    rows = qa.answer_words(qa.tokenise_paragraphs(paragraphs(spark, sf_dir), vocabulary(spark, sf_dir), True, ["doc_id"]))
    found = qa.answer_found(F.col("start_word"), F.col("end_word"), F.col("words"), F.col("answer_text"))
    rows = qa.token_span(rows.withColumn("found", found).where("found and not is_impossible"))
    big = lambda c: F.col(c).cast("bigint").alias(c)
    return rows.select("id", F.size("tokens").cast("bigint").alias("n_tokens"), big("tok_start"), big("tok_end"))


@query(
    "doc_windows",
    TOKENS_SQL
    + """SELECT id || '_' || win AS unique_id, plen::BIGINT AS paragraph_len, (len(query) + 2)::BIGINT AS doc_offset,
              md5(array_to_string(['[CLS]'] || query || ['[SEP]'] || toks[start + 1 : start + plen] || ['[SEP]'], ' ')) AS tokens_md5,
              md5(array_to_string(tw[start + 1 : start + plen], ',')) AS words_md5
         FROM windows""",
)
def doc_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation windows over whole documents, for every question."""
    vocab = vocabulary(spark, sf_dir)
    rows = qa.eval_features(paragraphs(spark, sf_dir), vocab, CONFIG, ["doc_id"])
    return rows.select(
        "unique_id",
        F.col("paragraph_len").cast("bigint").alias("paragraph_len"),
        F.col("doc_offset").cast("bigint").alias("doc_offset"),
        F.md5(F.array_join(qa.real_tokens(F.col("input_ids"), vocab), " ")).alias("tokens_md5"),
        F.md5(F.array_join(F.transform("token_to_orig_map", lambda x: x.cast("string")), ",")).alias("words_md5"),
    )


@query(
    "max_context",
    TOKENS_SQL
    + """, cells AS (
           SELECT id, win, unnest(range(plen)) + start AS p, start, plen FROM windows),
         scored AS (
           SELECT *, least(p - start, start + plen - 1 - p) + 0.01::DOUBLE * plen AS score FROM cells),
         flagged AS (
           SELECT *, row_number() OVER (PARTITION BY id, p ORDER BY score DESC, win) = 1 AS flag FROM scored)
         SELECT id || '_' || win AS unique_id, string_agg(CASE WHEN flag THEN '1' ELSE '0' END, '' ORDER BY p) AS flags
         FROM flagged GROUP BY id, win""",
)
def max_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window that gives each token most context."""
    out = qa.eval_features(paragraphs(spark, sf_dir), vocabulary(spark, sf_dir), CONFIG, ["doc_id"])
    flags = F.transform("token_is_max_context", lambda b: F.when(b, F.lit("1")).otherwise(F.lit("0")))
    return out.select("unique_id", F.array_join(flags, "").alias("flags"))


@query(
    "window_labels",
    TOKENS_SQL
    + """SELECT id || '_' || win AS unique_id,
              (CASE WHEN NOT is_impossible AND tok_start >= start AND tok_end <= start + plen - 1
                    THEN tok_start - start + len(query) + 2 ELSE 0 END)::BIGINT AS start_position,
              (CASE WHEN NOT is_impossible AND tok_start >= start AND tok_end <= start + plen - 1
                    THEN tok_end - start + len(query) + 2 ELSE 0 END)::BIGINT AS end_position,
              (len(query) + plen + 3)::BIGINT AS n_real, (plen + 1)::BIGINT AS n_second
         FROM windows WHERE found""",
)
def window_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training windows with the answer's position or the classifier token."""
    rows = qa.train_features(paragraphs(spark, sf_dir), vocabulary(spark, sf_dir), CONFIG, ["doc_id"])
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x).cast("bigint")
    return rows.select(
        F.concat_ws("_", "id", "window").alias("unique_id"),
        F.col("start_position").cast("bigint").alias("start_position"),
        F.col("end_position").cast("bigint").alias("end_position"),
        total("attention_mask").alias("n_real"),
        total("token_type_ids").alias("n_second"),
    )


# --- readers: nested records as files hold them, and their shape --------------


def nested(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """One record per document, its questions nested as in the files."""
    rows = paragraphs(spark, sf_dir).withColumn("file", F.concat_ws("-", F.lit("doc"), "doc_id"))
    fields = {
        "id": lambda q: q["id"],
        "guid": lambda q: q["id"],
        "question": lambda q: q["question"],
        "is_impossible": lambda q: F.when(q["is_impossible"], F.lit(True)),
        "answers": lambda q: q["answers"],
    }
    qas = F.transform("qas", lambda q: F.struct(*[fields[n](q).alias(n) for n in names]))
    paragraph = F.struct(F.col("context"), qas.alias("qas"))
    return rows.select("file", F.array(F.struct(F.array(paragraph).alias("paragraphs"))).alias("data"))


def asked_rows(shaped: DataFrame) -> DataFrame:
    rows = shaped.select(F.col("place.file").alias("file"), "context", F.posexplode("qas").alias("n", "q"))
    answer = F.get("q.answers", F.lit(0))
    return rows.select(
        "file",
        F.col("n").cast("bigint").alias("n"),
        F.col("q.id").alias("id"),
        F.col("q.question").alias("question"),
        F.col("q.is_impossible").alias("is_impossible"),
        answer["text"].alias("answer"),
        answer["answer_start"].cast("bigint").alias("answer_start"),
        F.md5("context").alias("context_md5"),
    )


READER_SQL = f"""WITH {QA_SQL} SELECT 'doc-' || doc_id AS file, j::BIGINT AS n, id, question, is_impossible, answer,
  answer_start::BIGINT AS answer_start, md5(context) AS context_md5 FROM asked"""


@query("shape_squad", READER_SQL)
def shape_squad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested paragraphs of two levels, a missing flag meaning answerable."""
    return asked_rows(sources.shape_squad(nested(spark, sf_dir, "id", "question", "is_impossible", "answers")))


@query("shape_mrc", READER_SQL)
def shape_mrc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with ``guid`` as the id."""
    raw = nested(spark, sf_dir, "guid", "question", "is_impossible", "answers")
    return asked_rows(sources.shape_squad(raw, lambda q: q["guid"]))


@query(
    "shape_bytes",
    f"""WITH {BYTES_SQL}
        SELECT doc_id, count(*) FILTER (WHERE NOT none) = 0 AS is_impossible,
               coalesce(string_agg(c0 || ':' || substr(text, (c0 + 1)::BIGINT, n::BIGINT), '|' ORDER BY i) FILTER (WHERE NOT none), '')
                 AS answers
        FROM spans WHERE lower(trim(lang)) = 'de'
        GROUP BY doc_id HAVING count(*) FILTER (WHERE yes_no <> 'NONE') = 0""",
)
def shape_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-offset records of one language as questions, each with an id of its own."""
    raw = annotated(spark, sf_dir).select(
        F.lit("f").alias("file"),
        F.col("doc_id").alias("record"),
        F.initcap("lang").alias("language"),
        F.col("text").alias("document_plaintext"),
        F.col("doc_id").cast("string").alias("question_text"),
        "annotations",
    )
    rows = sources.shape_bytes(raw, "de").select(F.col("place.outer").alias("doc_id"), F.explode("qas").alias("q"))
    text = F.transform("q.answers", lambda a: F.concat_ws(":", a["answer_start"], a["text"]))
    return rows.select("doc_id", F.col("q.is_impossible").alias("is_impossible"), F.array_join(text, "|").alias("answers"))
