"""Answer prediction and scoring queries. Windows come from the documents; the
given vectors stand in for window logits, picked by a keyed draw."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.base import given, load, query, vocabulary
from queries.classification import rounded
from queries.qa import WORD_RE, paragraphs, tokens_sql
from queries.sql import SEED, seed
from textloom.functions import draws
from textloom.functions.arrays import top_indexes
from textloom.functions.text import char_f1, normalise_answer
from textloom.operators import qa_features as qa
from textloom.operators import qa_predict as pr
from textloom.operators import qa_scores as sc
from textloom.session import write_through

WINDOWS = qa.WindowConfig(max_seq_length=64, doc_stride=24, max_query_length=8)
PREDICT = pr.PredictConfig(n_best_size=5, max_answer_length=12, version_2_with_negative=True)


@query(
    "top_logits",
    """SELECT vec_id, array_to_string(list_transform(list_sort(list_transform(range(64), lambda i: {'v': -embedding[i + 1], 'i': i}))[1:5],
              lambda s: s.i), ',') AS best FROM embeddings""",
)
def top_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest positions of every vector."""
    best = top_indexes(F.col("embedding"), 5)
    return load(spark, sf_dir, "embeddings", "vec_id", "embedding").select(
        "vec_id", F.array_join(F.transform(best, lambda i: i.cast("string")), ",").alias("best")
    )


def question_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(spark, sf_dir)


SPAN_COLUMNS = ["id", "unique_id", "window", "doc_offset", "paragraph_len", "token_to_orig_map", "token_is_max_context"]
ANSWER_COLUMNS = [*SPAN_COLUMNS, "window_words", "input_ids"]


def features(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """Feature table, written once, as prediction reads it several times; of its columns
    those that are read."""
    rows = qa.eval_features(question_set(spark, sf_dir), vocabulary(spark, sf_dir), WINDOWS, ["doc_id"])
    return write_through(rows.select(*columns))


def results(spark: SparkSession, sf_dir: str, windows: DataFrame) -> DataFrame:
    """Logits of every window; one window in two hundred has none."""
    vectors = load(spark, sf_dir, "embeddings", "vec_id", "embedding")
    n = vectors.count()
    key = draws.seed(SEED, "vec", F.col("unique_id"))
    drawn = windows.select("unique_id").where(draws.seed(SEED, "lost", F.col("unique_id")) % 200 != 0)
    # the vectors are an input of fixed width; the join is by key, its strategy is left to the optimizer
    return drawn.withColumn("vec_id", key % n).join(vectors, "vec_id").select(
        "unique_id", F.col("embedding").alias("start_logits"), F.reverse("embedding").alias("end_logits")
    )


LOGITS_SQL = (
    tokens_sql(64, 24, 8)
    + f""", wins AS (SELECT *, id || '_' || win AS unique_id, len(query) + 2 AS off FROM windows),
results AS (
  SELECT w.unique_id, w.id, w.win, w.off, w.plen, w.tw, w.ws, w.start, w.doc_id,
         w.toks[w.start + 1 : w.start + w.plen] AS wt,
         list_transform(e.embedding, lambda x: x::DOUBLE) AS sl, list_reverse(list_transform(e.embedding, lambda x: x::DOUBLE)) AS el
  FROM wins w JOIN embeddings e
    ON e.vec_id = {seed(str(SEED), "'vec'", "w.unique_id")} % (SELECT count(*) FROM embeddings)
  WHERE {seed(str(SEED), "'lost'", "w.unique_id")} % 200 <> 0),
complete AS (
  SELECT w.id FROM (SELECT id, count(*) AS n FROM wins GROUP BY id) w
  JOIN (SELECT id, count(*) AS n FROM results GROUP BY id) r ON r.id = w.id AND r.n = w.n),
cells AS (
  SELECT id, win, unnest(range(plen)) AS i, start, plen FROM wins),
cell_best AS (
  SELECT id, win, i, row_number() OVER (PARTITION BY id, start + i
           ORDER BY least(i, plen - 1 - i) + 0.01::DOUBLE * plen DESC, win) = 1 AS flag FROM cells),
ranked_starts AS (
  SELECT r.*, unnest(list_sort(list_transform(range(64), lambda i: {{'v': -sl[i + 1], 'i': i}}))[1:5]).i AS s,
         unnest(range(5)) AS sk FROM results r),
ranked_pairs AS (
  SELECT *, unnest(list_sort(list_transform(range(64), lambda i: {{'v': -el[i + 1], 'i': i}}))[1:5]).i AS e,
         unnest(range(5)) AS ek FROM ranked_starts),
spans_ok AS (
  SELECT p.*, sl[s + 1] AS a, el[e + 1] AS b FROM ranked_pairs p
  JOIN cell_best c ON c.id = p.id AND c.win = p.win AND c.i = p.s - p.off AND c.flag
  WHERE s >= off AND s < off + plen AND e >= off AND e < off + plen AND e >= s AND e - s + 1 <= 12)"""
)


@query("complete_questions", LOGITS_SQL + " SELECT id FROM complete")
def complete_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions all of whose windows have results."""
    windows = features(spark, sf_dir, ["id", "unique_id"])
    return pr.complete_questions(windows, results(spark, sf_dir, windows)).select("id")


@query(
    "candidate_spans",
    LOGITS_SQL
    + """SELECT r.unique_id, count(o.s) AS n_spans, coalesce(string_agg(o.s || '-' || o.e, ',' ORDER BY o.sk, o.ek), '') AS spans
         FROM results r LEFT JOIN spans_ok o ON o.unique_id = r.unique_id GROUP BY r.unique_id""",
)
def candidate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid (start, end) pairs among the best starts and ends of a window."""
    windows = features(spark, sf_dir, SPAN_COLUMNS)
    rows = pr.candidate_spans(windows, results(spark, sf_dir, windows), PREDICT)
    text = F.transform("spans", lambda s: F.concat_ws("-", s["first"], s["last"]))
    return rows.select("unique_id", F.size("spans").cast("bigint").alias("n_spans"), F.array_join(text, ",").alias("spans"))


NBEST_SQL = (
    LOGITS_SQL
    + """, nulls AS (
  SELECT id, min_by(sl[1], (sl[1] + el[1], win)) AS na, min_by(el[1], (sl[1] + el[1], win)) AS nb FROM results
  WHERE id IN (SELECT id FROM complete) GROUP BY id),
every AS (
  SELECT id, array_to_string(ws[tw[start + s - off + 1] + 1 : tw[start + e - off + 1] + 1], ' ') AS txt, a, b, win, sk, ek,
         array_to_string(wt[s - off + 1 : e - off + 1], ' ') AS ptxt
  FROM spans_ok WHERE id IN (SELECT id FROM complete)
  UNION ALL SELECT id, '', na, nb, 1 << 30, 0, 0, '' FROM nulls),
firsts AS (
  SELECT * FROM every
  QUALIFY row_number() OVER (PARTITION BY id, txt ORDER BY a + b DESC, win, sk, ek) = 1),
top_n AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY a + b DESC, win, sk, ek) AS r FROM firsts
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY a + b DESC, win, sk, ek) <= 5),
with_null AS (
  SELECT id, txt, a, b, r, ptxt FROM top_n
  UNION ALL SELECT id, '', na, nb, 100, '' FROM nulls WHERE id NOT IN (SELECT id FROM top_n WHERE txt = '')),
entries AS (
  SELECT * FROM with_null
  UNION ALL SELECT id, 'empty', 0.0::DOUBLE, 0.0::DOUBLE, 0, '' FROM with_null GROUP BY id HAVING count(*) = 1)"""
)


@query(
    "nbest",
    NBEST_SQL
    + """, probs AS (
      SELECT *, exp(a + b - max(a + b) OVER (PARTITION BY id)) AS x, row_number() OVER (PARTITION BY id ORDER BY r) AS rank
      FROM entries)
    SELECT id, rank, txt AS text, round(x / sum(x) OVER (PARTITION BY id), 6) AS probability FROM probs""",
)
def nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked distinct answers of every complete question with their probabilities."""
    rows = _ranked(spark, sf_dir).select("id", F.posexplode(F.arrays_zip("nbest", "probabilities")).alias("rank", "e"))
    return rows.select(
        "id",
        (F.col("rank") + 1).cast("bigint").alias("rank"),
        F.col("e.nbest.text").alias("text"),
        F.round("e.probabilities", 6).alias("probability"),
    )


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = features(spark, sf_dir, ANSWER_COLUMNS)
    return pr.ranked(windows, results(spark, sf_dir, windows), PREDICT)


DECISION_SQL = (
    NBEST_SQL
    + """, best_entry AS (
  SELECT id, min_by(txt, r) AS txt, min_by(a, r) AS a, min_by(b, r) AS b, min_by(ptxt, r) AS ptxt
  FROM entries WHERE txt <> '' GROUP BY id),
decided AS (
  SELECT b.id, round(n.na + n.nb - b.a - b.b, 6) AS null_score_diff, b.ptxt,
         CASE WHEN n.na + n.nb - b.a - b.b > 0 OR b.txt = 'empty' THEN '' ELSE b.txt END AS text
  FROM best_entry b JOIN nulls n USING (id))"""
)


@query("null_decision", DECISION_SQL + " SELECT id, null_score_diff, text FROM decided")
def null_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer or no answer, by the null score."""
    rows = pr.decide(_ranked(spark, sf_dir), PREDICT)
    return rows.select("id", F.round("null_score_diff", 6).alias("null_score_diff"), "text")


@query(
    "qa_predictions",
    DECISION_SQL
    + f""", loose AS (
      SELECT *, array_to_string(regexp_extract_all(text, '{WORD_RE}'), ' ') AS l,
             trim(regexp_replace(replace(ptxt, ' ##', ''), '\\s+', ' ', 'g')) AS p FROM decided),
    found AS (
      SELECT *, instr(l, p) - 1 AS st, list_filter(range(len(text)), lambda i: text[i + 1] <> ' ') AS spots FROM loose),
    marks AS (SELECT *, len(replace(substr(l, 1, st), ' ', '')) AS k, len(replace(p, ' ', '')) AS m FROM found)
    SELECT id, null_score_diff,
           CASE WHEN text = '' OR st < 0 OR len(spots) <> len(replace(l, ' ', '')) THEN text
                ELSE substr(text, spots[k + 1] + 1, spots[k + m] - spots[k + 1] + 1) END AS text
    FROM marks""",
)
def qa_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole prediction job, answers trimmed to their tokens."""
    windows = features(spark, sf_dir, ANSWER_COLUMNS)
    out = pr.predict(windows, results(spark, sf_dir, windows), vocabulary(spark, sf_dir), PREDICT)
    return out.select("id", "text", F.round("null_score_diff", 6).alias("null_score_diff"))


# --- scoring ------------------------------------------------------------------


def scored_turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Assistant turns as gold answers; predictions are the same text in another
    form, the user's turn, or nothing."""
    turns = given(load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"), "conv_id")
    gold = turns.where("role = 'assistant'").select("conv_id", "turn", "text")
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    rows = gold.join(asked, ["conv_id", "turn"]).withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    answer = lambda t: F.struct(t.alias("text"))
    golds = F.array(answer(F.col("text")), answer(F.substring_index("text", " ", -3)), answer(F.lit(" ,.")))
    examples = rows.select("id", F.when(F.col("conv_id") % 5 == 2, F.slice(golds, 1, 0)).otherwise(golds).alias("answers"))
    predicted = (
        F.when(F.col("conv_id") % 7 == 1, F.lit(""))
        .when(F.col("conv_id") % 3 == 0, F.concat(F.lit("《"), F.translate("text", "aeiou", "AEIOU"), F.lit("》!")))
        .otherwise(F.col("asked"))
    )
    predictions = rows.where("conv_id % 13 <> 6").select(
        "id",
        predicted.alias("text"),
        (draws.seed(SEED, "prob", F.col("id")) % 1000 / 1000).alias("no_answer_prob"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("arrival"),
    )
    return examples, predictions


def _norm(x: str) -> str:
    out = f"translate({x}, '''\"《》<>〈〉()‘’', '            ')"
    return f"regexp_replace(regexp_replace(lower({out}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+', '', 'g')"


TURNS_SQL = f"""pairs AS (
  SELECT g.conv_id, g.turn, g.text, a.text AS asked, g.conv_id || '-' || g.turn AS id
  FROM conversations g JOIN conversations a ON a.conv_id = g.conv_id AND a.turn + 1 = g.turn
  WHERE g.role = 'assistant' AND a.role = 'user'),
answers AS (
  SELECT *, CASE WHEN conv_id % 5 = 2 THEN [] ELSE [{_norm("text")}, {_norm("array_to_string(string_split(text, ' ')[-3:], ' ')")}] END AS raw_golds,
         {_norm("CASE WHEN conv_id % 7 = 1 THEN '' WHEN conv_id % 3 = 0 THEN '《' || translate(text, 'aeiou', 'AEIOU') || '》!' ELSE asked END")} AS pred,
         conv_id % 7 <> 1 AND (CASE WHEN conv_id % 3 = 0 THEN text ELSE asked END) <> '' AS answered,
         {seed(str(SEED), "'prob'", "conv_id || '-' || turn")} % 1000 / 1000.0::DOUBLE AS prob
  FROM pairs),
golds AS (
  SELECT *, CASE WHEN len(list_filter(raw_golds, lambda g: g <> '')) = 0 THEN ['']
                 ELSE list_filter(raw_golds, lambda g: g <> '') END AS gs, len(raw_golds) > 0 AS has_answer
  FROM answers),
gold_rows AS (SELECT id, pred, unnest(gs) AS g FROM golds WHERE conv_id % 13 <> 6),
chars AS (
  SELECT id, g, 'p' AS side, unnest(string_split(pred, '')) AS c FROM gold_rows WHERE pred <> ''
  UNION ALL SELECT id, g, 'g', unnest(string_split(g, '')) FROM gold_rows WHERE g <> ''),
char_counts AS (
  SELECT id, g, c, count(*) FILTER (WHERE side = 'p') AS np, count(*) FILTER (WHERE side = 'g') AS ng FROM chars GROUP BY id, g, c),
common AS (SELECT id, g, sum(least(np, ng)) AS same FROM char_counts GROUP BY id, g),
per_gold AS (
  SELECT r.id, r.g, (r.pred = r.g)::INT::DOUBLE AS exact,
         CASE WHEN coalesce(c.same, 0) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * c.same / (len(r.pred) + len(r.g)) END AS f1
  FROM gold_rows r LEFT JOIN common c ON c.id = r.id AND c.g = r.g),
scores AS (
  SELECT g.id, g.conv_id * 1000 + g.turn AS arrival, g.has_answer, g.answered, g.prob, max(p.exact) AS exact, max(p.f1) AS f1
  FROM golds g JOIN per_gold p USING (id) GROUP BY ALL)"""


def _html_sql() -> str:
    out = "regexp_replace(html, '(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', '', 'g')"
    out = f"regexp_replace({out}, '<[/!?a-zA-Z][^>]*>', '', 'g')"
    for name, char in (("copy", "©"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("nbsp", chr(160)), ("middot", "·")):
        out = f"replace({out}, '&{name};', '{char}')"
    return f"regexp_replace({out}, '&amp(;|\\b)', '&', 'g')"


@query("normalise_answer", f"SELECT page_id, {_norm(_html_sql())} AS text FROM pages")
def normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages through answer normalisation."""
    pages = given(load(spark, sf_dir, "pages", "page_id", "html"), "page_id")
    return pages.select("page_id", normalise_answer(F.col("html")).alias("text"))


@query("exact_match", f"WITH {TURNS_SQL} SELECT id, max(exact) AS exact FROM per_gold GROUP BY id")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a prediction equals one of its gold answers."""
    return sc.raw_scores(*scored_turns(spark, sf_dir)).select("id", "exact")


@query(
    "char_f1",
    f"""WITH {TURNS_SQL}, plain AS (
          SELECT conv_id, turn, {_norm("text")} AS a, {_norm("asked")} AS b FROM pairs),
        cs AS (
          SELECT conv_id, turn, 'a' AS side, unnest(string_split(a, '')) AS c FROM plain WHERE a <> ''
          UNION ALL SELECT conv_id, turn, 'b', unnest(string_split(b, '')) FROM plain WHERE b <> ''),
        cc AS (
          SELECT conv_id, turn, c, least(count(*) FILTER (WHERE side = 'a'), count(*) FILTER (WHERE side = 'b')) AS n
          FROM cs GROUP BY ALL)
        SELECT p.conv_id, p.turn, round(coalesce(2.0::DOUBLE * s.n / nullif(len(a) + len(b), 0), 0), 6) AS f1
        FROM plain p LEFT JOIN (SELECT conv_id, turn, sum(n) AS n FROM cc GROUP BY conv_id, turn) s USING (conv_id, turn)""",
)
def character_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character overlap of a turn and the answer to it."""
    turns = given(load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"), "conv_id")
    gold = turns.where("role = 'assistant'").select("conv_id", "turn", normalise_answer(F.col("text")).alias("a"))
    asked = turns.where("role = 'user'").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), normalise_answer(F.col("text")).alias("b")
    )
    return gold.join(asked, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(char_f1(F.col("a"), F.col("b")), 6).alias("f1")
    )


@query(
    "max_over_golds",
    f"WITH {TURNS_SQL} SELECT id, has_answer, answered, exact, round(f1, 6) AS f1 FROM scores",
)
def max_over_golds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best exact match and F1 over the gold answers of a question."""
    rows = sc.raw_scores(*scored_turns(spark, sf_dir))
    return rows.select("id", "has_answer", "answered", "exact", F.round("f1", 6).alias("f1"))


def _best_sql(kind: str) -> str:
    return f"""{kind}_runs AS (
  SELECT *, (SELECT count(*) FROM golds WHERE NOT has_answer)
            + sum(CASE WHEN has_answer THEN {kind} WHEN answered THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END)
                OVER (ORDER BY prob, arrival) AS run FROM scores)"""


THRESHOLD_SQL = f"""WITH {TURNS_SQL}, {_best_sql("exact")}, {_best_sql("f1")},
  base AS (SELECT count(*) FILTER (WHERE NOT has_answer) AS n0 FROM golds)
  SELECT round(100 * greatest(n0, (SELECT max(run) FROM exact_runs)) / (SELECT count(*) FROM scores), 6) AS best_exact,
         round(100 * greatest(n0, (SELECT max(run) FROM f1_runs)) / (SELECT count(*) FROM scores), 6) AS best_f1,
         CASE WHEN (SELECT max(run) FROM exact_runs) > n0
              THEN (SELECT min_by(prob, (-run, prob, arrival)) FROM exact_runs) ELSE 0.0::DOUBLE END AS best_exact_thresh,
         CASE WHEN (SELECT max(run) FROM f1_runs) > n0
              THEN (SELECT min_by(prob, (-round(run, 9), prob, arrival)) FROM f1_runs) ELSE 0.0::DOUBLE END AS best_f1_thresh,
         (SELECT round(avg(exact), 6) FROM scores WHERE has_answer) AS has_ans_exact,
         (SELECT round(avg(f1), 6) FROM scores WHERE has_answer) AS has_ans_f1
  FROM base"""


@query("threshold_report", THRESHOLD_SQL)
def threshold_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best scores over all no-answer thresholds."""
    examples, predictions = scored_turns(spark, sf_dir)
    unanswerable = examples.agg(F.count(F.when(F.size("answers") == 0, 1)).alias("n"))
    return rounded(sc.best_thresholds(sc.raw_scores(examples, predictions), unanswerable))


@query(
    "qa_report",
    f"""WITH {TURNS_SQL}, applied AS (
          SELECT *, CASE WHEN prob > 0.9 THEN (NOT has_answer)::INT::DOUBLE ELSE exact END AS x,
                 CASE WHEN prob > 0.9 THEN (NOT has_answer)::INT::DOUBLE ELSE f1 END AS y FROM scores)
        SELECT round(100 * avg(x), 6) AS exact, round(100 * avg(y), 6) AS f1, count(*) AS total,
               round(100 * avg(x) FILTER (WHERE has_answer), 6) AS "HasAns_exact",
               round(100 * avg(y) FILTER (WHERE has_answer), 6) AS "HasAns_f1",
               count(*) FILTER (WHERE has_answer) AS "HasAns_total",
               round(100 * avg(x) FILTER (WHERE NOT has_answer), 6) AS "NoAns_exact",
               round(100 * avg(y) FILTER (WHERE NOT has_answer), 6) AS "NoAns_f1",
               count(*) FILTER (WHERE NOT has_answer) AS "NoAns_total"
        FROM applied""",
)
def qa_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores in percent after a no-answer threshold, split by answerability."""
    scores = sc.raw_scores(*scored_turns(spark, sf_dir))
    return rounded(sc.score_summary(sc.apply_threshold(scores, 0.9)))


@query(
    "missing_predictions",
    f"WITH {TURNS_SQL} SELECT id FROM pairs WHERE conv_id % 13 = 6",
)
def missing_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions nobody answered."""
    return sc.missing_predictions(*scored_turns(spark, sf_dir))


@query(
    "question_report",
    f"""WITH {TURNS_SQL}, {_best_sql("exact")}, {_best_sql("f1")},
      base AS (SELECT count(*) FILTER (WHERE NOT has_answer) AS n0 FROM golds),
      best AS (
        SELECT 100 * greatest(n0, (SELECT max(run) FROM exact_runs)) / (SELECT count(*) FROM scores) AS be,
               100 * greatest(n0, (SELECT max(run) FROM f1_runs)) / (SELECT count(*) FROM scores) AS bf FROM base)
      SELECT 'HasAns_total' AS metric, count(*)::DOUBLE AS value FROM scores WHERE has_answer
      UNION ALL SELECT 'NoAns_total', count(*)::DOUBLE FROM scores WHERE NOT has_answer
      UNION ALL SELECT 'HasAns_exact', round(100 * avg(exact), 2) FROM scores WHERE has_answer
      UNION ALL SELECT 'HasAns_f1', round(100 * avg(f1), 2) FROM scores WHERE has_answer
      UNION ALL SELECT 'NoAns_exact', round(100 * avg(exact), 2) FROM scores WHERE NOT has_answer
      UNION ALL SELECT 'best_exact', round(be, 2) FROM best
      UNION ALL SELECT 'best_f1', round(bf, 2) FROM best
      UNION ALL SELECT 'best_score', round(bf, 2) FROM best
      UNION ALL SELECT 'missing', count(*)::DOUBLE FROM pairs WHERE conv_id % 13 = 6""",
)
def question_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation report with its best score."""
    return sc.question_report(*scored_turns(spark, sf_dir), version_2=True)
