"""Labels, classification features, metrics and run logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.base import documents, load, query, vocabulary
from queries.sql import seed, with_parts
from textloom.functions.arrays import argmax
from textloom.operators import labels as lab
from textloom.operators import metrics
from textloom.session import write_through


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a text label made of language and quality."""
    rows = documents(spark, sf_dir, "doc_id", "lang", "text").join(load(spark, sf_dir, "labels"), "doc_id")
    return rows.select(
        "doc_id", "text", F.concat_ws("-", "lang", F.col("quality").cast("string")).alias("label"), "quality", "toxic"
    )


LABELLED_SQL = """labelled AS (
  SELECT doc_id, text, lang || '-' || quality AS label, quality, toxic FROM documents JOIN labels USING (doc_id))"""
MAP_SQL = LABELLED_SQL + """, label_map AS (
  SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM (SELECT DISTINCT label FROM labelled))"""


@query("label_map", f"WITH {MAP_SQL} SELECT label, id FROM label_map")
def label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct labels in order, numbered."""
    return lab.label_map(labelled(spark, sf_dir)).select("label", F.col("id").cast("bigint").alias("id"))


@query(
    "encode_labels",
    f"WITH {MAP_SQL} SELECT doc_id, id AS label FROM labelled JOIN label_map USING (label)",
)
def encode_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels replaced by their ids."""
    rows = labelled(spark, sf_dir).select("doc_id", "label")
    return lab.encode_labels(rows, lab.label_map(rows)).select("doc_id", F.col("label").cast("bigint").alias("label"))


SPLIT_SQL = LABELLED_SQL + f""", sizes AS (
  SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM labelled GROUP BY label),
shares AS (
  SELECT *, ceil(total * 0.2::DOUBLE) AS n_test, n * ceil(total * 0.2::DOUBLE) / total AS share FROM sizes),
quotas AS (
  SELECT *, floor(share) + CASE WHEN row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, label)
                                     <= n_test - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS quota FROM shares),
split AS (
  SELECT doc_id, label, text,
         row_number() OVER (PARTITION BY label ORDER BY {seed("42", "'split'", "doc_id")}, doc_id) <= quota AS is_test
  FROM labelled JOIN quotas USING (label))"""


@query("stratified_split", f"WITH {SPLIT_SQL} SELECT doc_id, label, is_test FROM split")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """80/20 by label with exact counts."""
    rows = labelled(spark, sf_dir).select("doc_id", "label")
    return lab.stratified_split(rows, "doc_id").select("doc_id", "label", "is_test")


@query(
    "cls_features",
    with_parts(
        "line_tokens",
        f""", {MAP_SQL}, doc_tokens AS (
          SELECT doc_id, flatten(list(toks ORDER BY line_no)) AS toks FROM numbered GROUP BY doc_id),
        cut AS (
          SELECT l.doc_id, m.id AS labels, ['[CLS]'] || coalesce(d.toks, [])[1:126] || ['[SEP]'] AS toks
          FROM labelled l JOIN label_map m USING (label) LEFT JOIN doc_tokens d USING (doc_id)),
        positions AS (SELECT doc_id, unnest(toks) AS token, unnest(range(len(toks))) AS i FROM cut),
        encoded AS (SELECT doc_id, list(id ORDER BY i) AS ids FROM positions JOIN vocab USING (token) GROUP BY doc_id)
        SELECT c.doc_id, c.labels, len(c.toks)::BIGINT AS n_tokens,
               array_to_string(e.ids || list_transform(range(128 - len(e.ids)), lambda x: 0), ',') AS input_ids
        FROM cut c JOIN encoded e USING (doc_id)""",
    ),
)
def cls_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-length features of labelled documents."""
    rows = labelled(spark, sf_dir).select("doc_id", "text", "label")
    coded = lab.encode_labels(rows, lab.label_map(rows))
    out = lab.classification_features(
        coded, vocabulary(spark, sf_dir), 128, F.col("text"), F.col("label").cast("bigint"), ["doc_id"]
    )
    return out.select(
        "doc_id",
        "labels",
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("bigint").alias("n_tokens"),
        F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",").alias("input_ids"),
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if kinds[c] == "double" else F.col(f"`{c}`") for c in df.columns])


BINARY_SQL = """WITH c AS (
         SELECT sum((quality = 1 AND toxic = 1)::INT)::DOUBLE AS tp, sum((quality <> 1 AND toxic = 1)::INT)::DOUBLE AS fp,
                sum((quality = 1 AND toxic <> 1)::INT)::DOUBLE AS fn, sum((quality <> 1 AND toxic <> 1)::INT)::DOUBLE AS tn
         FROM labels)
       SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
              round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
              round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
              round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1,
              round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0
                         ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END, 6)
                AS matthews_corrcoef,
              round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS roc_auc
       FROM c"""


@query("binary_metrics", BINARY_SQL)
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality as the label, toxic as a (poor) prediction of it."""
    return rounded(metrics.binary_metrics(load(spark, sf_dir, "labels"), "quality", "toxic"))


NAMES = ["accuracy", "precision", "recall", "f1", "matthews_corrcoef", "roc_auc"]


@query(
    "metric_lookup",
    f"WITH m AS ({BINARY_SQL}) " + " UNION ALL ".join(f"SELECT '{n}' AS metric, {n} AS value FROM m" for n in NAMES),
)
def metric_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by name from one table of counts."""
    cells = write_through(metrics.confusion(load(spark, sf_dir, "labels"), "quality", "toxic"))
    values = [metrics.metric(cells, name) for name in NAMES]
    return rounded(reduce(DataFrame.unionByName, values))


def class_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return rows.select("vec_id", argmax(F.transform(F.sequence(F.lit(0), F.lit(9)), every_nth(10))).alias("prediction"), "label")


def every_nth(n: int):
    """Sums over the whole vector of the positions k, k + n, k + 2n, …"""
    return lambda k: F.aggregate(
        F.filter("embedding", lambda _, i: i % n == k), F.lit(0.0), lambda a, x: a + x.cast("double")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")


CLASS_SQL = """results AS (
  SELECT vec_id, label, list_position(s, list_max(s)) - 1 AS prediction
  FROM (SELECT vec_id, label, list_transform(range(10), lambda k:
          list_sum(list_transform(list_filter(range(64), lambda i: i % 10 = k), lambda i: embedding[i + 1]::DOUBLE))) AS s
        FROM embeddings))"""


@query(
    "macro_metrics",
    f"""WITH {CLASS_SQL}, classes AS (SELECT label AS c FROM results UNION SELECT prediction FROM results),
        per AS (
          SELECT c, (SELECT count(*) FROM results WHERE label = c AND prediction = c) AS tp,
                 (SELECT count(*) FROM results WHERE label = c) AS gold,
                 (SELECT count(*) FROM results WHERE prediction = c) AS pred FROM classes)
        SELECT round(sum(tp) / sum(gold)::DOUBLE, 6) AS accuracy, round(avg(2.0::DOUBLE * tp / (gold + pred)), 6) AS "f1-macro"
        FROM per""",
)
def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-class logits against their labels."""
    return rounded(metrics.macro_metrics(class_results(spark, sf_dir)))


@query(
    "classification_report",
    f"""WITH {CLASS_SQL}, classes AS (SELECT label AS c FROM results UNION SELECT prediction FROM results),
        per AS (
          SELECT c, (SELECT count(*) FROM results WHERE label = c AND prediction = c) AS tp,
                 (SELECT count(*) FROM results WHERE label = c) AS gold,
                 (SELECT count(*) FROM results WHERE prediction = c) AS pred FROM classes),
        m AS (SELECT sum(tp) / sum(gold)::DOUBLE AS a, avg(2.0::DOUBLE * tp / (gold + pred)) AS f FROM per)
        SELECT 'accuracy' AS metric, round(a * 100, 2) AS value FROM m
        UNION ALL SELECT 'f1-macro', round(f * 100, 2) FROM m
        UNION ALL SELECT 'best_score', round(f * 100, 2) FROM m""",
)
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric set chosen by the number of gold labels, in percent."""
    return metrics.classification_report(class_results(spark, sf_dir))


@query(
    "mlm_metrics",
    """WITH positions AS (
         SELECT vec_id // 16 AS batch, vec_id, i, -abs(embedding[i + 1])::DOUBLE AS lp, (vec_id + i) % 7 AS predicted,
                (vec_id * i) % 7 AS label, CASE WHEN i < 40 + vec_id % 24 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS w
         FROM embeddings, (SELECT unnest(range(64)) AS i)),
       batches AS (
         SELECT batch, sum(CASE WHEN predicted = label THEN w ELSE 0 END) AS hit, sum(w) AS w, sum(-w * lp) AS nll
         FROM positions GROUP BY batch),
       ns AS (
         SELECT vec_id // 16 AS batch, label % 2 AS label, -abs(list_sum(list_transform(range(32), lambda i: embedding[2 * i + 1]::DOUBLE))) AS l0,
                -abs(list_sum(list_transform(range(32), lambda i: embedding[2 * i + 2]::DOUBLE))) AS l1
         FROM embeddings),
       nsb AS (
         SELECT batch, sum(((CASE WHEN l0 >= l1 THEN 0 ELSE 1 END) = label)::INT) AS hit, count(*) AS n,
                avg(CASE WHEN label = 0 THEN -l0 ELSE -l1 END) AS nll FROM ns GROUP BY batch)
       SELECT round(sum(hit) / sum(w), 6) AS masked_lm_accuracy, round(avg(nll / (w + 1e-5::DOUBLE)), 6) AS masked_lm_loss,
              (SELECT round(sum(hit) / sum(n)::DOUBLE, 6) FROM nsb) AS next_sentence_accuracy,
              (SELECT round(avg(nll), 6) FROM nsb) AS next_sentence_loss
       FROM batches""",
)
def mlm_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked-token and next-sentence metrics; vectors stand in for log-probabilities."""
    rows = vectors(spark, sf_dir)
    batch = F.floor(F.col("vec_id") / 16).alias("batch")
    spots = F.sequence(F.lit(0), F.lit(63))
    masked = rows.select(
        batch,
        F.transform(spots, lambda i: (F.col("vec_id") + i) % 7).alias("predicted"),
        F.transform(spots, lambda i: (F.col("vec_id") * i) % 7).alias("labels"),
        F.transform(spots, lambda i: F.when(i < 40 + F.col("vec_id") % 24, 1.0).otherwise(0.0)).alias("weights"),
        F.transform("embedding", lambda x: -F.abs(x).cast("double")).alias("log_probs"),
    )
    pairs = rows.select(
        batch,
        (F.col("label") % 2).alias("label"),
        F.transform(F.sequence(F.lit(0), F.lit(1)), lambda k: -F.abs(every_nth(2)(k))).alias("log_probs"),
    )
    left = metrics.masked_lm_metrics(masked, "batch").withColumn("k", F.lit(0))
    right = metrics.next_sentence_metrics(pairs, "batch").withColumn("k", F.lit(0))
    return rounded(left.join(right, "k").drop("k"))


@query(
    "best_checkpoint",
    """WITH scored AS (
         SELECT user_id, ts, event_id, value,
                greatest(0, coalesce(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS best FROM events),
       saved AS (SELECT * FROM scored WHERE value >= best)
       SELECT user_id, count(*) AS n_saved, max_by(event_id, (ts, event_id)) AS event_id,
              max_by(value, (ts, event_id)) AS value FROM saved GROUP BY user_id""",
)
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an evaluation log: one run per user, the value as the score."""
    log = load(spark, sf_dir, "events", "user_id", "ts", "event_id", "value")
    return metrics.best_checkpoint(log, "user_id", ["ts", "event_id"], "value").drop("ts")


@query(
    "loss_ema",
    """WITH RECURSIVE log AS (
         SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
       avgs AS (
         SELECT user_id, k, value AS a FROM log WHERE k = 1
         UNION ALL
         SELECT l.user_id, l.k, CASE WHEN a.a = 0 THEN l.value ELSE a.a * 0.99::DOUBLE + (1 - 0.99::DOUBLE) * l.value END
         FROM avgs a JOIN log l ON l.user_id = a.user_id AND l.k = a.k + 1)
       SELECT user_id, max(k) AS n_steps, round(max_by(a, k), 6) AS avg_loss FROM avgs GROUP BY user_id""",
)
def loss_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving average of the value per user, the value as a batch loss."""
    log = load(spark, sf_dir, "events", "user_id", "ts", "event_id", "value")
    return rounded(metrics.running_loss(log, "user_id", ["ts", "event_id"], "value"))
