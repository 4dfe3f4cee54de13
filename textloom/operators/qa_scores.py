"""Scores of predicted answers, thresholds, and the evaluation report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrays import let
from textloom.functions.text import char_f1, normalise_answer
from textloom.operators.ordering import ordered_blocks, running_sum


def exact_match(prediction: Column, truth: Column) -> Column:
    return normalise_answer(prediction) == normalise_answer(truth)


def gold_texts(answers: Column) -> Column:
    """Normalised gold answers that are not empty; without any, the empty text."""
    golds = F.filter(F.transform(answers, lambda a: normalise_answer(a["text"])), lambda g: g != "")
    return let(golds, lambda gs: F.when(F.size(gs) == 0, F.array(F.lit(""))).otherwise(gs))


def answer_scores(answers: Column, prediction: Column) -> Column:
    """``struct<exact, f1>``: the best over the gold answers."""

    def best(golds: Column, p: Column) -> Column:
        return F.struct(
            F.exists(golds, lambda g: g == p).cast("double").alias("exact"),
            F.array_max(F.transform(golds, lambda g: char_f1(p, g))).alias("f1"),
        )

    return let(gold_texts(answers), lambda gs: let(normalise_answer(prediction), lambda p: best(gs, p)))


def missing_predictions(examples: DataFrame, predictions: DataFrame) -> DataFrame:
    return examples.join(predictions, "id", "left_anti").select("id")


def raw_scores(examples: DataFrame, predictions: DataFrame) -> DataFrame:
    """``id, has_answer, answered, exact, f1, no_answer_prob, arrival`` per scored
    question. Without a probability column it is 0; ``arrival`` breaks ties when
    questions are ordered by it: the order of predictions where they have one, else
    the order of the questions in their files, else none (null)."""
    prob = F.col("no_answer_prob") if "no_answer_prob" in predictions.columns else F.lit(0.0)
    ordered = ["arrival"] if "arrival" in predictions.columns else []
    place = F.col("arrival") if "arrival" in examples.columns else F.lit(None).cast("long").alias("arrival")
    asked = examples.select("id", "answers", *([] if ordered else [place]))
    rows = asked.join(predictions.select("id", "text", prob.alias("no_answer_prob"), *ordered), "id")
    scored = rows.withColumn("s", answer_scores(F.col("answers"), F.col("text")))
    return scored.select(
        "id",
        (F.size("answers") > 0).alias("has_answer"),
        (F.col("text") != "").alias("answered"),
        "s.exact",
        "s.f1",
        "no_answer_prob",
        "arrival",
    )


def apply_threshold(scores: DataFrame, threshold: float = 1.0) -> DataFrame:
    """A question whose no-answer probability exceeds the threshold counts as
    unanswered: right when it has no answer."""
    no = F.col("no_answer_prob") > threshold
    right = F.when(F.col("has_answer"), F.lit(0.0)).otherwise(F.lit(1.0))
    pick = lambda c: F.when(no, right).otherwise(F.col(c))
    return scores.withColumn("exact", pick("exact")).withColumn("f1", pick("f1"))


def score_summary(scores: DataFrame) -> DataFrame:
    """Means in percent and counts: all, answerable and unanswerable questions, in one pass."""
    has = F.col("has_answer")
    percent = lambda c, on: F.avg(F.when(on, F.col(c))) * 100
    columns = []
    for prefix, on in (("", F.lit(True)), ("HasAns_", has), ("NoAns_", ~has)):
        columns += [
            percent("exact", on).alias(f"{prefix}exact"),
            percent("f1", on).alias(f"{prefix}f1"),
            F.count(F.when(on, 1)).alias(f"{prefix}total"),
        ]
    return scores.agg(*columns)


def best_thresholds(scores: DataFrame, n_unanswerable: DataFrame | None = None, blocks: int | None = None) -> DataFrame:
    """Best exact and F1 when answering only below some no-answer probability.

    Questions are ordered by probability, then arrival; the score starts at the
    number of unanswerable questions and moves by the score of an answerable one,
    or by -1 for an unanswerable one that was answered. The first strict maximum
    counts. ``n_unanswerable`` (one row, column ``n``) overrides the number taken
    from the scored questions, when some were not scored.
    """
    answered = F.when(F.col("answered"), -1.0).otherwise(0.0)
    moves = scores.select(
        "no_answer_prob",
        "arrival",
        "has_answer",
        "exact",
        "f1",
        F.when(F.col("has_answer"), F.col("exact")).otherwise(answered).alias("exact_move"),
        F.when(F.col("has_answer"), F.col("f1")).otherwise(answered).alias("f1_move"),
    )
    order = [F.col("no_answer_prob"), F.col("arrival")]
    rows = ordered_blocks(moves, *order, blocks=blocks)
    for name in ("exact", "f1"):
        rows = running_sum(rows, F.col(f"{name}_move"), order, f"{name}_run")
    first = lambda c: F.min_by("no_answer_prob", F.struct((-F.col(c)).alias("v"), *order))
    tops = rows.agg(
        F.count("*").alias("n"),
        F.count(F.when(~F.col("has_answer"), 1)).alias("n_no"),
        *[F.max(f"{k}_run").alias(f"{k}_top") for k in ("exact", "f1")],
        *[first(f"{k}_run").alias(f"{k}_at") for k in ("exact", "f1")],
        *[F.avg(F.when(F.col("has_answer"), F.col(k))).alias(f"has_ans_{k}") for k in ("exact", "f1")],
    )
    if n_unanswerable is not None:
        known = n_unanswerable.select(F.col("n").alias("n_no"), F.lit(1).alias("_one"))
        tops = tops.drop("n_no").withColumn("_one", F.lit(1)).join(known, "_one").drop("_one")
    columns = []
    for k in ("exact", "f1"):
        top = F.greatest(F.lit(0.0), F.col(f"{k}_top"))
        columns.append(((F.col("n_no") + top) * 100 / F.col("n")).alias(f"best_{k}"))
        columns.append(F.when(F.col(f"{k}_top") > 0, F.col(f"{k}_at")).otherwise(0.0).alias(f"best_{k}_thresh"))
        columns.append(F.col(f"has_ans_{k}"))
    return tops.select(*columns)


REPORT_KEYS = ("HasAns_total", "NoAns_total", "best_exact", "best_f1")
NEGATIVE_KEYS = ("HasAns_exact", "HasAns_f1", "NoAns_exact")


def question_report(
    examples: DataFrame, predictions: DataFrame, version_2: bool = False, threshold: float = 1.0
) -> DataFrame:
    """``(metric, value)`` rounded to two digits, with ``best_score`` and the number
    of questions without a prediction."""
    if "arrival" not in predictions.columns and "arrival" not in examples.columns:
        raise ValueError("neither the predictions nor the questions have an order (arrival)")
    raw = raw_scores(examples, predictions)
    unanswerable = examples.agg(F.count(F.when(F.size("answers") == 0, 1)).alias("n"))
    summary = score_summary(apply_threshold(raw, threshold)).withColumn("_one", F.lit(1))
    best = best_thresholds(raw, unanswerable).withColumn("_one", F.lit(1))
    missing = missing_predictions(examples, predictions).agg(F.count("*").alias("missing")).withColumn("_one", F.lit(1))
    wide = summary.join(best, "_one").join(missing, "_one")
    keys = [*REPORT_KEYS, *(NEGATIVE_KEYS if version_2 else ()), "missing"]
    named = [(k, k) for k in keys] + [("best_score", "best_f1")]
    pairs = [F.struct(F.lit(m).alias("metric"), F.bround(F.col(c).cast("double"), 2).alias("value")) for m, c in named]
    rows = wide.select(F.explode(F.array(*pairs)).alias("v")).select("v.*")
    # a group without questions is left out
    empty = (F.col("metric").startswith("HasAns_") | F.col("metric").startswith("NoAns_")) & F.coalesce(
        F.col("value") == 0, F.lit(True)
    ) & F.col("metric").endswith("_total")
    return rows.where(F.col("value").isNotNull() & ~empty)
