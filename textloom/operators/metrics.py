"""Classification and language-model metrics, and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.ordering import block_offsets, ordered_blocks
from textloom.session import write_through


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Row counts per (label, prediction); everything below works on this table."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count("*").alias("n")
    )


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def _binary_columns() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    product = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    both = (tp + fn > 0) & (tn + fp > 0)
    return {
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn),
        "precision": precision,
        "recall": recall,
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "matthews_corrcoef": _ratio(tp * tn - fp * fn, product),
        # area under the curve of hard predictions; undefined with one class
        "roc_auc": F.when(both, (_ratio(tp, tp + fn) + _ratio(tn, tn + fp)) / 2),
    }


def _binary(cells: DataFrame) -> DataFrame:
    pos, pred = F.col("label") == 1, F.col("prediction") == 1
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    sums = cells.agg(
        count(pos & pred).alias("tp"),
        count(~pos & pred).alias("fp"),
        count(pos & ~pred).alias("fn"),
        count(~pos & ~pred).alias("tn"),
    )
    return sums.select(*[c.alias(name) for name, c in _binary_columns().items()])


def _macro(cells: DataFrame) -> DataFrame:
    hit = (F.col("label") == F.col("prediction")).cast("bigint") * F.col("n")
    parts = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("class"), hit.alias("tp"), F.col("n").alias("gold"), F.lit(0).cast("bigint").alias("pred")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("gold"), F.col("n").alias("pred")),
            )
        ).alias("p")
    ).select("p.*")
    per_class = parts.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("gold").alias("gold"), F.sum("pred").alias("pred"))
    f1 = 2.0 * F.col("tp") / (F.col("gold") + F.col("pred"))
    return per_class.agg(
        (F.sum("tp") / F.sum("gold").cast("double")).alias("accuracy"), F.avg(f1).alias("f1-macro")
    )


#: The sets of metrics over a :func:`confusion` table, and the one that tells the best model.
METRIC_SETS = {"binary": _binary, "multi": _macro}
BEST = {"binary": "f1", "multi": "f1-macro"}


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row of binary metrics; the positive label is 1, empty denominators give 0."""
    return _binary(confusion(df, label, prediction))


def macro_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and the mean F1 over all classes seen as label or prediction."""
    return _macro(confusion(df, label, prediction))


def metric(cells: DataFrame, name: str, kind: str = "binary") -> DataFrame:
    """The metric of that name, one row ``metric, value``, from a :func:`confusion` table."""
    row = METRIC_SETS[kind](cells)
    if name not in row.columns:
        raise ValueError(f"unknown metric {name}; there are {', '.join(row.columns)}")
    return row.select(F.lit(name).alias("metric"), F.col(f"`{name}`").alias("value"))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(metric, value)`` in percent, rounded to two digits, with ``best_score``:
    the binary set when there are fewer than three gold labels, else the macro set.
    The rows are read once; the rest works on their counts."""
    cells = write_through(confusion(df, label, prediction))
    kind = "binary" if cells.agg(F.count_distinct("label")).first()[0] < 3 else "multi"
    row = METRIC_SETS[kind](cells)
    pairs = [(c, c) for c in row.columns] + [("best_score", BEST[kind])]
    values = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.bround(F.col(f"`{c}`") * 100, 2).alias("value")) for m, c in pairs]
    )
    return row.select(F.explode(values).alias("v")).select("v.*")


def masked_lm_metrics(df: DataFrame, batch: str) -> DataFrame:
    """Masked-token accuracy and loss.

    ``df`` has per example ``predicted``, ``labels`` (ids), ``weights`` and
    ``log_probs`` (of the gold token), one element per position. Accuracy weighs
    all positions; the loss is the mean over batches of each batch's weighted
    negative log-likelihood. Positions are summed inside the row.
    """
    pairs = F.arrays_zip("predicted", "labels", "weights", "log_probs")
    add = lambda f: F.aggregate(pairs, F.lit(0.0).cast("double"), lambda a, z: a + f(z))
    sums = df.select(
        F.col(batch).alias("batch"),
        add(lambda z: F.when(z["predicted"] == z["labels"], z["weights"]).otherwise(0.0)).alias("hit"),
        add(lambda z: z["weights"].cast("double")).alias("weight"),
        add(lambda z: -z["weights"] * z["log_probs"]).alias("nll"),
    )
    batches = sums.groupBy("batch").agg(F.sum("hit").alias("hit"), F.sum("weight").alias("weight"), F.sum("nll").alias("nll"))
    return batches.agg(
        (F.sum("hit") / F.sum("weight")).alias("masked_lm_accuracy"),
        F.avg(F.col("nll") / (F.col("weight") + 1e-5)).alias("masked_lm_loss"),
    )


def next_sentence_metrics(df: DataFrame, batch: str) -> DataFrame:
    """Accuracy and mean batch loss of the two-class head: ``log_probs`` (two
    values) and ``label`` per example. The first class wins ties."""
    probs = F.col("log_probs")
    predicted = F.when(probs[0] >= probs[1], 0).otherwise(1)
    rows = df.select(
        F.col(batch).alias("batch"),
        (predicted == F.col("label")).cast("bigint").alias("hit"),
        (-probs[F.col("label").cast("int")]).alias("nll"),
    )
    batches = rows.groupBy("batch").agg(F.sum("hit").alias("hit"), F.count("*").alias("n"), F.avg("nll").alias("nll"))
    return batches.agg(
        (F.sum("hit") / F.sum("n")).alias("next_sentence_accuracy"), F.avg("nll").alias("next_sentence_loss")
    )


def saved_checkpoints(log: DataFrame, run: str, order: list[str], score: str) -> DataFrame:
    """Rows of an evaluation log at which a checkpoint is saved: the score reaches
    the best so far (0 at the start, later rows win ties).

    Runs are cut into blocks; each block starts from the best of the blocks before.
    """
    blocked = ordered_blocks(log, run, *order)
    tops = blocked.groupBy(run, "block").agg(F.max(score).alias("_top"))
    earlier_blocks = Window.partitionBy(run).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(run, "block", F.max("_top").over(earlier_blocks).alias("_before"))
    earlier_rows = Window.partitionBy(run, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = blocked.withColumn("_inside", F.max(score).over(earlier_rows)).join(tops, [run, "block"])
    best = F.greatest(F.lit(0.0), "_before", "_inside")
    return rows.where(F.col(score) >= best).drop("_before", "_inside", "block")


def best_checkpoint(log: DataFrame, run: str, order: list[str], score: str) -> DataFrame:
    """The last saved checkpoint of each run, and how many were saved."""
    saved = saved_checkpoints(log, run, order, score)
    last = F.max_by(F.struct(*order, score), F.struct(*order)).alias("last")
    return saved.groupBy(run).agg(F.count("*").alias("n_saved"), last).select(run, "n_saved", "last.*")


def running_loss(log: DataFrame, run: str, order: list[str], loss: str, decay: float = 0.99) -> DataFrame:
    """Final moving average of the (non-negative) loss of each run: it takes over
    the first non-zero loss and then decays.

    The loop ``avg = avg * decay + (1 - decay) * loss`` is a weighted sum in which
    a row counts by its distance from the end, so ranks are all that is needed.
    """
    blocked = ordered_blocks(log, run, *order)
    offsets = block_offsets(blocked, F.lit(1), (run,)).join(blocked.groupBy(run).agg(F.count("*").alias("_n")), run)
    inside = Window.partitionBy(run, "block").orderBy(*order)
    ranked = blocked.withColumn("_rank", F.row_number().over(inside)).join(offsets, [run, "block"])
    rank = F.col("_rank") + F.col("_offset")
    weight = F.pow(F.lit(decay), F.col("_n") - rank)
    rows = ranked.select(run, rank.alias("rank"), F.col(loss).alias("loss"), weight.alias("weight"))
    sums = rows.groupBy(run).agg(
        F.count("*").alias("n_steps"),
        F.sum((1 - decay) * F.col("loss") * F.col("weight")).alias("tail"),
        F.min_by(F.when(F.col("loss") != 0, F.col("loss") * F.col("weight")), F.when(F.col("loss") != 0, F.col("rank"))).alias("first"),
    )
    return sums.select(run, "n_steps", (F.col("tail") + decay * F.coalesce("first", F.lit(0.0))).alias("avg_loss"))
