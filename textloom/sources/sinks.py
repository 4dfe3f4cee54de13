"""Sinks, the feature cache, and reading examples back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from textloom.functions import draws

EXAMPLE_SCHEMA = (
    "input_ids array<bigint>, segment_ids array<bigint>, masked_lm_positions array<bigint>, "
    "masked_lm_ids array<bigint>, masked_lm_weights array<float>, next_sentence_labels array<bigint>"
)


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def write_examples(examples: DataFrame, path: str, n_files: int = 1000) -> int:
    """Write examples as Parquet over a fixed number of files, replacing what is
    there, and return how many were written. Examples are dealt out by their key,
    which spreads every shard over all files."""
    keys = [F.col(c) for c in ("shard", "dupe", "grp", "chunk")]
    seen = Observation()
    rows = examples.withColumn("_file", (draws.seed("file", *keys) % n_files).cast("int")).observe(seen, F.count(F.lit(1)).alias("n"))
    rows.repartitionById(n_files, "_file").drop("_file").write.mode("overwrite").parquet(path)
    return seen.get["n"]


def read_examples(spark: SparkSession, path: str, max_length: int, max_predictions: int) -> DataFrame:
    """Examples with 32-bit integers; a row whose arrays do not have the declared
    lengths is an error."""
    rows = spark.read.schema(EXAMPLE_SCHEMA).parquet(path)
    sizes = {
        "input_ids": max_length,
        "segment_ids": max_length,
        "masked_lm_positions": max_predictions,
        "masked_lm_ids": max_predictions,
        "masked_lm_weights": max_predictions,
        "next_sentence_labels": 1,
    }

    def checked(name: str, size: int):
        kind = "array<float>" if name == "masked_lm_weights" else "array<int>"
        wrong = F.raise_error(F.lit(f"{name} must have {size} elements")).cast(kind)
        return F.when(F.size(name) == size, F.col(name).cast(kind)).otherwise(wrong).alias(name)

    return rows.select(*[checked(name, size) for name, size in sizes.items()])


def write_features(features: DataFrame, path: str) -> int:
    """Write features and return the number of rows."""
    seen = Observation()
    features.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return seen.get["n"]


def feature_path(data_path: str, dataset: str, model: str, max_length: int, is_train: bool) -> str:
    """Where the features of a data set are kept: the options that shape them."""
    split = "train" if is_train else "dev"
    return "_".join([data_path.rstrip("/"), dataset, model.replace("/", "_"), str(max_length), split, "dataset.parquet"])


def cached_features(spark: SparkSession, path: str, build, overwrite: bool = False) -> DataFrame:
    """Features from ``path``, built first when they are not there. Only a finished
    write counts; a half-written folder is built again."""
    if overwrite or not _exists(spark, f"{path}/_SUCCESS"):
        write_features(build(), path)
    return spark.read.parquet(path)


def write_labelled(rows: DataFrame, labels: DataFrame, path: str, is_train: bool) -> None:
    """Encoded data as CSV, and with the training data its label map."""
    rows.select("text", "label").write.mode("overwrite").option("header", "true").option("escape", '"').csv(
        f"{path}_{'train' if is_train else 'valid'}.csv"
    )
    if is_train:
        labels.write.mode("overwrite").option("header", "true").csv(f"{path}_label2id.csv")


def write_results(results: DataFrame, path: str, step: int, part: int = 0) -> None:
    """Window logits ``unique_id, start_logits, end_logits`` of one evaluation step, in
    parts; writing a part again replaces it."""
    columns = results.select("unique_id", "start_logits", "end_logits")
    columns.write.mode("overwrite").parquet(f"{path}/step={step}/part={part}")


def read_results(spark: SparkSession, path: str, step: int) -> DataFrame:
    """All parts of one step, and of no other."""
    schema = "unique_id string, start_logits array<double>, end_logits array<double>"
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/step={step}")


def clear_results(spark: SparkSession, path: str, step: int) -> None:
    """Remove the logits of a step once it is evaluated."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/step={step}")
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_metrics(report: DataFrame, path: str, step: int) -> None:
    """``step, metric, value`` rows of an evaluation, one folder per step."""
    rows = report.select(F.lit(step).alias("step"), "metric", "value").sort("metric")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/step={step}")
