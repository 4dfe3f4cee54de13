"""Tasks, data sets and evaluations by name, and the jobs that join them up."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import labels as lab
from textloom.operators import metrics, qa_features, qa_predict, qa_scores
from textloom.operators.batching import CLS_COLUMNS, QA_COLUMNS
from textloom.operators.vocabulary import Vocabulary
from textloom.sources import labelled, qa, sinks

CLS_READERS: dict[str, Callable] = {
    "fake_news": labelled.read_fake_news,
    "aihub_sentiment": labelled.read_dialogue_emotion,
    "modu_sentiment": labelled.read_document_sentiment,
    "nsmc": labelled.read_reviews,
}
QA_READERS: dict[str, Callable] = {
    "korquad_1": qa.read_squad,
    "korquad_2": qa.read_html_qa,
    "tydiqa": qa.read_byte_qa,
    "kluemrc": qa.read_mrc,
}


@dataclass(frozen=True)
class FineTuneConfig:
    task: str
    dataset: str
    model_name: str = "model"
    max_seq_length: int = 512
    doc_stride: int = 384
    max_query_length: int = 64
    all_questions: bool = False
    seed: int = 42
    predict: qa_predict.PredictConfig = field(default_factory=qa_predict.PredictConfig)

    @property
    def windows(self) -> qa_features.WindowConfig:
        return qa_features.WindowConfig(self.max_seq_length, self.doc_stride, self.max_query_length)


def classification_rows(
    spark: SparkSession, config: FineTuneConfig, path: str, is_train: bool, labels: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Encoded rows and the label map. Validation reuses the map of the training
    side; a label it does not hold is an error."""
    if labels is None and not is_train:
        raise ValueError("validation data needs the label map of the training data")
    rows = CLS_READERS[config.dataset](spark, path, is_train, seed=config.seed)
    labels = labels if labels is not None else lab.label_map(rows)
    return lab.encode_labels(rows, labels), labels


def _cls_features(spark, config, path, vocab, is_train, labels) -> DataFrame:
    rows, _ = classification_rows(spark, config, path, is_train, labels)
    label = F.col("label").cast("bigint")
    return lab.classification_features(rows, vocab, config.max_seq_length, F.col("text"), label, ["row_id"])


def _qa_features(spark, config, path, vocab, is_train, labels) -> DataFrame:
    paragraphs = QA_READERS[config.dataset](spark, path, is_train, all_questions=config.all_questions)
    build = qa_features.train_features if is_train else qa_features.eval_features
    return build(paragraphs, vocab, config.windows, [])


@dataclass(frozen=True)
class Task:
    readers: dict[str, Callable]
    features: Callable
    batch_columns: dict[str, str]


TASKS = {
    "cls": Task(CLS_READERS, _cls_features, CLS_COLUMNS),
    "qa": Task(QA_READERS, _qa_features, QA_COLUMNS),
}


def task_of(config: FineTuneConfig) -> Task:
    task = TASKS.get(config.task)
    if task is None:
        raise ValueError(f"unknown task {config.task}")
    if config.dataset not in task.readers:
        raise ValueError(f"unknown data set {config.dataset} for task {config.task}")
    return task


def build_features(
    spark: SparkSession,
    config: FineTuneConfig,
    path: str,
    vocab: Vocabulary,
    is_train: bool,
    labels: DataFrame | None = None,
    overwrite: bool = False,
) -> DataFrame:
    """Features of a data set, from the cache when it is complete."""
    task = task_of(config)
    target = sinks.feature_path(path, config.dataset, config.model_name, config.max_seq_length, is_train)
    return sinks.cached_features(
        spark, target, lambda: task.features(spark, config, path, vocab, is_train, labels), overwrite
    )


def evaluate_cls(results: DataFrame) -> DataFrame:
    """``(metric, value)`` from ``prediction, label`` rows."""
    return metrics.classification_report(results)


def evaluate_qa(
    features: DataFrame, results: DataFrame, examples: DataFrame, vocab: Vocabulary, config: FineTuneConfig
) -> DataFrame:
    """``(metric, value)`` from window logits."""
    predictions = qa_predict.predict(features, results, vocab, config.predict)
    return qa_scores.question_report(examples, predictions, config.predict.version_2_with_negative)


EVALUATIONS = {"cls": evaluate_cls, "qa": evaluate_qa}
