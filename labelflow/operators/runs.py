"""Fold metrics across runs: upsert, comparison, best candidate."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import FOLD_METRICS
from .metrics import class_scores


def _whole_folds(df: DataFrame) -> DataFrame:
    """Rows whose fold is an integer value; text and fractions do not name a fold."""
    kind = df.schema["fold"].dataType
    if isinstance(kind, T.IntegralType):
        kept = df.where(F.col("fold").isNotNull())
    elif isinstance(kind, T.VariantType):
        kept = df.where(F.schema_of_variant("fold") == "BIGINT")
        kept = kept.withColumn("fold", F.try_variant_get("fold", "$", "int"))
    else:
        kept = df.where(F.lit(False))
    measures = ("eval_accuracy", "eval_macro_f1", "eval_loss")
    return kept.select(F.col("fold").cast("int").alias("fold"), *measures)


def merge_fold_metrics(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new fold metrics; a new entry replaces the old one of its fold."""
    both = _whole_folds(old).withColumn("_p", F.lit(0)).unionByName(_whole_folds(new).withColumn("_p", F.lit(1)))
    entry = F.struct("eval_accuracy", "eval_macro_f1", "eval_loss")
    return both.groupBy("fold").agg(F.max_by(entry, "_p").alias("m")).select("fold", "m.*").orderBy("fold")


def read_fold_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Fold metrics stored as a JSON payload; an unreadable payload counts as empty and only warns."""
    layout = "fold_metrics array<struct<fold:variant,eval_accuracy:double,eval_macro_f1:double,eval_loss:double>>"
    try:
        payload = spark.read.schema(layout).option("multiLine", True).json(path)
    except AnalysisException:  # nothing stored yet
        return spark.createDataFrame([], FOLD_METRICS)
    if not payload.where("fold_metrics IS NULL").isEmpty():
        warnings.warn(f"fold metrics at {path} could not be read", stacklevel=2)
    return payload.select(F.inline("fold_metrics"))


def stack_runs(runs: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn("run", F.lit(name)) for name, df in runs.items()])


def compare_runs(stacked: DataFrame, gold: str, pred: str, run: str = "run") -> DataFrame:
    """Rows, accuracy and macro F1 (over present labels) of each run."""
    return class_scores(stacked, gold, pred, by=(run,)).groupBy(run).agg(
        F.sum("support").alias("rows"),
        F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
    )


def best_run(metrics: DataFrame, score: str = "eval_macro_f1", step: str = "step") -> DataFrame:
    """The row with the highest score; equal scores go to the lower step."""
    row = F.struct(*metrics.columns)
    return metrics.agg(F.max_by(row, F.struct(F.col(score), -F.col(step))).alias("b")).select("b.*")
