"""A cross-validation run: merge data sets, clean, guard, fold, train each fold, merge metrics, summarise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.classify import folded_input, run_folds
from ..operators.folds import split_sizes
from ..operators.labels import sanitize
from ..sources.files import concat_datasets


@dataclass
class CrossValidation:
    """What was dropped, the split sizes, and, unless only the split was asked for, metrics and summary."""

    dropped: dict
    sizes: DataFrame
    metrics: DataFrame | None = None
    summary: DataFrame | None = None


def cross_validation_run(
    train: DataFrame,
    extra: DataFrame | None = None,
    id_col: str = "id",
    k: int = 5,
    seed: int = 3407,
    folds: tuple[int, ...] | None = None,
    split_only: bool = False,
    smoothing: tuple[float, ...] = (1.0,),
    model_dir: str | None = None,
    metrics_path: str | None = None,
) -> CrossValidation:
    """Records of both data sets are cleaned together; their ids are prefixed so that they stay unique."""
    named = {"train": train, **({"extra": extra} if extra is not None else {})}
    tagged = [
        df.withColumn("_id", F.concat(F.lit(f"{name}:"), F.col(id_col).cast("string"))) for name, df in named.items()
    ]
    parts = sanitize(concat_datasets(*tagged), keep=("_id",))
    dropped = parts.report()
    rows = parts.clean.withColumnRenamed("_id", "id")
    folded = folded_input(rows, k, "id", seed)
    sizes = split_sizes(folded)
    if split_only:
        return CrossValidation(dropped, sizes)
    return CrossValidation(dropped, sizes, *run_folds(folded, k, folds, smoothing, model_dir, metrics_path))
