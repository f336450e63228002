"""Export of folds: clean records, check, fold, write k folders of JSON lines, and store the summary beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.classify import folded_input
from ..operators.folds import fold_summary
from ..operators.labels import sanitize
from ..sources.files import write_folds, write_metrics


def export_folds(
    records: DataFrame, path: str, k: int = 5, seed: int = 3407, id_col: str = "id", input_file: str | None = None
) -> DataFrame:
    """Write ``folds`` and ``summary`` under ``path`` and return the summary as stored.

    ``records`` may have any of the accepted text and label columns. Rejected rows stop the run, with the first of them in
    the message: an export has all rows or none. The summary names the input and the folders of each fold.
    """
    parts = sanitize(records, keep=(id_col,))
    bad = parts.rejects.limit(3).collect()
    if bad:
        raise ValueError(f"records without usable text or label: {[r.asDict() for r in bad]}")
    folded = folded_input(parts.clean, k, id_col, seed)
    folder = write_folds(folded, f"{path}/folds", k)
    place = lambda f, part: F.concat(F.lit(f"{folder}/fold="), f["fold"].cast("string"), F.lit(f"/part={part}"))
    named = F.transform(
        "folds", lambda f: f.withField("train_path", place(f, "train")).withField("test_path", place(f, "test"))
    )
    summary = fold_summary(folded, k, seed).withColumn("folds", named).withColumn("input_file", F.lit(input_file))
    stored = write_metrics(summary, f"{path}/summary")
    return records.sparkSession.read.schema(summary.schema).json(stored)
