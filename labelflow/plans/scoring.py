"""A scoring run: hold out, build the shared prompt, score, keep valid rows, measure."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.inference import SCORER_RETRY, ModelSpec, RetryPolicy, score_table, templated
from ..operators.labels import to_scoring_input, valid_counts, valid_predictions
from ..operators.metrics import accuracy, classification_report, confusion
from ..operators.prompts import SCORING_SUFFIX, scoring_prefix
from ..operators.sampling import proportional_sample, stratified_split
from ..session import cut_lineage
from ..sources.files import report_lines, run_output, stamped_name, write_report, write_results_csv


@dataclass
class ScoringResult:
    """Stored scored rows and the metrics over their valid part."""

    path: str
    csv_path: str
    report_path: str
    scored: DataFrame
    counts: DataFrame
    accuracy: DataFrame
    matrix: DataFrame
    report: DataFrame


def scoring_run(
    dataset: DataFrame,
    model: ModelSpec,
    base: str,
    examples_n: int,
    results: DataFrame | None = None,
    version: int = 1,
    seed: int = 42,
    retry: RetryPolicy = SCORER_RETRY,
    parallelism: int | None = None,
    run_id: str | None = None,
    stem: str = "dataset",
) -> ScoringResult:
    """Score the holdout of ``dataset`` (``id, text, score``), or ``results`` of a generation run.

    A proportional sample of ``examples_n`` rows of the train part gives the examples of the prompt. The split and the
    scored rows are written first and all else reads those tables, so the source is read once and no model call
    is made twice. The scored rows are also stored as CSV, in a folder named after the input (``stem``) and the time, with the
    text report beside it.
    """
    split = cut_lineage(stratified_split(dataset.select("id", "text", "score"), "score", "id", 0.2, seed), "split")
    examples = split.where("part = 'train'").drop("part")
    examples = proportional_sample(examples, "score", "id", examples_n, seed)
    prefix = scoring_prefix(examples, ["id"], examples_n, version)
    rows = split.where("part = 'test'").drop("part") if results is None else to_scoring_input(results)
    # The shared part of the prompt goes to the workers once, the rows carry only their sentence.
    start = prefix.first()[0]
    shared = templated(model, start + SCORING_SUFFIX[0], SCORING_SUFFIX[1])
    scored = score_table(rows, shared, "text", retry=retry, parallelism=parallelism)
    path = run_output(scored, base, run_id, by=())
    stored = dataset.sparkSession.read.parquet(path)
    counts = valid_counts(stored)
    if counts.first()["valid"] == 0:
        raise ValueError("no valid predictions")
    valid = valid_predictions(stored)
    pair = ("score", "predicted_score")
    name = f"{base}/{stamped_name(stem)}-{path.rsplit('run_id=', 1)[1]}"
    result = ScoringResult(
        path,
        write_results_csv(stored.select("text", "score", "predicted_score"), f"{name}/rows"),
        f"{name}/report",
        stored,
        counts,
        accuracy(valid, *pair).withColumn("accuracy_percent", F.col("accuracy") * 100),
        confusion(valid, *pair, labels=(1, 2, 3, 4)),
        classification_report(valid, *pair, labels=(1, 2, 3, 4)),
    )
    settings = {"model": model.backend.__name__, "examples": str(examples_n), "scale": str(version)}
    write_scoring_report(result, settings, start, result.report_path)
    return result


def write_scoring_report(result: ScoringResult, settings: dict[str, str], prefix: str, path: str) -> str:
    """Text report of a run: settings, start of the shared prompt, accuracy, confusion matrix."""
    cells = {(r["gold"], r["pred"]): r["n"] for r in result.matrix.collect()}
    labels = sorted({g for g, _ in cells})
    matrix = [[cells.get((g, p), 0) for p in labels] for g in labels]
    percent = result.accuracy.first()["accuracy_percent"]
    return write_report(result.scored.sparkSession, report_lines(settings, prefix, percent, matrix), path)
