"""Text classifier per fold: train, cross-validate, evaluate, compare.

Features are character counts. One pass over the folded table counts characters per fold and class; what a fold trains on is the
total without its own part, so all folds and all smoothing values follow from that pass, and one more evaluates them all. The vocabulary is
limited by Unicode and not by the data, so counts, models and broadcasts stay small however large the table is. Models are
stored as Spark ML pipelines.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import CountVectorizerModel, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EVALUATION, FOLD_METRICS
from ..session import cut_lineage
from ..sources.files import publish_run, read_scoring_csv, write_metrics, write_results_csv
from .folds import check_foldable, stratified_kfold
from .labels import CLASS_NAMES, label_view, mark_correct
from .metrics import class_scores, cv_summary, overall
from .portions import portions
from .runs import compare_runs, merge_fold_metrics, read_fold_metrics, stack_runs

@dataclass
class FoldResult:
    """Trained model, its metrics, and the metrics of all candidates of one fold."""

    model: PipelineModel | None
    metrics: dict
    candidates: DataFrame


def tokenizer() -> SQLTransformer:
    return SQLTransformer(statement="SELECT *, split(text, '') AS _chars FROM __THIS__")


def predictions(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``pred`` (0..3) and, where a label exists, the row's cross-entropy ``loss``."""
    scored = model.transform(df).withColumn("_raw", vector_to_array("rawPrediction"))
    scored = scored.withColumn("pred", F.col("prediction").cast("int"))
    if "label" in df.columns:
        # log-sum-exp keeps long texts, whose class probabilities underflow, finite.
        top = F.array_max("_raw")
        total = top + F.log(F.aggregate("_raw", F.lit(0.0), lambda a, x: a + F.exp(x - top)))
        scored = scored.withColumn("loss", total - F.get(F.col("_raw"), F.col("label")))
    kept = [c for c in ("pred", "loss") if c in scored.columns]
    return scored.select(*df.columns, *kept)


@dataclass
class Characters:
    """Characters and texts of each (fold, label)."""

    counts: dict[tuple[int, int], Counter]
    texts: Counter

    def without(self, fold: int) -> tuple[dict[int, Counter], Counter]:
        """Per label, the characters and the number of texts of all other folds."""
        counts, texts = {}, Counter()
        for (f, label), n in self.texts.items():
            if f != fold:
                counts.setdefault(label, Counter()).update(self.counts.get((f, label), {}))
                texts[label] += n
        return counts, texts


def character_counts(folded: DataFrame) -> Characters:
    """One pass over ``text, label, fold``. Tasks send their sums, and the driver gets a row per fold, label and character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, Counter] = {}
        for batch in (part for whole in batches for part in portions(whole, "text")):
            for fold, label, text in zip(*[batch[c].to_pylist() for c in ("fold", "label", "text")], strict=True):
                own = found.setdefault((fold, label), Counter())
                own.update(text or "")
                own[""] += 1  # texts
        rows = [(*key, ch, n) for key, own in found.items() for ch, n in own.items()]
        arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["fold", "label", "ch", "n"])

    slim = folded.select(F.col("fold").cast("int").alias("fold"), F.col("label").cast("int").alias("label"), "text")
    sums = slim.mapInArrow(run, "fold int, label int, ch string, n long").groupBy("fold", "label", "ch").agg(F.sum("n").alias("n"))
    counts, texts = {}, Counter()
    for r in sums.toLocalIterator():
        if r["ch"]:
            counts.setdefault((r["fold"], r["label"]), Counter())[r["ch"]] = r["n"]
        else:
            texts[r["fold"], r["label"]] = r["n"]
    return Characters(counts, texts)


@dataclass
class Bayes:
    """Multinomial naive Bayes over characters: place of each character, and log probabilities by class."""

    places: dict[str, int]
    labels: list[int]
    prior: np.ndarray
    theta: np.ndarray

    @classmethod
    def of(cls, counts: dict[int, Counter], texts: Counter, smoothing: float) -> Bayes:
        labels = sorted(texts)
        places = {ch: i for i, ch in enumerate(sorted(set().union(*counts.values())))}
        seen = np.array([[counts[y].get(ch, 0) for ch in places] for y in labels], dtype=float).reshape(len(labels), len(places))
        n = np.array([texts[y] for y in labels], dtype=float)
        prior = np.log(n + smoothing) - np.log(n.sum() + len(labels) * smoothing)
        theta = np.log(seen + smoothing) - np.log(seen.sum(axis=1, keepdims=True) + len(places) * smoothing)
        return cls(places, labels, prior, theta)

    def raw(self, found: Counter) -> np.ndarray:
        known = [(self.places[ch], n) for ch, n in found.items() if ch in self.places]
        if not known:
            return self.prior
        at, n = zip(*known, strict=True)
        return self.prior + self.theta[:, list(at)] @ np.array(n, dtype=float)

    def judge(self, found: Counter, label: int) -> tuple[int, float]:
        """Class and cross-entropy; log-sum-exp keeps long texts, whose class probabilities underflow, finite."""
        raw = self.raw(found)
        top = raw.max()
        total = top + np.log(np.exp(raw - top).sum())
        own = raw[self.labels.index(label)] if label in self.labels else -np.inf
        return self.labels[int(raw.argmax())], float(total - own)


def pipeline(spark: SparkSession, counts: dict[int, Counter], texts: Counter, smoothing: float) -> PipelineModel:
    """The same model as a Spark ML pipeline: one weighted row for each class has the sums that its texts have."""
    vocabulary = sorted(set().union(*counts.values()))
    places = {ch: i for i, ch in enumerate(vocabulary)}
    rows = [
        (float(y), float(n), Vectors.sparse(len(vocabulary), {places[ch]: c / n for ch, c in counts[y].items()}))
        for y, n in sorted(texts.items())
    ]
    summed = spark.createDataFrame(rows, ["label", "weight", "features"])
    fitted = NaiveBayes(smoothing=smoothing, weightCol="weight").fit(summed)
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_chars", outputCol="features")
    return PipelineModel(stages=[tokenizer(), counter, fitted])


def measure_folds(folded: DataFrame, models: dict[tuple[int, int], Bayes]) -> dict[tuple[int, int], dict]:
    """Metrics of each ``(fold, step)`` on the rows of its fold: one pass for all of them, one count per cell leaves a task."""
    steps: dict[int, list[int]] = {}
    for fold, step in models:
        steps.setdefault(fold, []).append(step)
    sent = folded.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple, list] = {}
        for batch in (part for whole in batches for part in portions(whole, "text")):
            for fold, label, text in zip(*[batch[c].to_pylist() for c in ("fold", "label", "text")], strict=True):
                found = Counter(text or "")
                for step in steps[fold]:
                    pred, loss = sent.value[fold, step].judge(found, label)
                    cell = cells.setdefault((fold, step, label, pred), [0, 0.0])
                    cell[0] += 1
                    cell[1] += loss
        rows = [(*key, *cell) for key, cell in cells.items()]
        kinds = (*[pa.int32()] * 4, pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["fold", "step", "label", "pred", "n", "loss"]
        )

    slim = folded.where(F.col("fold").isin(*steps)).select(F.col("fold").cast("int").alias("fold"), F.col("label").cast("int").alias("label"), "text")
    found = slim.mapInArrow(run, "fold int, step int, label int, pred int, n long, loss double")
    cells = found.groupBy("fold", "step", "label", "pred").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss")).collect()
    out = {}
    for key in models:
        own = [r for r in cells if (r["fold"], r["step"]) == key]
        rows, hits = sum(r["n"] for r in own), sum(r["n"] for r in own if r["label"] == r["pred"])
        gold, pred, tp = Counter(), Counter(), Counter()
        for r in own:
            gold[r["label"]] += r["n"]
            pred[r["pred"]] += r["n"]
            tp[r["label"]] += r["n"] * (r["label"] == r["pred"])
        f1 = [2 * tp[y] / (gold[y] + pred[y]) for y in {*gold, *pred}]
        out[key] = {
            "eval_accuracy": hits / rows if rows else 0.0,
            "eval_macro_f1": sum(f1) / len(f1) if f1 else 0.0,
            "eval_loss": sum(r["loss"] for r in own) / rows if rows else 0.0,
        }
    return out


CANDIDATE = "step int, smoothing double, eval_accuracy double, eval_macro_f1 double, eval_loss double"


def train_folds(
    df: DataFrame,
    folds: tuple[int, ...],
    smoothing: tuple[float, ...] = (1.0,),
    model_dir: str | None = None,
    with_models: bool = True,
) -> dict[int, FoldResult]:
    """For each fold: train on all others, evaluate on it, keep the candidate with the best macro F1, and save it.

    Two passes over ``df`` serve all folds and candidates. Without ``with_models`` pipelines are only made to be saved.
    """
    spark = df.sparkSession
    counted = character_counts(df)
    parts = {f: counted.without(f) for f in folds}
    measured = measure_folds(df, {(f, s): Bayes.of(*parts[f], v) for f in folds for s, v in enumerate(smoothing)})
    out = {}
    for f in folds:
        rows = [(s, float(v), *measured[f, s].values()) for s, v in enumerate(smoothing)]
        best = max(rows, key=lambda r: (r[3], -r[0]))
        model = pipeline(spark, *parts[f], best[1]) if with_models or model_dir else None
        if model_dir:
            model.write().overwrite().save(f"{model_dir}/fold_{f}")
        names = ("eval_accuracy", "eval_macro_f1", "eval_loss")
        out[f] = FoldResult(model, {"fold": f, **dict(zip(names, best[2:], strict=True))}, spark.createDataFrame(rows, CANDIDATE))
    return out


def train_fold(
    df: DataFrame, fold: int, smoothing: tuple[float, ...] = (1.0,), model_dir: str | None = None
) -> FoldResult:
    """:func:`train_folds` for one fold."""
    return train_folds(df, (fold,), smoothing, model_dir)[fold]


def cross_validate(
    df: DataFrame,
    k: int = 5,
    id_col: str = "id",
    seed: int = 3407,
    folds: tuple[int, ...] | None = None,
    smoothing: tuple[float, ...] = (1.0,),
    model_dir: str | None = None,
    metrics_path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Fold metrics and their summary; all folds come from the same two passes.

    ``folds`` runs only some of them. With ``metrics_path`` the newest payload under that path is merged in, new folds
    replacing old ones, and the merged payload is stored as a new run folder beside it; runs that end at the same time merge one after the other.
    """
    return run_folds(folded_input(df, k, id_col, seed), k, folds, smoothing, model_dir, metrics_path)


def folded_input(df: DataFrame, k: int, id_col: str = "id", seed: int = 3407) -> DataFrame:
    """``id, text, label, fold``, checked and written once: every fit and evaluation reads this table."""
    check_foldable(df, "label", k)
    rows = df.select(F.col(id_col).alias("id"), "text", "label")
    return cut_lineage(stratified_kfold(rows, "label", "id", k, seed), "folded")


def run_folds(
    folded: DataFrame,
    k: int,
    folds: tuple[int, ...] | None = None,
    smoothing: tuple[float, ...] = (1.0,),
    model_dir: str | None = None,
    metrics_path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Train and evaluate the wanted folds of :func:`folded_input`; see :func:`cross_validate`."""
    wanted = range(k) if folds is None else folds
    rows = [r.metrics for r in train_folds(folded, tuple(wanted), smoothing, model_dir, False).values()] if wanted else []
    if not rows:
        raise ValueError("no fold was run")
    spark = folded.sparkSession
    new = spark.createDataFrame([tuple(r.values()) for r in rows], FOLD_METRICS)
    if not metrics_path:
        merged = merge_fold_metrics(spark.createDataFrame([], FOLD_METRICS), new)
        return merged, cv_summary(merged)
    rows = folded.count()
    payload = lambda before: metrics_payload(
        merge_fold_metrics(read_fold_metrics(spark, before) if before else spark.createDataFrame([], FOLD_METRICS), new), k, rows
    )
    stored = publish_run(spark, metrics_path, lambda before, at: write_metrics(payload(before), at))
    merged = merge_fold_metrics(read_fold_metrics(spark, stored), new)
    return merged, cv_summary(merged)


def metrics_payload(merged: DataFrame, n_splits: int, rows: int) -> DataFrame:
    """One row with the fold metrics, completed folds and summary, ready for :func:`write_metrics`."""
    entry = F.struct("fold", "eval_accuracy", "eval_macro_f1", "eval_loss")
    listed = merged.agg(F.array_sort(F.collect_list(entry)).alias("fold_metrics"))
    return listed.withColumn("_one", F.lit(1)).join(
        cv_summary(merged).withColumn("_one", F.lit(1)), "_one"
    ).drop("_one").withColumns({"n_splits": F.lit(n_splits), "rows": F.lit(rows)})


def evaluation_rows(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``id, text, gold_label_id, pred_label_id, is_correct`` with labels 1..4."""
    scored = predictions(model, df)
    rows = label_view(scored, "label").withColumn("gold_label_id", F.col("label_id"))
    rows = rows.withColumn("pred_label_id", F.col("pred") + 1)
    return mark_correct(rows, "pred_label_id", "gold_label_id").select(
        "id", "text", "gold_label_id", "pred_label_id", "is_correct"
    )


def evaluation_metrics(rows: DataFrame, gold: str = "gold_label_id", pred: str = "pred_label_id") -> DataFrame:
    """One row: accuracy, macro F1, labels, confusion matrix and classification report."""
    spark = rows.sparkSession
    labels = (1, 2, 3, 4)
    # At most 16 counts describe the whole table; every figure below comes from them.
    cells = rows.groupBy(F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count("*").alias("n")).collect()
    counts = {(r["g"], r["p"]): r["n"] for r in cells}
    counted = spark.createDataFrame([(g, p, n) for (g, p), n in counts.items()], "g int, p int, n long")
    total = overall(counted, "g", "p", weight="n")
    report = class_scores(counted, "g", "p", labels, weight="n").agg(
        F.array_sort(F.collect_list(F.struct("label", "precision", "recall", "f1", "support"))).alias(
            "classification_report"
        )
    )
    matrix = [[counts.get((g, p), 0) for p in labels] for g in labels]
    return (
        total.withColumn("_one", F.lit(1))
        .join(report.withColumn("_one", F.lit(1)), "_one")
        .drop("_one")
        .withColumns(
            {
                "labels": F.array(*[F.lit(n) for n in CLASS_NAMES]),
                "confusion_matrix": F.array(*[F.array(*[F.lit(n).cast("long") for n in row]) for row in matrix]),
            }
        )
    )


def evaluate(model: PipelineModel, df: DataFrame, results_path: str, report_path: str) -> DataFrame:
    """Evaluate a saved model on a table: rows to CSV, metrics to JSON; returns the metrics."""
    write_results_csv(evaluation_rows(model, df), results_path)
    metrics = evaluation_metrics(read_scoring_csv(df.sparkSession, results_path, EVALUATION))
    write_metrics(metrics, report_path)
    return metrics


def evaluate_outputs(model: PipelineModel, outputs: dict[str, DataFrame]) -> DataFrame:
    """Accuracy and macro F1 per run, for outputs of several generators with a target label each."""
    return compare_runs(predictions(model, stack_runs(outputs)), "label", "pred")


