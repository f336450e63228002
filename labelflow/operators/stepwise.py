"""A classifier that is trained in steps, each stored and measured, of which the best is kept.

Features are counts of character n-grams, hashed to ``slots`` places; the model is multinomial logistic regression, trained by gradient
steps with momentum over all rows. A step is one distributed pass: tasks sum the gradients of their rows, and one number for each class and
slot reaches the driver. Model size follows from the number of slots and not from the data. Weights are stored as they come, so a run that
was stopped goes on from its last stored step; one pass over the held-out rows then predicts with every stored step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.folders import numbered
from .folds import held_out, train_part
from .metrics import class_scores
from .portions import portions, row_portions
from .runs import best_run

SLOTS = 1 << 12
GRAMS = (1, 2, 3)
CLASSES = 4
FEATURES = "at array<int>, x array<double>"
PREDICTION = "step int, id {kind}, label int, pred int, loss double"


@dataclass
class StepResult:
    """Weights of the best step, its metrics, and those of all stored steps."""

    weights: np.ndarray
    metrics: dict
    candidates: DataFrame


def hashed_grams(text: str | None, slots: int = SLOTS, grams: tuple[int, ...] = GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the text's n-grams, rising, and their values: roots of counts, of length one together. The last slot is always there."""
    points = np.frombuffer((text or "").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    found = []
    for n in grams:
        if len(points) >= n:
            h = np.full(len(points) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                h = (h ^ points[k : len(points) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            found.append((h % np.uint64(slots)).astype(np.int64))
    at, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0))
    x = np.sqrt(count)
    norm = np.sqrt((x * x).sum())
    return np.append(at, slots), np.append(x / norm if norm else x, 1.0)


def with_features(df: DataFrame, slots: int = SLOTS, grams: tuple[int, ...] = GRAMS) -> DataFrame:
    """``id, label, fold, at, x``, written once: every step reads this table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, "text")):
            at, x = zip(*[hashed_grams(text.as_py(), slots, grams) for text in batch["text"]], strict=True)
            columns = [*[batch[c] for c in ("id", "label", "fold")], pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "fold", "at", "x"])

    slim = df.select("id", F.col("label").cast("int").alias("label"), F.col("fold").cast("int").alias("fold"), "text")
    kind = df.schema["id"].dataType.simpleString()
    return cut_lineage(slim.mapInArrow(run, f"id {kind}, label int, fold int, {FEATURES}"), "features")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and value of everything in a batch."""
    sizes = batch["at"].value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(sizes)), sizes), batch["at"].flatten().to_numpy(), batch["x"].flatten().to_numpy()


def _probabilities(weights: np.ndarray, row: np.ndarray, at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    scores = np.stack([np.bincount(row, weights=x * w[at], minlength=n) for w in weights], axis=1)
    scores -= scores.max(axis=1, keepdims=True)
    p = np.exp(scores)
    return p / p.sum(axis=1, keepdims=True)


def gradient(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, int]:
    """Sum of the rows' gradients, and their number, from one pass."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(sent.value), 0
        for batch in (part for whole in batches for part in row_portions(whole)):
            row, at, x = _flat(batch)
            label = batch["label"].to_numpy()
            off = _probabilities(sent.value, row, at, x, len(label))
            off[np.arange(len(label)), label] -= 1
            for c in range(len(total)):
                total[c] += np.bincount(at, weights=x * off[row, c], minlength=total.shape[1])
            n += len(label)
        cell = np.nonzero(total.ravel())[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(cell, -1), pa.int32()), pa.array(np.append(total.ravel()[cell], n), pa.float64())], names=["cell", "g"]
        )

    sums = rows.select("label", "at", "x").mapInArrow(run, "cell int, g double").groupBy("cell").agg(F.sum("g").alias("g")).collect()
    out, n = np.zeros(weights.size), 0
    for r in sums:  # one per class and slot at most
        if r["cell"] < 0:
            n = int(r["g"])
        else:
            out[r["cell"]] = r["g"]
    return out.reshape(weights.shape), n


def _store(spark: SparkSession, path: str, step: int, weights: np.ndarray, speed: np.ndarray) -> None:
    table = spark.createDataFrame([(weights.shape[0], weights.ravel().tolist(), speed.ravel().tolist())], "classes int, w array<double>, v array<double>")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/step={step}")


def load_step(spark: SparkSession, path: str, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and momentum of a stored step."""
    r = spark.read.schema("classes int, w array<double>, v array<double>").parquet(f"{path}/step={step}").first()
    return np.array(r["w"]).reshape(r["classes"], -1), np.array(r["v"]).reshape(r["classes"], -1)


def predict_steps(rows: DataFrame, weights: dict[int, np.ndarray]) -> DataFrame:
    """``step, id, label, pred, loss`` of every row for every step: one pass."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in row_portions(whole)):
            row, at, x = _flat(batch)
            label = batch["label"].to_numpy()
            for step, w in sent.value.items():
                p = _probabilities(w, row, at, x, len(label))
                own = np.maximum(p[np.arange(len(label)), label], np.finfo(float).tiny)
                arrays = [pa.array(np.full(len(label), step), pa.int32()), batch["id"], batch["label"]]
                arrays += [pa.array(p.argmax(axis=1), pa.int32()), pa.array(-np.log(own), pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["step", "id", "label", "pred", "loss"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "label", "at", "x").mapInArrow(run, PREDICTION.format(kind=kind))


def step_metrics(predicted: DataFrame) -> DataFrame:
    """``step, eval_accuracy, eval_macro_f1, eval_loss`` from stored predictions, macro F1 over present labels."""
    scores = class_scores(predicted, "label", "pred", by=("step",)).groupBy("step").agg(F.avg("f1").alias("eval_macro_f1"))
    plain = predicted.groupBy("step").agg(
        F.avg((F.col("label") == F.col("pred")).cast("double")).alias("eval_accuracy"), F.avg("loss").alias("eval_loss")
    )
    return plain.join(scores, "step").select("step", "eval_accuracy", "eval_macro_f1", "eval_loss")


def train_steps(
    df: DataFrame,
    fold: int,
    path: str,
    steps: int = 20,
    every: int = 5,
    rate: float = 2.0,
    momentum: float = 0.9,
    classes: int = CLASSES,
    slots: int = SLOTS,
    grams: tuple[int, ...] = GRAMS,
) -> StepResult:
    """Train on all other folds of ``id, text, label, fold``, measure each stored step on this one, and keep the best.

    Weights of every ``every``-th step lie under ``path/weights``, and the predictions of all stored steps under ``path/predictions``. Steps that
    are already there are not trained again. Labels run from 0 to ``classes - 1``. Equal scores go to the lower step.
    """
    spark = df.sparkSession
    features = with_features(df, slots, grams)
    train, test = train_part(features, fold), held_out(features, fold)
    at = f"{path}/weights"
    stored = [n for n in numbered(spark, at, "step") if n <= steps]
    done = max(stored, default=0)
    weights, speed = load_step(spark, at, done) if done else (np.zeros((classes, slots + 1)), np.zeros((classes, slots + 1)))
    for step in range(done + 1, steps + 1):
        g, n = gradient(train, weights)
        speed = momentum * speed - rate * g / max(1, n)
        weights = weights + speed
        if step % every == 0 or step == steps:
            _store(spark, at, step, weights, speed)
    known = {n: load_step(spark, at, n)[0] for n in numbered(spark, at, "step") if n <= steps}
    predict_steps(test, known).write.mode("overwrite").parquet(f"{path}/predictions")
    candidates = cut_lineage(step_metrics(spark.read.parquet(f"{path}/predictions")), "steps")
    best = best_run(candidates).first()
    return StepResult(known[best["step"]], {"fold": fold, **best.asDict()}, candidates)
