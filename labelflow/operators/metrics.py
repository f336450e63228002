"""Counts, accuracy, confusion matrices, reports and comparisons.

Everything is derived from one map-side aggregated count per (gold, pred) pair, so the data is read once
and only label-sized tables move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import lay_out, totals_before

def _zeros(df: DataFrame, label: str, labels: tuple, count: str) -> DataFrame:
    listed = F.array(*[F.lit(v) for v in labels]).cast(f"array<{df.schema[label].dataType.simpleString()}>")
    return df.sparkSession.range(1).select(F.explode(listed).alias(label), F.lit(0).cast("long").alias(count))


def class_counts(df: DataFrame, label: str, labels: tuple | None = None) -> DataFrame:
    """Rows per class; with ``labels`` exactly those classes, zero where none occurs."""
    found = df.groupBy(label).agg(F.count("*").alias("n"))
    if labels is None:
        return found
    filled = found.unionByName(_zeros(df, label, labels, "n")).where(F.col(label).isin(*labels))
    return filled.groupBy(label).agg(F.sum("n").alias("n"))


def min_class_count(df: DataFrame, label: str) -> DataFrame:
    return class_counts(df, label).agg(F.min("n").alias("min_n"), F.count("*").alias("classes"))


def _hit(gold: str, pred: str) -> Column:
    return F.coalesce((F.col(gold) == F.col(pred)).cast("double"), F.lit(0.0))


def accuracy(df: DataFrame, gold: str, pred: str, base: str = "all") -> DataFrame:
    """Share of right rows. ``base="valid"`` leaves out failed predictions (not above 0)."""
    if base not in ("all", "valid"):
        raise ValueError(f"base must be 'all' or 'valid', not {base!r}")
    used = df.where(F.col(pred) > 0) if base == "valid" else df
    return used.agg(
        F.count("*").alias("rows"),
        F.sum(_hit(gold, pred)).cast("long").alias("correct"),
        F.avg(_hit(gold, pred)).alias("accuracy"),
    )


def accuracy_by(df: DataFrame, correct: str, sets: list[list[str]]) -> DataFrame:
    """Percent right per grouping set, in one pass over the data."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    percent = F.avg(F.coalesce(F.col(correct), F.lit(False)).cast("double")) * 100
    return grouped.agg(
        F.grouping_id().alias("grouping"), F.count("*").alias("rows"), percent.alias("accuracy_percent")
    )


def confusion_cells(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Rows per (gold, pred) pair that occurs."""
    return df.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion(df: DataFrame, gold: str, pred: str, labels: tuple) -> DataFrame:
    """Matrix in long form: every pair of the given labels, with 0 where it does not occur, and all other pairs seen.

    Without a list of labels :func:`confusion_cells` has all there is to know.
    """
    cells = confusion_cells(df, gold, pred)
    zeros = _zeros(cells, "gold", labels, "n")
    listed = F.array(*[F.lit(v) for v in labels]).cast(f"array<{cells.schema['pred'].dataType.simpleString()}>")
    grid = zeros.select("gold", F.explode(listed).alias("pred"), "n")
    return grid.unionByName(cells).groupBy("gold", "pred").agg(F.sum("n").alias("n"))


def confusion_fixed(
    df: DataFrame, gold: str, pred: str, labels: tuple, extra: str | None = None
) -> DataFrame:
    """Matrix over fixed labels, one row per gold label; ``extra`` names a column for unparsed replies.

    Gold labels outside the list are skipped, as are predictions without a column.
    """
    columns = [*labels, *([extra] if extra is not None else [])]
    counts = [F.coalesce(F.sum(F.when(F.col("pred") == c, F.col("n"))), F.lit(0)).alias(f"pred_{c}") for c in columns]
    cells = confusion_cells(df, gold, pred)
    rows = _zeros(cells, "gold", labels, "n").withColumn("pred", F.lit(None).cast(cells.schema["pred"].dataType))
    return cells.where(F.col("gold").isin(*labels)).unionByName(rows).groupBy("gold").agg(*counts)


def class_scores(
    df: DataFrame,
    gold: str,
    pred: str,
    labels: tuple | None = None,
    by: tuple[str, ...] = (),
    weight: str | None = None,
) -> DataFrame:
    """Per label: true positives, support, predicted rows, precision, recall, F1 (0 on division by zero).

    ``labels`` fixes the list of labels; without it the labels present in gold or prediction are used.
    ``weight`` names a row count, for input that is already counted.
    """
    rows = F.sum(weight) if weight else F.count("*")
    cells = df.groupBy(*by, F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(rows.alias("n"))
    hit = F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(F.lit(0).cast("long"))
    none = F.lit(0).cast("long")
    as_gold = F.struct(
        F.col("gold").alias("label"), hit.alias("tp"), F.col("n").alias("support"), none.alias("predicted")
    )
    as_pred = F.struct(
        F.col("pred").alias("label"), none.alias("tp"), none.alias("support"), F.col("n").alias("predicted")
    )
    sides = cells.select(*by, F.inline(F.array(as_gold, as_pred)))
    if labels is not None:
        if by:
            raise ValueError("fixed labels and groups cannot be combined")
        zeros = _zeros(sides, "label", labels, "tp").select("label", "tp", "tp", "tp")
        sides = sides.where(F.col("label").isin(*labels)).union(zeros)
    sums = sides.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("predicted")),
            "recall": ratio(F.col("tp"), F.col("support")),
            "f1": ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")),
        }
    )


def classification_report(df: DataFrame, gold: str, pred: str, labels: tuple) -> DataFrame:
    """Rows per class, then accuracy, macro average and weighted average, over fixed labels."""
    scores = class_scores(df, gold, pred, labels)
    names = ("precision", "recall", "f1")
    row = lambda name, values, support: F.struct(
        F.lit(name).alias("label") if isinstance(name, str) else name.alias("label"),
        *[v.alias(n) for n, v in zip(names, values, strict=True)],
        support.alias("support"),
    )
    weighted = lambda c: F.coalesce(
        F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0)
    )
    # All labels fit one row, so the summary lines are added without a second pass over the data.
    summary = scores.agg(
        F.collect_list(row(F.col("label").cast("string"), [F.col(n) for n in names], F.col("support"))).alias("rows"),
        F.coalesce(F.try_divide(F.sum("tp"), F.sum("support")), F.lit(0.0)).alias("acc"),
        F.sum("support").alias("total"),
        *[F.avg(n).alias(f"macro_{n}") for n in names],
        *[weighted(n).alias(f"weighted_{n}") for n in names],
    )
    extra = F.array(
        row("accuracy", [F.col("acc")] * 3, F.col("total")),
        row("macro avg", [F.col(f"macro_{n}") for n in names], F.col("total")),
        row("weighted avg", [F.col(f"weighted_{n}") for n in names], F.col("total")),
    )
    return summary.select(F.inline(F.concat("rows", extra)))


def macro_f1(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Mean F1 over the labels present as gold or prediction (not over a fixed list)."""
    return class_scores(df, gold, pred, None).agg(F.count("*").alias("labels"), F.avg("f1").alias("macro_f1"))


def overall(df: DataFrame, gold: str, pred: str, weight: str | None = None) -> DataFrame:
    """Rows, accuracy and macro F1 in one pass."""
    scores = class_scores(df, gold, pred, weight=weight)
    return scores.agg(
        F.sum("support").alias("rows"),
        F.coalesce(F.try_divide(F.sum("tp"), F.sum("support")), F.lit(0.0)).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
    )


def cv_summary(folds: DataFrame) -> DataFrame:
    """Recorded folds, mean and population deviation of accuracy, macro F1 and loss."""
    measures = ("eval_accuracy", "eval_macro_f1", "eval_loss")
    return folds.agg(
        F.count("*").alias("n_folds_recorded"),
        F.sort_array(F.collect_list("fold")).alias("completed_folds"),
        *[F.avg(m).alias(f"mean_{m}") for m in measures],
        *[F.stddev_pop(m).alias(f"std_{m}") for m in measures],
    )


def running_accuracy(df: DataFrame, gold: str, pred: str, order: list[str], rows: int = 0, correct: int = 0) -> DataFrame:
    """Rows, right rows and accuracy up to and including each row, in a total order, after ``rows`` earlier ones.

    Rows are range-partitioned by ``order`` (see :func:`lay_out`, also for repeated and null keys); each partition carries the sums of the
    partitions before it, and the running sum is a window inside the partition.
    """
    laid = lay_out(df.withColumn("_hit", _hit(gold, pred).cast("long")), order)
    before = totals_before(laid, {"_rows": F.count("*"), "_hits": F.sum("_hit")})
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    new = {"rows_so_far": F.col("_rows") + F.col("_row") + 1 + rows, "correct_so_far": F.col("_hits") + F.col("_in") + correct}
    summed = laid.withColumn("_in", F.sum("_hit").over(inside)).join(F.broadcast(before), "_part").withColumns(new)
    summed = summed.withColumn("running_accuracy", F.col("correct_so_far") / F.col("rows_so_far"))
    return summed.select(*[F.col(f"`{c}`") for c in df.columns], *new, "running_accuracy")


def comparison(df: DataFrame, series: str, column: str, values: list, correct: str) -> DataFrame:
    """Accuracy in percent with one row per series and one column per value."""
    percent = F.avg(F.col(correct).cast("double")) * 100
    return df.groupBy(series).pivot(column, values).agg(percent)
