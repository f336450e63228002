"""Stratified folds: guards, assignment, views and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .labels import CLASS_NAMES
from .metrics import class_counts
from .ranking import pieces_by_rank, sums_before

CLASS_IDS = (0, 1, 2, 3)


def check_foldable(df: DataFrame, label: str, k: int, labels: tuple[int, ...] = CLASS_IDS) -> list[int]:
    """Raise unless k >= 2, there are k rows, and every class has k rows; return the class counts.

    Classes without rows count as 0. The counts are one row per listed label.
    """
    if k < 2:
        raise ValueError(f"k-fold needs k >= 2; got {k}")
    rows = class_counts(df, label, labels).orderBy(label).collect()
    counts = [r["n"] for r in rows]
    if sum(counts) < k:
        raise ValueError(f"k-fold with k={k} needs k rows or more; got {sum(counts)}")
    if min(counts) < k:
        raise ValueError(f"k={k} is too large for the smallest class; rows per class: {counts}")
    return counts


def fold_quotas(totals: DataFrame, label: str, k: int) -> DataFrame:
    """Cumulative rows of each class up to each fold but the last.

    Classes are laid end to end by first appearance (smallest id); place p of that line counts towards fold
    p modulo k, so sizes of a class differ by at most one between folds. ``totals`` is ``(label, n, first)``.
    """

    def members(f: int):
        """Places p of [offset, offset + n) with p mod k == f."""
        up_to = lambda end: F.floor((end - f + k - 1) / F.lit(k))
        return up_to(F.col("_off") + F.col("n")) - up_to(F.col("_off"))

    cuts, running = [], F.lit(0).cast("long")
    for f in range(k - 1):
        running = running + members(f)
        cuts.append(F.struct(F.lit(f).alias("cut"), running.cast("long").alias("rank")))
    return sums_before(totals, ["first"], "n", "_off").select(label, F.inline(F.array(*cuts)))


def stratified_kfold(
    df: DataFrame, label: str, id_col: str, k: int = 5, seed: int = 3407, out: str = "fold"
) -> DataFrame:
    """Give each row one fold 0..k-1, with the per-class fold sizes of the usual stratified k-fold.

    Within a class the seeded hash order is cut into k runs of exactly those sizes, so a row's fold follows
    from comparing its own hash with k-1 cut-offs; the rows themselves are not shuffled.
    """
    totals = df.groupBy(label).agg(F.count("*").alias("n"), F.min(id_col).alias("first"))
    return pieces_by_rank(df, [label], id_col, fold_quotas(totals, label, k), seed, out)


def fold_view(df: DataFrame, fold: int) -> DataFrame:
    """Rows marked as train or test of one fold."""
    return df.withColumn("part", F.when(F.col("fold") == fold, "test").otherwise("train"))


def train_part(df: DataFrame, fold: int) -> DataFrame:
    return df.where(F.col("fold") != fold)


def held_out(df: DataFrame, fold: int) -> DataFrame:
    return df.where(F.col("fold") == fold)


def _every_pair(df: DataFrame, k: int, labels: tuple[int, ...]) -> DataFrame:
    """Count rows per (fold, label), with zeros for pairs that do not occur."""
    pairs = [F.struct(F.lit(f).alias("fold"), F.lit(v).alias("label")) for f in range(k) for v in labels]
    zeros = df.sparkSession.range(1).select(F.inline(F.array(*pairs))).withColumn("n", F.lit(0).cast("long"))
    found = df.groupBy("fold", "label").agg(F.count("*").alias("n"))
    return zeros.unionByName(found).groupBy("fold", "label").agg(F.sum("n").alias("test_n"))


def split_sizes(df: DataFrame) -> DataFrame:
    """Train and test rows of every fold."""
    sizes = df.groupBy("fold").agg(F.count("*").alias("test_size"))
    everything = Window.partitionBy(F.lit(0))
    return sizes.withColumn("train_size", F.sum("test_size").over(everything) - F.col("test_size"))


def fold_classes(df: DataFrame, k: int, labels: tuple[int, ...] = CLASS_IDS) -> DataFrame:
    """Per fold and class: test and train rows, their share of the fold's test and train part."""
    cells = _every_pair(df, k, labels)
    by_label, by_fold, everything = (Window.partitionBy(c) for c in ("label", "fold", F.lit(0)))
    return (
        cells.withColumn("train_n", F.sum("test_n").over(by_label) - F.col("test_n"))
        .withColumn("test_size", F.sum("test_n").over(by_fold))
        .withColumn("train_size", F.sum("test_n").over(everything) - F.col("test_size"))
        .withColumn("test_ratio", F.coalesce(F.try_divide("test_n", "test_size"), F.lit(0.0)))
        .withColumn("train_ratio", F.coalesce(F.try_divide("train_n", "train_size"), F.lit(0.0)))
    )


def fold_summary(
    df: DataFrame, k: int, seed: int = 3407, labels: tuple[int, ...] = CLASS_IDS, names: tuple[str, ...] = CLASS_NAMES
) -> DataFrame:
    """One row: sizes, class counts, ratios per fold, population deviation of sizes and ratios."""
    by_fold = Window.partitionBy("fold")
    by_label = Window.partitionBy("label")
    key = (F.col("label") + 1).cast("string")
    entry = lambda value: F.struct(key.alias("k"), value.alias("v"))
    as_map = lambda entries: F.map_from_entries(F.array_sort(entries))
    cells = fold_classes(df, k, labels).select(
        "*",
        as_map(F.collect_list(entry(F.col("train_ratio"))).over(by_fold)).alias("_train"),
        as_map(F.collect_list(entry(F.col("test_ratio"))).over(by_fold)).alias("_test"),
        F.sum("test_n").over(by_label).alias("_n"),
        F.stddev_pop("train_ratio").over(by_label).alias("_train_std"),
        F.stddev_pop("test_ratio").over(by_label).alias("_test_std"),
    )
    # Every fold has one cell per class and every class one cell per fold, so deviations over cells equal
    # deviations over folds, and the summary needs the data only once.
    once_per_fold = F.when(
        F.col("label") == labels[0],
        F.struct(
            "fold", "train_size", "test_size", F.col("_train").alias("train_ratio"), F.col("_test").alias("test_ratio")
        ),
    )
    once_per_class = lambda c: as_map(F.collect_list(F.when(F.col("fold") == 0, entry(F.col(c)))))
    named = [F.lit(v) for i, n in enumerate(names) for v in (str(i + 1), n)]
    return cells.agg(
        F.sum("test_n").alias("n_rows"),
        F.lit(k).alias("n_splits"),
        F.lit(seed).alias("seed"),
        F.create_map(*named).alias("class_names"),
        once_per_class("_n").alias("class_counts"),
        F.array_sort(F.collect_list(once_per_fold), lambda a, b: a["fold"] - b["fold"]).alias("folds"),
        F.stddev_pop("train_size").alias("train_size_std"),
        F.stddev_pop("test_size").alias("test_size_std"),
        once_per_class("_train_std").alias("train_ratio_std"),
        once_per_class("_test_std").alias("test_ratio_std"),
    )
