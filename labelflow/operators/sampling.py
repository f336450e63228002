"""Holdout split, samples with exact sizes, and few-shot sets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranking import dense_position, pieces_by_rank, seeded_hash


def class_totals(df: DataFrame, label: str) -> DataFrame:
    """Rows of each class, counted map-side, with those of all classes and of the smallest one."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    fact = counts.agg(F.struct(F.sum("n").alias("total"), F.min("n").alias("smallest")).alias("f")).scalar()
    return counts.withColumns({"total": fact["total"], "smallest": fact["smallest"]})


def holdout_quotas(totals: DataFrame, label: str, test_share: float) -> DataFrame:
    """Train rows per class by largest remainder; equal remainders go to the lower label. Classes are never gathered."""
    fact = totals.agg(F.sum("n").alias("total")).first()
    total = fact["total"] or 0
    train = total - math.ceil(total * test_share)
    exact = F.col("n") * F.lit(train)
    shares = totals.withColumns({"base": F.floor(exact / F.lit(max(1, total))), "_lack": -(exact % F.lit(max(1, total)))})
    left = train - (shares.agg(F.sum("base")).first()[0] or 0)
    placed = dense_position(shares, ["_lack", label], "_place")
    return placed.select(label, (F.col("base") + (F.col("_place") < left).cast("long")).alias("rank"))


def _one_cut(df: DataFrame, rank: int) -> DataFrame:
    return df.sparkSession.createDataFrame([(0, int(rank))], "cut int, rank long")


def stratified_split(
    df: DataFrame, label: str, id_col: str, test_share: float = 0.2, seed: int = 42, out: str = "part"
) -> DataFrame:
    """Mark each row ``train`` or ``test``; test has ceil(share * rows), spread over classes by size.

    With a class of fewer than two rows the split is random over all rows instead.
    """
    totals = cut_lineage(df.groupBy(label).agg(F.count("*").alias("n")), "totals")
    fact = totals.agg(F.min("n").alias("smallest"), F.sum("n").alias("total")).first()
    if fact["total"] is None:
        return df.withColumn(out, F.lit("train"))
    if fact["smallest"] >= 2:
        quotas = holdout_quotas(totals, label, test_share).withColumn("cut", F.lit(0))
        marked = pieces_by_rank(df, [label], id_col, quotas, seed, "_piece")
    else:
        train = fact["total"] - math.ceil(fact["total"] * test_share)
        marked = pieces_by_rank(df, [], id_col, _one_cut(df, train), seed, "_piece")
    return marked.withColumn(out, F.when(F.col("_piece") == 0, "train").otherwise("test")).drop("_piece")


def _first_by_hash(df: DataFrame, id_col: str, n: int, seed: int | str) -> DataFrame:
    picked = pieces_by_rank(df, [], id_col, _one_cut(df, n), seed, "_piece")
    return picked.where(F.col("_piece") == 0).drop("_piece")


def sample_n(df: DataFrame, id_col: str, n: int, seed: int | str) -> DataFrame:
    """min(n, rows) rows without replacement. Works for any n: nothing is gathered in one place."""
    return _first_by_hash(df, id_col, n, seed)


def proportional_sample(df: DataFrame, label: str, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """About n rows, each class by its share (half-even rounding, at least one), never more than n.

    All rows when n covers them; plain random when a class has fewer than two rows; a second random cut
    when rounding gave more than n.
    """
    totals = cut_lineage(df.groupBy(label).agg(F.count("*").alias("n")), "totals")
    fact = totals.agg(F.sum("n").alias("total"), F.min("n").alias("smallest")).first()
    if fact["total"] is None or n >= fact["total"]:
        return df
    if fact["smallest"] < 2:
        return _first_by_hash(df, id_col, n, seed)
    share = F.greatest(F.lit(1), F.bround(F.lit(n) * F.col("n") / F.lit(fact["total"])).cast("long"))
    quotas = totals.select(label, share.alias("rank"), F.lit(0).alias("cut"))
    picked = pieces_by_rank(df, [label], id_col, quotas, seed, "_piece")
    picked = picked.where(F.col("_piece") == 0).drop("_piece")
    drawn = quotas.agg(F.sum("rank")).first()[0]
    return picked if drawn <= n else sample_n(picked, id_col, n, f"{seed}:recut")


def first_n_per_class(
    df: DataFrame, label: str, n: int, order: list[str], labels: tuple[int, ...] | None = (1, 2, 3, 4)
) -> DataFrame:
    """First n rows of each class in ``order``, with their rank; of rows with equal order keys, any.

    The rank filter is pushed below the shuffle as a per-task group limit, so a class sends at most n rows per task,
    whatever its size, and exactly n rows come out however many share a place.
    """
    df = df.drop("rn")  # of an earlier selection
    kept = df.where(F.col(label).isin(*labels)) if labels else df
    first = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    return kept.withColumn("rn", first).where(F.col("rn") <= n)


def few_shot_sets(
    df: DataFrame, label: str, id_col: str, per_class: tuple[int, ...] = (0, 1, 2, 3), seed: int = 42
) -> DataFrame:
    """Nested example sets named by size (4 classes x k): each set contains the smaller ones."""
    most = max(per_class)
    hashed = df.withColumn("_h", seeded_hash(id_col, seed))
    top = first_n_per_class(hashed, label, most, ["_h", id_col]).drop("_h")
    sizes = F.array(*[F.lit(k) for k in per_class])
    shots = F.explode(F.filter(sizes, lambda k: k >= F.col("rn")))
    return top.withColumn("_k", shots).withColumn("shots", F.col("_k") * 4).drop("_k")
