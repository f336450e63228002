"""Rewrite tasks, the experiment grid, row ids, and scoring each distinct text once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import digest, spread_lookup
from .ranking import dense_position

LEVELS = (1, 2, 3, 4)


def expand_targets(df: DataFrame, levels: tuple[int, ...] = LEVELS, score: str = "score") -> DataFrame:
    """One row per sentence and level other than its own. The levels are literals, so no join is needed."""
    listed = F.array(*[F.lit(v) for v in levels])
    own = F.col(score)
    return df.withColumn("target", F.explode(F.filter(listed, lambda v: v != own)))


def experiment_grid(df: DataFrame, models: list[str], prompt_types: dict[str, bool]) -> DataFrame:
    """Each task for each model and prompt type; ``prompt_types`` says which ones use examples."""
    kinds = [
        F.struct(F.lit(m).alias("model"), F.lit(p).alias("prompt_type"), F.lit(d).alias("use_data"))
        for m in models
        for p, d in prompt_types.items()
    ]
    return df.select("*", F.inline(F.array(*kinds)))


def assign_ids(df: DataFrame, order: list[str], fmt: str = "S%03d", out: str = "id") -> DataFrame:
    """Formatted ids by position in ``order``, starting at 1; rows with equal keys get different ids."""
    placed = dense_position(df, order, "_pos")
    return placed.withColumn(out, F.format_string(fmt, F.col("_pos") + 1)).drop("_pos")


def default_ids(df: DataFrame, order: list[str], out: str = "id") -> DataFrame:
    """Keep ids that are there; rows without one get their position in ``order``, from 1, in the type of the column."""
    placed = dense_position(df, order, "_pos").withColumn("_pos", F.col("_pos") + 1)
    if out in df.columns:
        return placed.withColumn(out, F.coalesce(F.col(out), F.col("_pos").cast(df.schema[out].dataType))).drop("_pos")
    return placed.withColumnRenamed("_pos", out)


def score_distinct(
    df: DataFrame,
    col: str,
    scorer: Callable[[DataFrame], DataFrame],
    spread_by: list[str],
    out: str = "original_score",
) -> DataFrame:
    """Score each distinct text once and attach the result to every row that has it.

    ``scorer`` takes a table with the text column and adds ``predicted_score``. Copies of a text are
    merged before anything is shuffled, the join goes by digest, and texts with very many copies are salted.
    """
    keyed = df.withColumn("_key", digest(col))
    texts = keyed.select("_key", col).distinct()
    scored = scorer(texts).select("_key", F.col("predicted_score").alias(out))
    return spread_lookup(keyed, scored, "_key", spread_by).drop("_key")
