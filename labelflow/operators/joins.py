"""Key look-ups that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 0.001  # a key with more than this share of all rows is split; there are at most 1000


def digest(col: str):
    """A fixed-width key for text, so that joins do not move the texts twice."""
    return F.sha2(F.col(col).cast("string").cast("binary"), 256)


def spread_lookup(
    rows: DataFrame,
    table: DataFrame,
    on: str,
    spread_by: list[str],
    how: str = "left",
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    """Join ``rows`` to ``table`` (unique on ``on``), salting the keys that are hot in ``rows``.

    Hot keys are found first by a frequent-items sketch: one pass, a few thousand counters per task, no
    shuffle of keys. At most ``1 / hot_share`` keys can be hot; each gets as many salts as it has multiples of
    that share, and only its row of ``table`` is copied. The sketch decides only where rows go, never which
    rows match. A row's salt is a hash of ``spread_by``, so a task that is run again picks the same one.
    """
    most = int(1 / hot_share)
    sketch = F.expr(f"approx_top_k(`{on}`, {most}, {most * 10})")
    found = rows.agg(F.count("*").alias("total"), sketch.alias("top")).first()
    threshold = max(1.0, found["total"] * hot_share)
    hot = [r for r in found["top"] or [] if r["count"] > threshold]
    if not hot:
        return rows.join(table, on, how)
    key_type = rows.schema[on].dataType.simpleString()
    salts = rows.sparkSession.createDataFrame(
        [(r["item"], int(r["count"] / threshold) + 1) for r in hot if r["item"] is not None],
        f"`{on}` {key_type}, _salts int",
    )
    # Null keys match nothing, so they may go anywhere.
    width = F.when(F.col(on).isNull(), F.lit(int(1 / hot_share))).otherwise(F.coalesce("_salts", F.lit(1)))
    salted = (
        rows.join(F.broadcast(salts), on, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*spread_by), width).cast("int"))
        .drop("_salts")
    )
    copies = (
        table.join(F.broadcast(salts), on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    return salted.join(copies, [on, "_salt"], how).drop("_salt")


def complement(df: DataFrame, test: DataFrame, on: str, spread_by: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` whose key is not in ``test``; keys of ``test`` need not be unique."""
    marks = test.select(on).where(F.col(on).isNotNull()).distinct().withColumn("_in_test", F.lit(True))
    columns = df.columns
    return (
        spread_lookup(df, marks, on, spread_by or columns, "left")
        .where(F.col("_in_test").isNull())
        .select(*columns)
    )
