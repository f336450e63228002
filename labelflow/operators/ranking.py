"""Seeded exact ranks and rank cut-offs that never put a whole class into one task.

Rows of a class are ordered by ``md5(seed:id), id``. The leading hex digits of the digest spread any
class, however large, evenly over ``16 ** digits`` buckets. Bucket sizes are counted with map-side
aggregation, their prefix sums are taken over that small table, and only the rows inside one bucket are
ever sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

DIGITS = 4  # hex digits of a bucket: 65,536 buckets, which leaves some 15 million rows in one of a class of 10 ** 12


def seeded_hash(id_col: str, seed: int | str) -> Column:
    """Digest of the seeded id. The coalesce marks it as never null, which spares joins on it a null check that
    would compute the digest again."""
    return F.coalesce(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary")), F.lit(""))


def _bucket(digits: int = DIGITS) -> Column:
    return F.substring("_h", 1, digits)


def same_keys(left: DataFrame, right: DataFrame, by: Sequence[str]) -> Column:
    """Equal classes, where rows without a class are a class of their own."""
    return reduce(Column.__and__, [left[k].eqNullSafe(right[f"_k{i}"]) for i, k in enumerate(by)], F.lit(True))


def _as_right(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(by)})


def bucket_offsets(keyed: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, _b, _n, _lo)``: rows of each (class, bucket), and rows of the class before it.

    Counts combine map-side. The window runs over at most ``16 ** digits`` rows per class.
    """
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return (
        keyed.groupBy(*by, "_b")
        .agg(F.count("*").alias("_n"))
        .withColumn("_lo", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    )


def stable_rank(
    df: DataFrame, by: list[str], id_col: str, seed: int | str = 0, out: str = "rank", digits: int = DIGITS
) -> DataFrame:
    """Exact 1-based rank of every row inside its class, in seeded hash order.

    The offset table is joined on the keys the window is already partitioned by, so it adds no shuffle of the data and
    needs no broadcast. Rows without a class are ranked among themselves.
    """
    keys = by or ["_all"]
    keyed = df.withColumn("_h", seeded_hash(id_col, seed)).withColumn("_b", _bucket(digits))
    keyed = keyed if by else keyed.withColumn("_all", F.lit(0))
    inside = Window.partitionBy(*keys, "_b").orderBy("_h", id_col)
    offsets = _as_right(bucket_offsets(keyed.select(*keys, "_b"), keys).drop("_n"), [*keys, "_b"])
    ranked = keyed.withColumn("_r", F.row_number().over(inside))
    return ranked.join(offsets, same_keys(ranked, offsets, [*keys, "_b"]), "left").select(
        *[ranked[c] for c in df.columns], (F.col("_lo") + F.col("_r")).alias(out)
    )


def rank_cutoffs(df: DataFrame, by: list[str], id_col: str, quotas: DataFrame, seed: int | str) -> DataFrame:
    """``(*by, cuts)``: per class the (hash, id) keys of the rows at its wanted ranks, as an array of ``(cut, h, id)``.

    ``quotas`` holds ``(*by, cut, rank)``. One narrow scan counts buckets; a second one sorts only the buckets that hold a wanted rank. Rank 0
    gives a key below all rows; a rank from the class size on gives one above all.
    """
    keyed = df.select(*by, F.col(id_col).alias("_id"), seeded_hash(id_col, seed).alias("_h")).withColumn("_b", _bucket())
    offsets = _as_right(bucket_offsets(keyed, by), by)
    inside = (F.col("rank") > F.col("_lo")) & (F.col("rank") <= F.col("_lo") + F.col("_n"))
    targets = quotas.join(offsets, same_keys(quotas, offsets, by) & inside, "left").select(
        *[quotas[k] for k in by], "cut", "rank", "_b", (F.col("rank") - F.col("_lo")).alias("_place")
    )
    # Written, so that the joins below see how large it really is: some rows per class.
    targets = cut_lineage(targets, "targets")
    places = targets.where("_b IS NOT NULL").groupBy(*by, "_b").agg(F.collect_list(F.struct("cut", "_place")).alias("_cuts"))
    places = _as_right(places, [*by, "_b"])
    at = Window.partitionBy(*by, "_b").orderBy("_h", "_id")
    found = (
        keyed.join(places, same_keys(keyed, places, [*by, "_b"]))
        .select(*[keyed[c] for c in keyed.columns], "_cuts")
        .withColumn("_r", F.row_number().over(at))
        .withColumn("_cut", F.explode("_cuts"))
        .where(F.col("_r") == F.col("_cut._place"))
        .select(*by, F.col("_cut.cut").alias("cut"), "_h", "_id")
    )
    id_type = df.schema[id_col].dataType
    beyond = targets.where("_b IS NULL").select(
        *by, "cut", F.when(F.col("rank") <= 0, "").otherwise("~").alias("_h"), F.lit(None).cast(id_type).alias("_id")
    )
    return found.unionByName(beyond).groupBy(*by).agg(F.collect_list(F.struct("cut", "_h", "_id")).alias("_cuts"))


def pieces_by_rank(
    df: DataFrame, by: list[str], id_col: str, quotas: DataFrame, seed: int | str, out: str = "piece"
) -> DataFrame:
    """Number of cut-offs that lie before each row: 0 up to the first wanted rank, then 1, and so on.

    ``quotas`` holds ``(*by, cut, rank)`` for every class. Each row compares its own hash with the cut-offs of its class. Those are
    a written table of one row per class: Spark broadcasts it where its size allows, and else joins by shuffle, with hot
    classes split. No row is lost either way, also without a class.
    """
    cutoffs = _as_right(cut_lineage(rank_cutoffs(df, by, id_col, quotas, seed), "cutoffs"), by)
    hashed = df.withColumn("_h", seeded_hash(id_col, seed))
    own, own_id = F.col("_h"), F.col(id_col)
    beyond = lambda c: (own > c["_h"]) | ((own == c["_h"]) & F.coalesce(own_id > c["_id"], F.lit(False)))
    passed = F.size(F.filter(F.col("_cuts"), beyond))
    # Without classes there is one row of cut-offs, read as a scalar.
    joined = hashed.join(cutoffs, same_keys(hashed, cutoffs, by)) if by else hashed.withColumn("_cuts", cutoffs.scalar())
    return joined.select(*[hashed[c] for c in df.columns], passed.alias(out))


def _tie(df: DataFrame, order: list[str]) -> Column:
    """A hash of the other columns, so that many rows with equal keys do not share one range."""
    simple = (T.AtomicType, T.ArrayType, T.StructType)
    others = [f.name for f in df.schema.fields if f.name not in order and isinstance(f.dataType, simple)]
    nested = [c for c in others if "map<" in (kind := df.schema[c].dataType.simpleString()) or "variant" in kind]
    return F.xxhash64(*[F.col(f"`{c}`") for c in others if c not in nested]) if set(others) - set(nested) else F.lit(0)


def lay_out(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """All rows in a total order: adds ``_part`` (range partition) and ``_row`` (0-based row inside it).

    Rows with equal or null keys are ordered by a hash of their other columns, so a hot key is split over ranges too;
    only rows that are equal throughout stay together, in any order. The sorted rows are written once, so everything that
    is derived from their places later reads the same files, and each row keeps its one place.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_tie", _tie(df, order))
    laid = cut_lineage(
        keyed.repartitionByRange(n, *order, "_tie")
        .sortWithinPartitions(*order, "_tie")
        .drop("_tie")
        .withColumn("_seq", F.monotonically_increasing_id()),
        "layout",
    )
    # The id holds the partition in its upper bits and the row in its lower 33 bits.
    return laid.withColumns(
        {"_part": F.shiftright("_seq", 33).cast("int"), "_row": F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1))}
    ).drop("_seq")


def totals_before(laid: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Per partition of :func:`lay_out`, each sum over all partitions before it (one row per partition)."""
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = laid.groupBy("_part").agg(*[c.alias(name) for name, c in sums.items()])
    return per_part.select("_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums])


def dense_position(df: DataFrame, order: list[str], out: str = "position") -> DataFrame:
    """0-based position in a total order, without a single-task sort; one for each row, also where keys repeat or are null."""
    laid = lay_out(df, order)
    offsets = totals_before(laid, {"_lo": F.count("*")})
    placed = laid.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_lo") + F.col("_row"))
    return placed.select(*[F.col(f"`{c}`") for c in df.columns if c != out], out)


def sums_before(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over all rows before each row, in a total order; no task sees all rows."""
    laid = lay_out(df, order)
    offsets = totals_before(laid, {"_lo": F.sum(value)})
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    summed = laid.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_lo") + F.col("_in")).alias(out))
