"""Column expressions and small helpers that the operators of this folder share."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores in front until no column of ``df`` has it (in any letter case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def named(df: DataFrame, name: str) -> Column:
    """The column of that exact name, dots and all."""
    return df[f"`{name}`"]


def whole_text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def word_array(c: Column) -> Column:
    """The words of a text, in order: longest runs of characters that are not ASCII white space."""
    return F.regexp_extract_all(c, F.lit(f"({WORD})"), F.lit(1))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all other characters unchanged (``lower`` would change letters of other alphabets)."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


RUN = 64


def running(values: Column, step: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Running sums (or another fold from zero) of an array of ints, without looking at an element's whole past.

    A fold that grows one array copies it for each element. Here runs of ``RUN`` elements are folded on their own lists, and
    just those lists are strung together: a few million copies for a hundred thousand elements.
    """
    none = F.array().cast("array<int>")

    def inside(state: Column, x: Column) -> Column:
        return let(step(state["at"], x), lambda at: F.struct(at.alias("at"), F.concat(state["out"], F.array(at)).alias("out")))

    def whole(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.shiftright(F.size(v) - 1, 6))
        runs = F.transform(starts, lambda i: F.slice(v, i * RUN + 1, RUN))

        def across(state: Column, some: Column) -> Column:
            done = F.aggregate(some, F.struct(state["at"].alias("at"), none.alias("out")), inside)
            return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(state["out"], F.array(d["out"])).alias("out")))

        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
        return F.flatten(F.aggregate(runs, first, across)["out"])

    return let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(none))


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on computed columns as they are.

    Predicate pushdown would copy their expressions into the filter once per use, and so into each other's lambdas, where they
    would run once per array element. It does not go through a projection with a row number.
    """
    (tick,) = fresh(df, "_tick")
    numbered = df.withColumn(tick, F.monotonically_increasing_id())
    return numbered.where(condition & (F.col(tick) >= 0)).drop(tick)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def documents(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def pages(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/pages.parquet")
