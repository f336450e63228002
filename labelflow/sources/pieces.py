"""Files whose records do not end with their lines, read by several tasks each: JSON arrays, and CSV with quoted line breaks.

A file is read in pieces that end at every ``}`` or line break, which Spark can split anywhere. Whether a piece starts inside a quoted text, and how
deep in objects and lists, follows from sums over all pieces before it: running sums inside a block of the file, and
sums of whole blocks, of which there is one row each. Since what a block adds to the depth depends on how it starts, both cases
are summed. In JSON, pieces that are whole records go on as they are, and only records in several pieces are put together by a shuffle; in CSV,
where no depth is needed, each task puts the records of its blocks together, and only records that reach over blocks are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.portions import portions
from ..session import cut_lineage

BLOCK = ["_file", "_block"]


def read_pieces(spark: SparkSession, path: str | list[str], end: str) -> DataFrame:
    """``value`` without its ``end``, and its place: a task reads a block from start to end, so its row number orders the block."""
    pieces = spark.read.option("lineSep", end).text(path)
    return pieces.select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _earlier(by: list[str], order: str):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _sum(c: Column | str, over) -> Column:
    return F.coalesce(F.sum(c).over(over), F.lit(0))


def _placed(pieces: DataFrame, odd: Column, outside: Column, inside: Column) -> DataFrame:
    """Adds ``quoted`` (starts inside a quoted text), ``depth`` (at the start) and ``own`` (what the piece adds to it).

    ``odd`` is 1 where a piece holds an odd number of quotes; ``outside`` and ``inside`` are what it adds if it starts so.
    """
    in_block = _earlier(BLOCK, "_line")
    rel = pieces.withColumns({"_odd": odd, "_out": outside, "_in": inside}).withColumn("_rel", _sum("_odd", in_block) % 2)
    rel = rel.withColumns(
        {
            "_from_out": F.when(F.col("_rel") == 0, F.col("_out")).otherwise(F.col("_in")),
            "_from_in": F.when(F.col("_rel") == 0, F.col("_in")).otherwise(F.col("_out")),
        }
    )
    blocks = rel.groupBy(*BLOCK).agg(*[F.sum(c).alias(c) for c in ("_odd", "_from_out", "_from_in")])
    before = _earlier(["_file"], "_block")
    blocks = blocks.withColumn("_starts_in", _sum("_odd", before) % 2)
    blocks = blocks.withColumn("_adds", F.when(F.col("_starts_in") == 0, F.col("_from_out")).otherwise(F.col("_from_in")))
    blocks = blocks.select(*BLOCK, "_starts_in", _sum("_adds", before).alias("_depth"))
    own = F.when(F.col("_starts_in") == 0, F.col("_from_out")).otherwise(F.col("_from_in"))
    whole = rel.join(blocks, BLOCK).withColumn("own", own)
    return whole.select(
        *pieces.columns,
        ((F.col("_rel") + F.col("_starts_in")) % 2 == 1).alias("quoted"),
        (F.col("_depth") + _sum("own", in_block)).alias("depth"),
        "own",
    )


def _records(placed: DataFrame, glue: str) -> DataFrame:
    """``(record, first)`` from pieces with ``starts`` and ``alone``: ``first`` tells a file's first record."""
    laid = cut_lineage(placed, "pieces")
    upto = Window.partitionBy(*BLOCK).orderBy("_line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.struct("_block", "_line")
    # A record that goes on in a block belongs to the last start of the blocks before it.
    blocks = laid.groupBy(*BLOCK).agg(F.max(F.when(F.col("starts"), place)).alias("_last"), F.min(place).alias("_head"))
    before = _earlier(["_file"], "_block")
    blocks = blocks.select(*BLOCK, F.max("_last").over(before).alias("_carried"), F.col("_head").alias("_head"))
    parts = laid.where(~F.col("alone")).withColumn("_own", F.max(F.when(F.col("starts"), place)).over(upto)).join(blocks, BLOCK)
    parts = parts.select("_file", F.coalesce("_own", "_carried").alias("_start"), place.alias("_at"), "value", "_first")
    joined = parts.groupBy("_file", "_start").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "value"))), lambda x: x["value"]), glue).alias("record"),
        F.max("_first").alias("first"),
    )
    return laid.where("alone").select(F.col("value").alias("record"), F.col("_first").alias("first")).unionByName(
        joined.select("record", "first")
    )


def _with_first(df: DataFrame) -> DataFrame:
    """Adds ``_first``: the piece with which a file begins. The row number is that of the task, so the block's first row tells it."""
    number = F.row_number().over(Window.partitionBy(*BLOCK).orderBy("_line"))
    return df.withColumn("_first", (F.col("_block") == 0) & (number == 1))


def json_array_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``record``: the text of each object in files that each hold one JSON array of objects; anything else is an error."""
    pieces = read_pieces(spark, path, "}")
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # escapes never reach over a brace
    quoted_parts = r'"[^"]*(?:"|$)'
    outside = lambda text: F.regexp_replace(text, quoted_parts, "")
    adds = lambda text: _count(text, "{[") - _count(text, "]")
    odd = F.pmod(_count(plain, '"'), F.lit(2))
    # The brace that ends the piece counts where it does not stand in a quoted text.
    out = adds(outside(plain)) - F.when(odd == 0, 1).otherwise(0)
    inner = adds(outside(F.concat(F.lit('"'), plain))) - F.when(odd == 1, 1).otherwise(0)
    placed = _with_first(_placed(pieces, odd, out, inner))
    starts = ~F.col("quoted") & (F.col("depth") <= 1)
    left = F.regexp_replace("value", r"^[\s﻿]*[\[,]?\s*", "")
    begins = F.when(F.col("_first"), F.col("value").rlike(r"^[\s﻿]*\[")).otherwise(F.col("value").rlike(r"^\s*[,\]]"))
    ending = left.rlike(r"^\]?\s*$")
    right = begins & (ending | left.startswith("{"))
    fault = F.raise_error(F.lit("JSON input must be a list of records")).cast("string")
    value = F.when(~starts, F.col("value")).when(right, left).otherwise(fault)
    marked = placed.select(
        value.alias("value"), "_file", "_block", "_line", "_first", starts.alias("starts"),
        (starts & ((F.col("depth") + F.col("own") == 1) | ending)).alias("alone"),
    )
    whole = _records(marked, "}").where(~F.col("record").rlike(r"^\]?\s*$"))
    return whole.select(F.concat("record", F.lit("}")).alias("record"))


WHOLE, CLOSES, OPENS, INNER = range(4)  # a record; the last part of one that a block before begins; the first part of one; a whole block inside one
PARTS = "record string, first boolean, _file string, _block long, kind int"


def _block_parts(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Records of blocks that are read from start to end: those inside a block if ``whole``, else parts of those that reach into the next.

    Rows are ``value, _file, _block, _starts_in``, of which the last tells whether the block begins in a quoted text.
    """
    place, kind, quoted, head = None, WHOLE, False, False
    open_parts: list[str] = []
    out: list[tuple] = []

    def leave() -> None:
        """The end of a block: what is open goes on in the next."""
        if open_parts and not whole:
            out.append(("\n".join(open_parts), head, *place, INNER if kind == CLOSES else OPENS))
        open_parts.clear()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * 5
        kinds = (pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int32())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["record", "first", "_file", "_block", "kind"])

    for batch in (part for some in batches for part in portions(some, "value")):
        rows = zip(*[batch[c].to_pylist() for c in ("value", "_file", "_block", "_starts_in")], strict=True)
        for value, file, block, starts_in in rows:
            if place != (file, block):
                leave()
                place, quoted = (file, block), bool(starts_in)
                kind, head = (CLOSES, False) if quoted else (WHOLE, block == 0)
            open_parts.append(value)
            quoted ^= value.count('"') % 2 == 1
            if not quoted:
                if whole == (kind == WHOLE):
                    out.append(("\n".join(open_parts), head, file, block, kind))
                open_parts.clear()
                kind, head = WHOLE, False
        if out:
            yield batch_of(out)
            out.clear()
    leave()
    if out:
        yield batch_of(out)


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``record``: the text of each record of files with a header and quoted line breaks; quotes stand only in quoted values, doubled.

    Three scans and no shuffle of the texts: quotes are counted by block, whose sums tell how each block begins; the tasks that read a block then put
    its records together; and of records that reach over blocks, two parts a block at most meet in a shuffle.
    """
    pieces = read_pieces(spark, path, "\n")
    blocks = pieces.groupBy(*BLOCK).agg(F.sum(F.pmod(_count(F.col("value"), '"'), F.lit(2))).alias("_odd"))
    blocks = blocks.select(*BLOCK, (_sum("_odd", _earlier(["_file"], "_block")) % 2 == 1).alias("_starts_in"))
    # One row a block. A broadcast leaves the pieces where, and in the order in which, they were read.
    begun = pieces.drop("_line").join(F.broadcast(blocks), BLOCK).select("value", *BLOCK, "_starts_in")
    inside = begun.mapInArrow(lambda it: _block_parts(it, True), PARTS).select("record", "first")
    across = begun.mapInArrow(lambda it: _block_parts(it, False), PARTS)
    order = Window.partitionBy("_file").orderBy("_block", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = across.withColumn("_number", F.sum((F.col("kind") == OPENS).cast("long")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("_block", "kind", "record")))
    joined = numbered.groupBy("_file", "_number").agg(
        F.array_join(F.transform(parts, lambda x: x["record"]), "\n").alias("record"), F.max("first").alias("first")
    )
    records = inside.unionByName(joined.select("record", "first")).where(~F.col("first"))
    return records.select(F.regexp_replace("record", r"\r$", "").alias("record")).where("record <> ''")
