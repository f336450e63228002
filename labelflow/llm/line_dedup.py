"""Exact line dedup across documents, as bitmaps of dropped lines.

Line keys are hashed to 128 bits. Rows ``(hash, document, position)`` are dealt to equal ranges of the (uniform) hash,
sorted inside each range by document and position, and streamed: the first document of a hash stays, later ones
lose the line. A key that a third of all documents hold would fill one range, so the first round plays inside
``SALTS`` slices of each key; a row that is not first in its slice is lost for good, and only the first document of each
slice meets the others in the second round, at most ``SALTS`` documents a key. No text is shuffled: the outcome per
document is a sparse bitmap, one 64-bit word for each block of 64 lines that loses any.

Defined cases: a null or empty text is one empty line; lines whose key has fewer than ``min_chars`` code points are never
dropped; a document may repeat its own lines; rows with equal ids are one document (repeated rows keep the same lines), but where their
texts differ each loses only lines of its own, since bitmaps are kept by id and a hash of the text; a null id counts as one document
after all others. An empty table gives an empty result. Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, fresh, named, shuffle_partitions, whole_text

MIN_CHARS = 10
SALTS = 1024


def _in_ranges(rows: DataFrame, *keys: Column) -> DataFrame:
    """Rows dealt to equal-width ranges of a hash of ``keys``. It is uniform, so no sampling pass is needed for the bounds."""
    n = shuffle_partitions(rows)
    high = F.shiftrightunsigned(F.xxhash64(*keys), 32)
    return rows.withColumn("_range", F.floor(high * F.lit(n) / F.lit(1 << 32)).cast("int")).repartitionById(n, F.col("_range"))


def _mark(df: DataFrame, text_col: str) -> Column:
    return F.xxhash64(whole_text(named(df, text_col)))


def line_rows(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``(_h1, _h2, _id, _mark, _pos)`` of every line that is long enough to count."""
    lines = F.split(ascii_lower(whole_text(named(df, text_col))), "\n", -1)
    key = F.btrim("_line", F.lit(SPACES))
    return (
        df.select(named(df, id_col).alias("_id"), _mark(df, text_col).alias("_mark"), F.posexplode(lines).alias("_pos", "_line"))
        .select("_id", "_mark", "_pos", key.alias("_key"))
        .where(F.length("_key") >= min_chars)
        .select(F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit("second"), "_key").alias("_h2"), "_id", "_mark", "_pos")
    )


def dropped_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``(_id, _mark, _pos)`` of every line that an earlier document holds too."""
    rows = line_rows(df, id_col, text_col, min_chars)
    salt = F.pmod(F.xxhash64("_id"), F.lit(SALTS))
    order = [F.col("_id").asc_nulls_last(), F.col("_pos")]
    first = lambda *keys: F.first("_id").over(
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    salted = _in_ranges(rows, F.col("_h1"), F.col("_h2"), salt).withColumn("_salt", salt)
    slices = salted.withColumn("_first", first("_range", "_h1", "_h2", "_salt"))
    lost = ~F.col("_id").eqNullSafe(F.col("_first"))
    winners = slices.where(~lost).select("_h1", "_h2", "_id", "_mark", "_pos")
    final = winners.withColumn("_first", first("_h1", "_h2")).where(lost)
    return slices.where(lost).select("_id", "_mark", "_pos").unionByName(final.select("_id", "_mark", "_pos"))


def drop_bitmaps(dropped: DataFrame) -> DataFrame:
    """``(_id, _mark, _bits)``: per document and text a map from block number to the 64-bit word of its dropped lines."""
    words = (
        dropped.groupBy("_id", "_mark", F.shiftright("_pos", 6).alias("_block"))
        .agg(F.bit_or(F.expr("shiftleft(1L, _pos & 63)")).alias("_word"))
    )
    return words.groupBy("_id", "_mark").agg(F.map_from_entries(F.collect_list(F.struct("_block", "_word"))).alias("_bits"))


def _dense(bits: Column) -> Column:
    """Words of blocks 0 up to the last one with a dropped line."""
    last = F.array_max(F.map_keys(bits))
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.coalesce(F.try_element_at(bits, b), F.lit(0).cast("long")))


def dedup_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS
) -> tuple[DataFrame, list[str]]:
    """``df`` with new columns, whose names are returned: number of lines, dropped lines, and the text that is left.

    The text column itself is unchanged; a document that loses nothing gets its text back as it is.
    """
    bits_name, dense, lines, kept, n_lines, n_dropped, new = fresh(
        df, "_bits", "_dense", "_lines", "_kept", "n_lines", "n_dropped", "kept_text"
    )
    key, mark = fresh(df, "_key_of_bits", "_mark_of_bits")
    maps = drop_bitmaps(dropped_lines(df, id_col, text_col, min_chars))
    maps = maps.select(F.col("_id").alias(key), F.col("_mark").alias(mark), F.col("_bits").alias(bits_name))
    text = whole_text(named(df, text_col))
    own = named(df, id_col).eqNullSafe(maps[key]) & (_mark(df, text_col) == maps[mark])
    one = df.join(maps, own, "left").select(
        *[named(df, c) for c in df.columns],
        F.when(maps[bits_name].isNotNull(), _dense(maps[bits_name])).alias(dense),
        F.split(text, "\n", -1).alias(lines),
    )
    d = F.col(dense)
    word = lambda i: F.coalesce(F.get(d, F.shiftright(i, 6)), F.lit(0).cast("long"))
    is_kept = lambda x, i: F.getbit(word(i), i.bitwiseAND(F.lit(63))) == 0
    two = one.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.size(lines).cast("long").alias(n_lines),
        F.when(d.isNotNull(), F.filter(F.col(lines), is_kept)).alias(kept),
    )
    three = two.select(
        *[F.col(f"`{c}`") for c in df.columns],
        n_lines,
        F.coalesce(F.col(n_lines) - F.size(kept), F.lit(0)).cast("long").alias(n_dropped),
        F.when(F.col(kept).isNull(), whole_text(F.col(f"`{text_col}`"))).otherwise(F.array_join(kept, "\n")).alias(new),
    )
    return three, [n_lines, n_dropped, new]

