"""What the two operators on repeated sequences share: sampled anchors, and the shuffle of packed entries.

A sequence of ``depth`` symbols has an anchor: its gram of ``gram`` symbols with the smallest hash. Equal sequences have equal anchors at equal
places, so a sequence repeats only if its anchor does, and anchors are few. Entries travel as lists, one row per group and batch of
documents; groups are as many as shuffle partitions times a constant, so their size does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import named, shuffle_partitions

GROUPS = 4
HOT = 4096
BATCH_BYTES = 32 << 20
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def rolled(h: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Hash of every run of ``n`` elements, from the hashes of runs of powers of two."""
    power, block, size = np.array([base]), h, 1  # an array, since arrays wrap around without a warning
    out, done = None, 0
    while n:
        if n & 1:
            if out is None:
                out = block
            else:
                m = len(h) - done - size + 1
                out = out[:m] * power + block[done : done + m]
            done += size
        n >>= 1
        if n:
            m = max(0, len(block) - size)
            block = block[:m] * power + block[size : size + m]
            power, size = power * power, size * 2
    return mixed(out)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def first_smallest(g: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value in every run of ``width``, by its upper bits; the first of equal ones.

    Upper bits and place are one number, so minima need no lookups.
    """
    low = np.uint64(max(1, len(g).bit_length()))
    least, size = g >> low << low | np.arange(len(g), dtype=np.uint64), 1
    while size < width:
        step = min(size, width - size)
        least = np.minimum(least[: len(least) - step], least[step:])
        size += step
    return (least & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)


class Batch:
    """Documents laid end to end: symbol hashes, valid suffix starts and the anchor of each."""

    def __init__(self, numbers: list[int], symbols: list[np.ndarray], depth: int, gram: int):
        self.numbers = np.array(numbers)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in symbols])])
        self.hashes = np.concatenate(symbols)
        doc = np.repeat(np.arange(len(symbols)), [len(x) for x in symbols])
        n = max(0, len(self.hashes) - depth + 1)
        self.starts = np.nonzero(doc[:n] == doc[depth - 1 : depth - 1 + n])[0]
        self.doc = doc
        self.grams = rolled(self.hashes, gram, BASES[0]) if n else np.zeros(0, np.uint64)
        self.anchor = first_smallest(self.grams, depth - gram + 1)[self.starts] if n else self.starts

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of the document, and symbol number inside it."""
        doc = self.doc[at]
        return self.numbers[doc], at - self.offsets[doc]

    def flagged(self, starts: list[list[int]]) -> np.ndarray:
        """A mark on every symbol that stands at one of its row's ``starts``."""
        out = np.zeros(len(self.hashes), dtype=bool)
        for k, number in enumerate(self.numbers.tolist()):
            out[self.offsets[k] + np.array(starts[number])] = True
        return out


def batches_of(texts: list[str | None], symbols: Callable, depth: int, gram: int, most: int) -> Iterator[Batch]:
    """The texts that have ``depth`` symbols or more, about ``most`` symbols at a time."""
    numbers, found, size = [], [], 0
    for number, text in enumerate(texts):
        some = symbols(text or "")
        if len(some) < depth:
            continue
        numbers.append(number)
        found.append(some)
        size += len(some)
        if size >= most:
            yield Batch(numbers, found, depth, gram)
            numbers, found, size = [], [], 0
    if numbers:
        yield Batch(numbers, found, depth, gram)


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, pa.int64())


def lists_of(values: pa.Array, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, values, type=pa.list_(kind))


ENTRY = ["id", "mark", "start", "bits"]


def entries_at(batch: pa.RecordBatch, row: np.ndarray, start: np.ndarray, bits: np.ndarray) -> dict[str, pa.Array]:
    """Places in documents: id, text hash, word number, and what is said about the words from there."""
    take = pa.array(row, pa.int64())
    return {
        "id": batch["id"].take(take),
        "mark": batch["mark"].take(take),
        "start": pa.array(start, pa.int32()),
        "bits": pa.array(bits, pa.int32()),
    }


def by_group(group: np.ndarray, columns: dict[str, pa.Array], names: list[str]) -> pa.RecordBatch:
    """One row per group, with every column as a list."""
    order = np.argsort(group, kind="stable")
    ids, sizes = np.unique(group, return_counts=True)
    take = pa.array(order, pa.int64())
    lists = [lists_of(columns[n].take(take), sizes, columns[n].type) for n in names]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *lists], names=["group", *names])


def group_of(h: np.ndarray, groups: int) -> np.ndarray:
    """Anchors have small hashes, being the smallest of many, so they are mixed anew before they are dealt to groups."""
    return ((mixed(h * BASES[1]) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def short_key(h: np.ndarray) -> np.ndarray:
    """32 bits of an anchor's hash, other ones than its group has. Anchors are known by both, which only decides what is looked at
    more closely: two anchors taken for one stay two in all results."""
    return mixed(h * BASES[0]).astype(np.uint32).view(np.int32)


def by_bytes(batch: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each, so that memory does not depend on how long texts are."""
    sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.nonzero(part[1:] != part[:-1])[0] + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def send_anchors(
    batches: Iterator[pa.RecordBatch], symbols: Callable, depth: int, gram: int, most: int, groups: int
) -> Iterator[pa.RecordBatch]:
    """Per group: hash and place of anchors. ``bits`` is how often the batch has the anchor.

    The first of equal anchors is sent to the group of its hash. The others, whose number is then over 1, are only reported as repeated,
    through any group and with the number 0.
    """
    for batch in (some for whole in batches for some in by_bytes(whole)):
        parts = []
        for b in batches_of(batch["text"].to_pylist(), symbols, depth, gram, most):
            anchors = np.unique(b.anchor)
            parts.append((b.grams[anchors], *b.place(anchors)))
        if not parts:
            continue
        h, row, start = [np.concatenate(x) for x in zip(*parts, strict=True)]
        _, first, times = np.unique(h, return_index=True, return_counts=True)
        bits = np.zeros(len(h), dtype=np.int32)
        bits[first] = times
        group = np.where(bits == 0, row % groups, group_of(h, groups))
        yield by_group(group, {"key": pa.array(short_key(h), pa.int32()), **entries_at(batch, row, start, bits)}, ["key", *ENTRY])


def flat(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays([c.flatten() for c in table.column(name).chunks])


def numbers_of(table: pa.Table, name: str) -> np.ndarray:
    return flat(table, name).to_numpy(zero_copy_only=False)


def _times(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which entries are counted, their distinct keys, the key of each, and how often each key occurs."""
    bits, key = numbers_of(table, "bits"), numbers_of(table, "key")
    counted = np.nonzero(bits > 0)[0]
    keys, which = np.unique(key[counted], return_inverse=True)
    times = np.zeros(len(keys), dtype=np.int64)
    np.add.at(times, which, bits[counted])
    return counted, keys, which, times


def repeated_anchors(table: pa.Table) -> pa.Table:
    """Places of the anchors that occur more than once."""
    counted, _, which, times = _times(table)
    chosen = numbers_of(table, "bits") == 0
    chosen[counted] = times[which] > 1
    take = pa.array(np.nonzero(chosen)[0], pa.int64())
    return pa.table({n: flat(table, n).take(take) for n in ("id", "mark", "start")})


def frequent_anchors(table: pa.Table, most: int) -> pa.Table:
    _, keys, _, times = _times(table)
    return pa.table({"key": pa.array(keys[times > most].astype(np.int32), pa.int32())})


def runs_of(*same: np.ndarray, next_to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs in which ``same`` do not change and ``next_to`` grows by one."""
    new = np.ones(len(next_to), dtype=bool)
    new[1:] = next_to[1:] != next_to[:-1] + 1
    for c in same:
        new[1:] |= c[1:] != c[:-1]
    heads = np.nonzero(new)[0]
    return heads, np.diff(np.append(heads, len(next_to)))


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, mark, text)``: what a row is known by is its id together with a hash of its text."""
    text = named(df, text_col)
    return df.select(named(df, id_col).alias("id"), F.hash(text).alias("mark"), text.alias("text"))


def groups_for(df: DataFrame) -> int:
    return GROUPS * shuffle_partitions(df)


def place_lists(id_type: str) -> str:
    return f"id array<{id_type}>, mark array<int>, start array<int>, bits array<int>"


def same_text(texts: DataFrame, right: DataFrame) -> F.Column:
    """The join condition between :func:`texts_of` and a table with ``_id`` and ``_mark``."""
    return texts["id"].eqNullSafe(right["_id"]) & (texts["mark"] == right["_mark"])


def _sent_anchors(texts: DataFrame, symbols: Callable, depth: int, gram: int, most: int):
    id_type = texts.schema["id"].dataType.simpleString()
    groups = groups_for(texts)
    return texts.mapInArrow(
        lambda it: send_anchors(it, symbols, depth, gram, most, groups),
        f"group int, key array<int>, {place_lists(id_type)}",
    ).groupBy("group")


def _counted(table: pa.Table, most: int) -> pa.Table:
    """Places of the anchors that occur more than once, and ``key`` of those that occur more than ``most`` times, on rows of their own."""
    places, often = repeated_anchors(table), frequent_anchors(table, most)
    both = {n: pa.chunked_array([*places[n].chunks, pa.nulls(len(often), places[n].type)]) for n in places.column_names}
    both["key"] = pa.chunked_array([pa.nulls(len(places), pa.int32()), *often["key"].chunks])
    return pa.table(both)


def counted_anchors(
    texts: DataFrame, symbols: Callable, depth: int, gram: int, most: int, hot: int = HOT
) -> tuple[DataFrame, np.ndarray]:
    """The texts with anchors that repeat and where those start, ``(id, mark, text, starts)``, and the short keys of anchors that occur
    more than ``hot`` times, counted over all documents. Those are at most as many as all anchors divided by ``hot``.
    """
    id_type = texts.schema["id"].dataType.simpleString()
    found = _sent_anchors(texts, symbols, depth, gram, most).applyInArrow(
        lambda table: _counted(table, hot), f"id {id_type}, mark int, start int, key int"
    )
    # A list for each document is far smaller than a row for each anchor; short keys of frequent ones are rows of their own.
    lists = cut_lineage(found.groupBy("id", "mark", "key").agg(F.collect_list("start").alias("starts")), "anchors")
    often = np.array([r[0] for r in lists.where("key IS NOT NULL").select("key").distinct().collect()], dtype=np.int32)
    flags = lists.where("key IS NULL").select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), "starts")
    return texts.join(flags, same_text(texts, flags)).select("id", "mark", "text", "starts"), often


def with_runs(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """Every text with its runs ``(id, mark, start, bits)`` of repeated starts: ``(id, text, starts, sizes)``."""
    covered = runs.groupBy("id", "mark").agg(F.collect_list(F.struct("start", "bits")).alias("runs"))
    covered = covered.select(
        F.col("id").alias("_id"),
        F.col("mark").alias("_mark"),
        F.col("runs.start").alias("starts"),
        F.col("runs.bits").alias("sizes"),
    )
    return texts.join(covered, same_text(texts, covered), "left").select("id", "text", "starts", "sizes")


def covered(n: int, starts: list[int] | None, sizes: list[int] | None, depth: int) -> np.ndarray:
    """Which of ``n`` symbols lie within ``depth`` symbols from a repeated start."""
    edge = np.zeros(n + 1, dtype=np.int64)
    if starts:
        np.add.at(edge, np.array(starts), 1)
        np.add.at(edge, np.array(starts) + np.array(sizes) + depth - 1, -1)
    return np.cumsum(edge[:-1]) > 0
