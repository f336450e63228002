"""SimHash near-dedup over a byte-position inverted index.

A fingerprint has eight positional bytes. Two fingerprints with at most three differing bits differ in at most three bytes, so
they share at least five of eight: the guaranteed minimum that candidates are held against before the exact
distance is computed. Lists of single bytes would be far too long, so the index holds lists of four positional bytes
taken together: ``QUADS`` are fourteen sets of four positions, and any five positions contain one of them. Fingerprints
meet in the lists of their quads, within which shared positional bytes are tallied and candidates verified.

Equal fingerprints are one entry. Lists are streamed in key order, and only a spanning forest of the links found in
a list leaves it, so a group of copies gives no more edges than members. A list longer than ``LIST_ROWS`` is not gathered: its
entries are keyed anew by one more of the other four bytes, one of which must be shared too, and if that is still too
long by a six-bit block of the last three bytes, after which at most 2 ** 18 entries can differ.

Defined cases: a null or empty text has no shingles and fingerprint zero, and is linked like any other; a text with fewer
words than a shingle is one shingle; repeated rows and repeated ids each get their row; null ids take part, and are the
component's id only where no row of it has one; an empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fresh, named, shuffle_partitions
from .components import forest, stars
from .near_copies import copy_groups, text_mark

MAX_BITS = 3
MIN_BYTES = 8 - MAX_BITS
SEED = 42
LIST_ROWS = 4096
FULL = (1 << 64) - 1


def _quads() -> list[tuple[int, ...]]:
    """Fourteen sets of four byte positions such that any five positions contain one of them (a Steiner system).

    Positions are the rows (0-3) and columns (4-7) of a 4 x 4 Hadamard matrix: all rows, all columns, and each two rows with
    two columns whose four entries have an even number of minus signs.
    """
    minus = lambda r, c: bin(r & c).count("1") % 2
    even = lambda r, s, c, d: (minus(r, c) + minus(r, d) + minus(s, c) + minus(s, d)) % 2 == 0
    mixed = [
        (r, s, 4 + c, 4 + d)
        for r, s in combinations(range(4), 2)
        for c, d in combinations(range(4), 2)
        if even(r, s, c, d)
    ]
    return [(0, 1, 2, 3), (4, 5, 6, 7), *mixed]


def _mask(positions: tuple[int, ...]) -> int:
    return sum(0xFF << (8 * p) for p in positions)


QUADS = [_mask(q) for q in _quads()]


def _finer(mask: int) -> list[int]:
    """Masks that a pair sharing ``mask`` and within ``MAX_BITS`` must share one of."""
    free = [p for p in range(8) if not mask >> (8 * p) & 0xFF]
    if len(free) == 4:
        return [mask | 0xFF << (8 * p) for p in free]
    bits = [8 * p + b for p in free for b in range(8)]
    return [mask | sum(1 << b for b in bits[i : i + 6]) for i in range(0, 24, 6)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, shingle: int = 3, seed: int = SEED) -> int:
    """64 bits; each is set if it is set in more than half of the shingles' hashes."""
    words = (text or "").encode().lower().split()  # both by ASCII rules
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 15):
        some = range(at, min(n, at + (1 << 15)))
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), seed) for i in some]
        votes += np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = 3, seed: int = SEED) -> DataFrame:
    """``(id, fp)`` of every row; ``fp`` holds the 64 bits as a signed integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signed(fingerprint(text.as_py(), shingle, seed)) for text in batch["text"]]
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "fp": pa.array(found, pa.int64())})

    slim = df.select(named(df, id_col).alias("id"), named(df, text_col).alias("text"))
    return slim.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, fp long")


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs share enough positional bytes and, of those, are within the distance."""
    x = a ^ b
    shared = sum(((x >> np.uint64(8 * p)) & np.uint64(0xFF) == 0).astype(np.int8) for p in range(8))
    near = shared >= MIN_BYTES
    near[near] = np.bitwise_count(x[near]) <= MAX_BITS
    return near


def _batch(mask: np.ndarray | None, u: np.ndarray, v: np.ndarray | None) -> pa.RecordBatch:
    columns = [pa.nulls(len(u), pa.int64()) if c is None else pa.array(c, pa.int64()) for c in (mask, u, v)]
    return pa.RecordBatch.from_arrays(columns, names=["mask", "u", "v"])


def _settle(mask: np.ndarray, value: np.ndarray, fp: np.ndarray, longest: int | None) -> Iterator[pa.RecordBatch]:
    """Whole lists: edges of those that are short enough, and the entries of the others."""
    if not len(fp):
        return
    new = np.concatenate([[True], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])])
    run = np.cumsum(new)
    size = np.bincount(run)[run]
    long = size > longest if longest else np.zeros(len(fp), dtype=bool)
    if long.any():
        yield _batch(mask[long], fp[long], None)
    short = ~long & (size > 1)
    fps = fp[short].view(np.uint64)
    i, j, _ = forest(run[short], lambda a, b: _near(fps[a], fps[b]))
    if len(i):
        yield _batch(None, fp[short][i], fp[short][j])


def _walk_lists(batches: Iterator[pa.RecordBatch], longest: int | None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``(mask, value)`` in; edges ``(null, u, v)`` and entries of long lists ``(mask, fp, null)`` out.

    The last list of a batch may go on in the next one. It waits for the rest, or, once it is too long, is passed on.
    """
    wait = [np.zeros(0, dtype=np.int64)] * 3
    passed: tuple[int, int] | None = None  # the long list whose first entries have left already
    for batch in batches:
        rows = [np.concatenate([w, batch[c].to_numpy(zero_copy_only=False)]) for w, c in zip(wait, ("mask", "value", "fp"), strict=True)]
        if passed is not None:
            same = (rows[0] == passed[0]) & (rows[1] == passed[1])
            if same.any():
                yield _batch(rows[0][same], rows[2][same], None)
            rows = [r[~same] for r in rows]
            if not len(rows[0]):
                wait = rows
                continue
            passed = None
        if not len(rows[0]):
            continue
        last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
        yield from _settle(*[r[~last] for r in rows], longest)
        wait = [r[last] for r in rows]
        if longest and len(wait[0]) > longest:
            passed = (int(wait[0][0]), int(wait[1][0]))
            yield _batch(wait[0], wait[2], None)
            wait = [r[:0] for r in rows]
    yield from _settle(*wait, longest)


def _links(entries: DataFrame, longest: int | None) -> DataFrame:
    """``entries`` is ``(mask, fp)``: every fingerprint under each mask it is to be looked up by."""
    n = shuffle_partitions(entries)
    lists = (
        entries.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        .repartition(n, "mask", "value")
        .sortWithinPartitions("mask", "value")
    )
    return cut_lineage(
        lists.mapInArrow(lambda batches: _walk_lists(batches, longest), "mask long, u long, v long"), "links"
    )


def _masks(masks: list[int]) -> F.Column:
    return F.explode(F.array(*[F.lit(signed(m)) for m in masks]))


def link_forest(distinct: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """Edges ``(u, v)`` that connect what links between the distinct fingerprints ``fp`` connect."""
    spark = distinct.sparkSession
    masks = QUADS
    links = _links(distinct.select(_masks(masks).alias("mask"), "fp"), list_rows)
    edges = links.where("v IS NOT NULL").select("u", "v")
    for last in (False, True):
        long = links.where("v IS NULL").select("mask", F.col("u").alias("fp"))
        if long.isEmpty():
            break
        finer = {m: _finer(m) for m in masks}
        table = spark.createDataFrame([(signed(m), signed(f)) for m in masks for f in finer[m]], "mask long, finer long")
        entries = long.join(F.broadcast(table), "mask").select(F.col("finer").alias("mask"), "fp").distinct()
        links = _links(entries, None if last else list_rows)
        edges = edges.unionByName(links.where("v IS NOT NULL").select("u", "v"))
        masks = sorted({f for some in finer.values() for f in some})
    return edges


def near_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    seed: int = SEED,
    list_rows: int = LIST_ROWS,
) -> DataFrame:
    """``(id, fp, component_id)`` of every row; ``component_id`` is the smallest id that links lead to."""
    prints = cut_lineage(fingerprints(df, id_col, text_col, shingle, seed), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("id").alias("first"))
    root = stars(link_forest(classes.select("fp"), list_rows)).withColumnRenamed("vertex", "fp")
    rooted = classes.join(root, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named_classes = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(named_classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that are first in their group of near copies, one row for each, with all columns unchanged.

    A row is known by its id together with a hash of its text, so rows without an id, or that share one, stay if their texts are no near
    copies. First is the smallest id, then the smallest hash; null ids are last. Of rows equal in both any one stays.
    Groups are those of ``near_copies``: candidates from an index of positional blocks of longer fingerprints, since three bits of 64 are
    far too few for a similarity of 0.8, and links confirmed on whole sets.
    """
    groups = cut_lineage(copy_groups(df, id_col, text_col, **options), "groups")
    smallest = F.min(F.struct(F.isnull("id").alias("no_id"), "id", "mark")).alias("rep")
    first = groups.groupBy("root").agg(smallest).select(F.col("rep.id").alias("_first"), F.col("rep.mark").alias("_first_mark"))
    (mark,) = fresh(df, "_text_mark")
    marked = df.withColumn(mark, text_mark(df, text_col))
    same = named(marked, id_col).eqNullSafe(first["_first"]) & (marked[mark] == first["_first_mark"])
    kept = marked.join(first, same, "left_semi")
    again = groups.groupBy("id", "mark").count().where("count > 1")
    if not again.isEmpty():
        kept = kept.dropDuplicates([id_col, mark])
    return kept.drop(mark)
