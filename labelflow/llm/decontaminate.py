"""Benchmark decontamination with the q-gram lemma.

A passage of ``m`` characters found in a text with at most ``k`` edits shares at least ``m + 1 - q * (k + 1)`` of its q-grams with the
place where it is found, and all of them lie on diagonals (text position minus passage position) no more than ``k`` apart. So
shared q-grams are counted per passage and band of diagonals, bands overlapping by ``k``; a band that reaches the
bound marks a region, and a banded alignment of passage and region settles the distances exactly. Places that end within the edit
budget of a better one are that place; all others are matches of their own, overlapping or not.

The benchmark is a stated query set. It goes to the workers in blocks of at most ``BLOCK_CHARS`` characters, one pass over the texts per
block, so neither a task nor the driver holds more than one block. Texts are walked in segments that overlap by more than the
longest passage with its edits, several short texts at a time; nothing is shuffled.

Letters compare in lower case and ASCII white space as a space, both one to one, so offsets are code points of the text.
Edits allowed: ``rate`` of the passage's length, fewer if the bound would fall under one for a short passage; passages of
fewer than ``q`` characters, empty or null ones are no passages. A null text is empty. Repeated rows are each judged, repeated
passages each found. Without passages nothing is contaminated. Only the named columns are looked at;
:func:`drop_contaminated` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACES, named

Q = 8
RATE = 0.1
BLOCK_CHARS = 4_000_000
SEGMENT_CHARS = 400_000
TABLE_BITS = 22
BASE = np.uint64(0x9E3779B97F4A7C15)
BLANK = str.maketrans({s: " " for s in SPACES})


def even(text: str | None) -> str:
    """Lower case and spaces, with every character in its place."""
    blank = (text or "").translate(BLANK)
    lower = blank.lower()
    return lower if len(lower) == len(blank) else "".join(x if len(x := c.lower()) == 1 else c for c in blank)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit number for each run of ``q`` code points; equal runs have equal numbers."""
    n = len(points) - q + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(q):
        out = out * BASE + points[j : j + n]
    return out ^ (out >> np.uint64(29))


def allowed_edits(m: int, q: int = Q, rate: float = RATE) -> int:
    return max(0, min(int(m * rate), m // q - 1))


@dataclass
class Block:
    """Passages with an index from q-gram to (passage, position)."""

    ids: list
    texts: list[str]
    q: int
    rate: float
    table: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        points = [code_points(t) for t in self.texts]
        found = [grams(p, self.q) for p in points]
        self.points = points
        self.length = np.array([len(p) for p in points])
        self.edits = np.array([allowed_edits(len(p), self.q, self.rate) for p in points])
        self.need = self.length + 1 - self.q * (self.edits + 1)
        gram = np.concatenate(found)
        item = np.repeat(np.arange(len(found)), [len(g) for g in found])
        at = np.concatenate([np.arange(len(g)) for g in found])
        order = np.argsort(gram, kind="stable")
        self.item, self.at = item[order], at[order]
        self.gram, self.start, self.count = np.unique(gram[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.table[self._slot(self.gram)] = True

    @staticmethod
    def _slot(gram: np.ndarray) -> np.ndarray:
        return (gram * BASE) >> np.uint64(64 - TABLE_BITS)

    def regions(self, points: np.ndarray) -> list[tuple[int, int, int, np.ndarray]]:
        """``(passage, first diagonal, last diagonal, diagonals of shared q-grams)`` of every run of bands that reaches the bound."""
        gram = grams(points, self.q)
        where = np.nonzero(self.table[self._slot(gram)])[0]
        gram = gram[where]
        entry = np.searchsorted(self.gram, gram)
        entry[entry == len(self.gram)] = 0
        real = self.gram[entry] == gram
        where, entry = where[real], entry[real]
        if not len(where):
            return []
        count = self.count[entry]
        place = np.repeat(self.start[entry] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        item = self.item[place]
        diagonal = np.repeat(where, count) - self.at[place]
        step = self.edits[item] + 1
        band = diagonal // step
        both = np.concatenate([band, band - 1])  # bands are two steps wide, so each diagonal lies in two
        shift = int(both.min())
        wide = int(both.max()) - shift + 1
        key, n = np.unique(np.concatenate([item, item]).astype(np.int64) * wide + (both - shift), return_counts=True)
        hit_item, hit_diagonal = item, diagonal
        item, band = key // wide, key % wide + shift
        good = n >= self.need[item]
        out: list[tuple[int, int, int]] = []
        for i, b in zip(item[good].tolist(), band[good].tolist(), strict=True):
            low, high = b * int(self.edits[i] + 1), (b + 2) * int(self.edits[i] + 1) - 1
            if out and out[-1][0] == i and low <= out[-1][2] + 1:
                out[-1] = (i, out[-1][1], high)
            else:
                out.append((i, low, high))
        if not out:
            return []
        order = np.lexsort((hit_diagonal, hit_item))
        hit_item, hit_diagonal = hit_item[order], hit_diagonal[order]
        hits = lambda i: hit_diagonal[slice(*np.searchsorted(hit_item, [i, i + 1]))]
        return [(i, low, high, d[slice(*np.searchsorted(d, [low, high + 1]))]) for i, low, high in out for d in (hits(i),)]

    def places(self, text: str, points: np.ndarray, region: tuple[int, int, int, np.ndarray]) -> list[tuple[int, int, int]]:
        """``(start, stop, distance)`` of the places of the passage in the region: the best one, and so on among those that end
        more than the edit budget away from all better ones."""
        i, low, high, hits = region
        k, m = int(self.edits[i]), int(self.length[i])
        low, high = max(low, -k), min(high, len(points) - m + 2 * k)
        if low > high:
            return []
        start, stop = max(0, low - k), min(len(points), high + k + m)
        exact = text.find(self.texts[i], start, stop)
        # Another place has no q-gram on the diagonal of an exact one: to get there takes more than the budget.
        if exact >= 0 and np.count_nonzero(hits != exact) < self.need[i]:
            return [(exact, exact + m, 0)]
        if not k:
            found = []
            while exact >= 0:
                found.append((exact, exact + m, 0))
                exact = text.find(self.texts[i], exact + 1, stop)
            return found
        part = points[start:stop]
        distances = align(self.points[i], part, low - k - start, high + k - start)
        first = low - k - start + m
        near = np.nonzero(distances <= k)[0]
        found, taken = [], np.zeros(len(distances), dtype=bool)
        for at in near[np.argsort(distances[near], kind="stable")].tolist():
            if taken[at]:
                continue
            taken[max(0, at - k) : at + k + 1] = True
            end = first + at
            # Backwards from the end it found: the start that has this distance, nearest to the end.
            back = m - k + int(np.argmin(align(self.points[i][::-1], part[max(0, end - m - k) : end][::-1], -k, k, anchored=True)))
            found.append((start + end - back, start + end, int(distances[at])))
        return found


def align(passage: np.ndarray, text: np.ndarray, low: int, high: int, anchored: bool = False) -> np.ndarray:
    """Edit distance of the best match of the whole passage that ends on each of the diagonals ``low`` to ``high``.

    On diagonal ``d`` it ends before place ``d + len(passage)`` of ``text``. It may start anywhere on those diagonals, or only at the text's start if it is ``anchored``.
    """
    width = high - low + 1
    far = len(passage) + len(text) + 1
    diagonal = np.arange(low, high + 1)
    steps = np.arange(width)
    row = np.where((diagonal >= 0) & (diagonal <= len(text)), 0, far)
    if anchored:
        row = np.where(row == 0, diagonal, far)
    padded = np.concatenate([np.zeros(max(0, -low) + 1, np.uint32), text, np.zeros(max(0, high) + len(passage) + 1, np.uint32)])
    first = max(0, -low) + 1 + low  # place in ``padded`` of the character before column ``low`` + 1
    for i, c in enumerate(passage, 1):
        column = diagonal + i
        differs = padded[first + i - 1 : first + i - 1 + width] != c
        moved = row + differs
        moved[:-1] = np.minimum(moved[:-1], row[1:] + 1)
        moved = np.where((column >= 0) & (column <= len(text)), moved, far)
        if anchored:
            moved = np.where(column == 0, i, moved)
        else:
            moved = np.where(column == 0, np.minimum(moved, i), moved)
        row = np.where(
            (column >= 0) & (column <= len(text)), np.minimum.accumulate(moved - steps) + steps, far
        )
    return row


def find_passages(texts: list[str | None], block: Block) -> list[list[tuple[int, int, int, int]]]:
    """Per text the matches ``(passage, start, stop, distance)``, see :meth:`Block.places`."""
    margin = int((block.length + 3 * block.edits).max()) + block.q
    out: list[list] = [[] for _ in texts]

    def search(pieces: list[tuple[int, int, str]]) -> None:
        """Pieces ``(text number, offset, characters)``, joined by a character that no passage has with it."""
        gap = "\0" * margin
        joined = gap.join(p for _, _, p in pieces)
        starts = np.cumsum([0] + [len(p) + margin for _, _, p in pieces[:-1]])
        for region in block.regions(code_points(joined)):
            i, low, high, hits = region
            # Bands of neighbouring pieces may touch, so each piece is searched in its own part of the region.
            k = int(block.edits[i])
            ends = np.searchsorted(starts, [low - k, high + k + int(block.length[i])], side="right") - 1
            for at in range(max(0, int(ends[0])), int(ends[1]) + 1):
                number, offset, piece = pieces[at]
                shift = int(starts[at])
                for start, stop, distance in block.places(piece, code_points(piece), (i, low - shift, high - shift, hits - shift)):
                    out[number].append((i, start + offset, stop + offset, distance))

    pieces, size = [], 0
    for number, text in enumerate(texts):
        characters, at = even(text), 0
        while at < len(characters):
            piece = characters[at : at + SEGMENT_CHARS + margin]
            pieces.append((number, at, piece))
            size += len(piece) + margin
            if size >= SEGMENT_CHARS:
                search(pieces)
                pieces, size = [], 0
            at += SEGMENT_CHARS
    if pieces:
        search(pieces)
    return [sorted(set(found)) for found in out]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, q: int, rate: float, block_chars: int) -> Iterator[Block]:
    """The passages in blocks, read one partition at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(named(benchmark, id_col), named(benchmark, text_col)).toLocalIterator():
        text = even(row[1]).strip(" ")
        if len(text) < q:
            continue
        if ids and size + len(text) > block_chars:
            yield Block(ids, texts, q, rate)
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(text)
        size += len(text)
    if ids:
        yield Block(ids, texts, q, rate)


def contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    passage_col: str = "text",
    q: int = Q,
    rate: float = RATE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``(id, item, start, stop, distance)`` of every passage found in a text."""
    spark = df.sparkSession
    kinds = df.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kinds[0]}, item {kinds[1]}, start long, stop long, distance int"
    slim = df.select(named(df, id_col).alias("id"), named(df, text_col).alias("text"))
    out = None
    for block in blocks(benchmark, item_col, passage_col, q, rate, block_chars):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = find_passages(batch["text"].to_pylist(), sent.value)
                rows = [(n, *match) for n, matches in enumerate(found) for match in matches]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["id"].take(pa.array([r[0] for r in rows], pa.int64())),
                        pa.array([sent.value.ids[r[1]] for r in rows]) if rows else pa.nulls(0),
                        pa.array([r[2] for r in rows], pa.int64()),
                        pa.array([r[3] for r in rows], pa.int64()),
                        pa.array([r[4] for r in rows], pa.int32()),
                    ],
                    names=["id", "item", "start", "stop", "distance"],
                )

        part = slim.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    out = spark.createDataFrame([], schema) if out is None else out
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def drop_contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    passage_col: str = "text",
    q: int = Q,
    rate: float = RATE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows of ``df`` whose text holds no passage."""
    for block in blocks(benchmark, item_col, passage_col, q, rate, block_chars):
        sent = df.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = find_passages(batch.column(text_col).to_pylist(), sent.value)
                yield batch.filter(pa.array([not matches for matches in found], pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df
