"""Ranked lexical search with MaxScore over term bounds and over bounds of term pairs.

The index holds every document. It is split by documents: a block of at most ``BLOCK_CHARS`` characters (or one longer text) has its own postings,
a row per term, and a head row with ids and lengths. A term of a third of all documents is thus spread over all blocks, and
building needs no shuffle. Scores use integers only, so results do not depend on blocks or order.

Queries go out in groups of at most ``QUERY_CHARS`` characters. For each group, and each block on its own:

1. lists of term pairs are made before the search: the intersection of two postings with the largest joint impact, for the pairs of
   neighbours in a query's order of weights. They are stored as a table. The best joint impacts over all blocks give each query a first
   threshold that its top documents are known to reach;
2. the search joins terms to pairs by the largest savings, so that each unit's bound is the joint maximum or that of a single term, and adds up
   units by rising bound. Units whose bounds add up to less than the threshold are looked up only for documents that the other
   units have brought up, and only while partial score and remaining bounds can reach the threshold, which rises on the way. A block whose bounds
   stay below it is skipped for that query.

Each block gives at most ``top`` documents a query; their ranks are taken in two rounds.

Defined cases: a null or empty text has no terms, is never found and does not count among the documents; a query without terms, or whose terms no
document holds, has no rows; documents with equal scores are ranked by id, null ids last; rows with equal ids or texts each
count and are ranked on their own, and so are equal queries; other columns are not read.
"""

from __future__ import annotations

import math
import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import named

TOP = 20
BLOCK_CHARS = 16 << 20
BLOCK_DOCS = 1 << 16
QUERY_CHARS = 1 << 20
PIECE = 1 << 22
ROWS = 1 << 15
SALTS = 64
_WORD = (string.ascii_letters + string.digits).encode()
FOLD = bytes(ord(chr(b).lower()) if b < 0x80 and b in _WORD else b if b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: str | None) -> Counter:
    """Occurrences of each term, in UTF-8: runs of ASCII letters (lower-cased), digits and all characters that are not ASCII."""
    data = (text or "").encode().translate(FOLD)
    if len(data) <= PIECE:
        return Counter(data.split())
    found, at = Counter(), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    return found


# Index


def _binary(kind: pa.DataType, sizes: np.ndarray, data: bytes) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


@dataclass
class _Block:
    """Postings of some documents, as they are gathered."""

    ids: list = field(default_factory=list)
    numbers: dict = field(default_factory=lambda: defaultdict(count().__next__))
    terms: list = field(default_factory=list)
    counts: list = field(default_factory=list)
    lengths: list = field(default_factory=list)
    size: int = 0

    def add(self, text: str | None, id_: pa.Scalar) -> None:
        found = terms_of(text)
        self.ids.append(id_)
        self.terms.append(np.fromiter(map(self.numbers.__getitem__, found), np.int64, len(found)))
        self.counts.append(np.fromiter(found.values(), np.uint32, len(found)))
        self.lengths.append(sum(found.values()))
        self.size += len(text or "")

    def batches(self, number: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        lengths = np.array(self.lengths, dtype=np.int64)
        head = {
            "block": pa.array([number], pa.int64()),
            "term": pa.nulls(1, pa.string()),
            "held": pa.array([int((lengths > 0).sum())], pa.int64()),
            "total": pa.array([int(lengths.sum())], pa.int64()),
            "places": pa.array([lengths.tobytes()], pa.binary()),
            "counts": pa.nulls(1, pa.binary()),
            "ids": pa.array([[x.as_py() for x in self.ids]], pa.list_(id_type)),
        }
        yield pa.RecordBatch.from_pydict(head)
        if not self.numbers:
            return
        listed = sorted(self.numbers)
        rank = np.empty(len(listed), dtype=np.int64)
        rank[[self.numbers[t] for t in listed]] = np.arange(len(listed))
        term = rank[np.concatenate(self.terms)]
        place = np.repeat(np.arange(len(self.ids)), [len(t) for t in self.terms])
        order = np.argsort(term * BLOCK_DOCS + place)
        places, counts = place[order].astype(np.uint16), np.concatenate(self.counts)[order]
        held = np.bincount(term)
        ends = np.concatenate([[0], np.cumsum(held)])
        for a in range(0, len(listed), ROWS):
            b = min(len(listed), a + ROWS)
            own = slice(ends[a], ends[b])
            names = listed[a:b]
            rows = {
                "block": pa.array(np.full(b - a, number), pa.int64()),
                "term": _binary(pa.string(), np.array([len(t) for t in names]), b"".join(names)),
                "held": pa.array(held[a:b], pa.int64()),
                "total": pa.nulls(b - a, pa.int64()),
                "places": _binary(pa.binary(), held[a:b] * 2, places[own].tobytes()),
                "counts": _binary(pa.binary(), held[a:b] * 4, counts[own].tobytes()),
                "ids": pa.nulls(b - a, pa.list_(id_type)),
            }
            yield pa.RecordBatch.from_pydict(rows)


def write_index(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> str:
    """Index all rows of ``df``; postings are sorted by term inside a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, block, id_type = TaskContext.get().partitionId() << 32, _Block(), pa.null()
        for batch in batches:
            id_type = batch["id"].type
            for text, id_ in zip(batch["text"], batch["id"], strict=True):
                block.add(text.as_py(), id_)
                if block.size >= block_chars or len(block.ids) == BLOCK_DOCS:
                    yield from block.batches(number, id_type)
                    number, block = number + 1, _Block()
        if block.ids:
            yield from block.batches(number, id_type)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"block long, term string, held long, total long, places binary, counts binary, ids array<{kind}>"
    slim = df.select(named(df, id_col).alias("id"), named(df, text_col).alias("text"))
    slim.mapInArrow(run, schema).write.parquet(path)
    return path


# Queries


@dataclass
class Queries:
    """Some queries: ids, weighted terms ``{term: times}``, and after :meth:`weigh` their units."""

    ids: list
    times: list[Counter]
    weight: dict[str, int] = field(default_factory=dict)
    documents: int = 0
    length: int = 1
    ranked: list[list[tuple[str, int]]] = field(default_factory=list)
    pairs: list[list[int]] = field(default_factory=list)
    listed: list[tuple[str, int, str, int]] = field(default_factory=list)

    def weigh(self, held: dict[str, int], documents: int, length: int) -> None:
        """Weights from document counts; each query's ``(term, factor)`` by falling factor, and the numbers of its pairs."""
        self.documents, self.length = documents, length
        self.weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for t, n in held.items()}
        numbers: dict[tuple, int] = {}
        for times in self.times:
            own = [(t, q * self.weight[t]) for t, q in times.items() if self.weight.get(t, 0) > 0]
            own.sort(key=lambda x: (-x[1], x[0]))
            self.ranked.append(own)
            near = [(*own[i], *own[j]) for i in range(len(own)) for j in (i + 1, i + 2) if j < len(own)]
            self.pairs.append([numbers.setdefault(p, len(numbers)) for p in near])
        self.listed = list(numbers)

    def share_of_length(self, lengths: np.ndarray) -> np.ndarray:
        top = int(lengths.max(initial=0))
        if 25 * top * self.documents < 1 << 62:
            return 75 + 25 * lengths * self.documents // self.length
        return np.array([75 + 25 * int(n) * self.documents // self.length for n in lengths], dtype=np.int64)


def query_groups(queries: DataFrame, id_col: str, text_col: str, most: int = QUERY_CHARS) -> Iterator[Queries]:
    """The queries in groups of bounded size, read one partition at a time."""
    ids, times, size = [], [], 0
    for row in queries.select(named(queries, id_col), named(queries, text_col)).toLocalIterator():
        if ids and size + len(row[1] or "") > most:
            yield Queries(ids, times)
            ids, times, size = [], [], 0
        ids.append(row[0])
        times.append(Counter({t.decode(): n for t, n in terms_of(row[1]).items()}))
        size += len(row[1] or "")
    if ids:
        yield Queries(ids, times)


# Blocks


class _Postings:
    """The postings of a block for the terms of a group of queries."""

    def __init__(self, table: pa.Table, asked: Queries):
        rows = zip(*[table[c].to_pylist() for c in ("term", "places", "counts")], strict=True)
        found = {t: (places, counts) for t, places, counts in rows}
        self.lengths = np.frombuffer(found.pop(None)[0], dtype=np.int64)
        share = asked.share_of_length(self.lengths)
        self.lists: dict[str, tuple[np.ndarray, np.ndarray, int]] = {}
        for t, (places, counts) in found.items():
            docs = np.frombuffer(places, dtype=np.uint16).astype(np.int64)
            tf = np.frombuffer(counts, dtype=np.uint32).astype(np.int64)
            impact = 1_000_000_000 * tf // (1000 * tf + 12 * share[docs])
            self.lists[t] = docs, impact, int(impact.max())

    def __contains__(self, term: str) -> bool:
        return term in self.lists

    def most(self, term: str, factor: int) -> int:
        return factor * self.lists[term][2]

    def at(self, term: str, docs: np.ndarray) -> np.ndarray:
        """Impacts in these documents, 0 where the term is not in one."""
        own, impact, _ = self.lists[term]
        place = np.minimum(np.searchsorted(own, docs), len(own) - 1)
        return np.where(own[place] == docs, impact[place], 0)

    def joint(self, a: str, fa: int, b: str, fb: int) -> tuple[np.ndarray, np.ndarray]:
        """The intersection list of two terms: documents and joint impacts."""
        (docs, impact, _), (fewer, factor) = self.lists[a], (b, fb)
        if len(self.lists[b][0]) < len(docs):
            (docs, impact, _), (fewer, factor), fa = self.lists[b], (a, fa), fb
        other = self.at(fewer, docs)
        both = other > 0
        return docs[both], fa * impact[both] + factor * other[both]


def pair_bounds(postings: _Postings, asked: Queries, top: int) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Joint maxima by pair, and ``(query, score)`` of scores that different documents of the block reach, ``top`` a query at most."""
    most, lists = {}, {}
    for i, (a, fa, b, fb) in enumerate(asked.listed):
        if a in postings and b in postings:
            docs, joint = postings.joint(a, fa, b, fb)
            if len(docs):
                most[i], lists[i] = int(joint.max()), (docs, joint)
    reached = []
    for q, own in enumerate(asked.ranked):
        best = np.zeros(len(postings.lengths), dtype=np.int64)
        for t, f in own:
            if t in postings:
                docs, impact, _ = postings.lists[t]
                best[docs] = np.maximum(best[docs], f * impact)
        for i in asked.pairs[q]:
            if i in lists:
                docs, joint = lists[i]
                best[docs] = np.maximum(best[docs], joint)
        best = best[best > 0]
        reached += [(q, int(s)) for s in (np.partition(best, len(best) - top)[-top:] if len(best) > top else best)]
    return most, reached


def units_of(q: int, asked: Queries, postings: _Postings, most: dict[int, int]) -> list[tuple[int, list[tuple[str, int]]]]:
    """``(bound, terms)`` by rising bound: pairs by the largest savings over their terms' own maxima, then what is left."""
    alone = {t: postings.most(t, f) for t, f in asked.ranked[q] if t in postings}
    offers = []
    for i in asked.pairs[q]:
        a, fa, b, fb = asked.listed[i]
        if a in alone and b in alone:
            bound = max(alone[a], alone[b], most.get(i, 0))
            offers.append((alone[a] + alone[b] - bound, bound, (a, fa), (b, fb)))
    out = []
    for _, bound, *terms in sorted(offers, reverse=True):
        if all(t in alone for t, _ in terms):
            out.append((bound, terms))
            for t, _ in terms:
                del alone[t]
    out += [(alone[t], [(t, f)]) for t, f in asked.ranked[q] if t in alone]
    return sorted(out, key=lambda u: (u[0], u[1]))


def search_block(q: int, asked: Queries, postings: _Postings, most: dict[int, int], threshold: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the block that may be among the best ``top`` of all, with their scores."""
    units = units_of(q, asked, postings, most)
    below = np.cumsum([0, *[bound for bound, _ in units]])  # of the units before each
    threshold = max(threshold, 1)
    first = int(np.searchsorted(below[1:], threshold))
    if first == len(units):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    score = np.zeros(len(postings.lengths), dtype=np.int64)
    for _, terms in units[first:]:
        for t, f in terms:
            docs, impact, _ = postings.lists[t]
            score[docs] += f * impact
    docs = np.nonzero(score)[0]
    score = score[docs]
    for u in range(first, -1, -1):  # the units before the u-th are still to be added
        if len(docs) > top:
            threshold = max(threshold, int(np.partition(score, len(score) - top)[len(score) - top]))
        kept = score + below[u] >= threshold
        docs, score = docs[kept], score[kept]
        if u:
            for t, f in units[u - 1][1]:
                score = score + f * postings.at(t, docs)
    return docs, score


def search(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    item_col: str = "item_id",
    text_col: str = "text",
    top: int = TOP,
    query_chars: int = QUERY_CHARS,
) -> DataFrame:
    """``(item, rank, doc_id, score)``: the best ``top`` documents of the index at ``path`` for each query."""
    index = spark.read.parquet(path)
    id_kind = index.schema["ids"].dataType.elementType.simpleString()
    item_kind = queries.schema[item_col].dataType.simpleString()
    documents, length = index.where("term IS NULL").agg(F.sum("held"), F.sum("total")).first()
    out = None
    for asked in query_groups(queries, item_col, text_col, query_chars) if documents else ():
        part = _search_group(spark, index, asked, documents, length, top, id_kind, item_kind)
        out = part if out is None else out.unionByName(part)
    out = spark.createDataFrame([], f"item {item_kind}, rank int, doc_id {id_kind}, score long") if out is None else out
    return out.withColumnRenamed("item", item_col)


def _search_group(
    spark: SparkSession, index: DataFrame, asked: Queries, documents: int, length: int, top: int, id_kind: str, item_kind: str
) -> DataFrame:
    words = sorted({t for times in asked.times for t in times})
    table = F.broadcast(spark.createDataFrame([(w,) for w in words], "term string"))  # at most QUERY_CHARS
    wanted = index.where("term IS NOT NULL").join(table, "term", "left_semi")
    held = {r["term"]: r["n"] for r in wanted.groupBy("term").agg(F.sum("held").alias("n")).collect()}
    asked.weigh(held, documents, length)
    sent = spark.sparkContext.broadcast(asked)
    columns = ("block", "term", "places", "counts")
    heads = index.where("term IS NULL")
    lists = wanted.select(*columns).unionByName(heads.select(*columns))

    def bounds(group: pa.Table) -> pa.Table:
        most, reached = pair_bounds(_Postings(group, sent.value), sent.value, top)
        block = group["block"][0].as_py()
        rows = [(block, True, i, s) for i, s in most.items()] + [(block, False, q, s) for q, s in reached]
        kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.int64())
        arrays = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.Table.from_arrays(arrays, names=["block", "pair", "number", "score"])

    joint = cut_lineage(lists.groupBy("block").applyInArrow(bounds, "block long, pair boolean, number int, score long"), "pair-bounds")
    best = _best(joint.where("NOT pair"), ["number"], [F.desc("score")], top)
    enough = best.groupBy("number").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= top)
    least = spark.sparkContext.broadcast({r["number"]: r["least"] for r in enough.collect()})  # a number a query

    def run(group: pa.Table) -> pa.Table:
        asked, most = sent.value, {}
        known = group.filter(group["pair"].is_valid())
        most = dict(zip(known["pair"].to_pylist(), known["score"].to_pylist(), strict=True))
        group = group.filter(group["pair"].is_null())
        head = group.filter(group["term"].is_null())
        ids = head["ids"].combine_chunks().flatten()
        place = np.empty(len(ids), dtype=np.int64)
        place[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
        postings = _Postings(group, asked)
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for q in range(len(asked.ids)):
            docs, score = search_block(q, asked, postings, most, least.value.get(q, 0), top)
            order = np.lexsort((place[docs], -score))[:top]
            found.append((q, docs[order], score[order]))
        number = np.repeat([q for q, _, _ in found], [len(d) for _, d, _ in found])
        docs = np.concatenate([d for _, d, _ in found])
        block = group["block"][0].as_py()
        return pa.Table.from_arrays(
            [
                pa.array(np.full(len(docs), block), pa.int64()),
                pa.array(number, pa.int32()),
                ids.take(pa.array(docs)),
                pa.array(np.concatenate([s for _, _, s in found]), pa.int64()),
            ],
            names=["block", "number", "doc_id", "score"],
        )

    none = lambda kind: F.lit(None).cast(kind)
    parts = wanted.select(*columns, none(f"array<{id_kind}>").alias("ids"), none("int").alias("pair"), none("long").alias("score"))
    parts = parts.unionByName(heads.select(*columns, "ids", none("int").alias("pair"), none("long").alias("score")))
    known = joint.where("pair").select(
        "block", none("string").alias("term"), none("binary").alias("places"), none("binary").alias("counts"),
        none(f"array<{id_kind}>").alias("ids"), F.col("number").alias("pair"), "score",
    )
    found = parts.unionByName(known).groupBy("block").applyInArrow(run, f"block long, number int, doc_id {id_kind}, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ranked = _best(found, ["number"], order, top)
    names = spark.createDataFrame(list(enumerate(asked.ids)), f"number int, item {item_kind}")
    return ranked.join(F.broadcast(names), "number").select("item", F.col("_rank").alias("rank"), "doc_id", "score")


def _best(df: DataFrame, by: list[str], order: list, top: int) -> DataFrame:
    """The first ``top`` rows of each group with their ``_rank``, first among slices of the blocks, then of all."""
    slices = df.withColumn("_slice", F.pmod(F.xxhash64("block"), F.lit(SALTS)))
    first = Window.partitionBy(*by, "_slice").orderBy(*order)
    some = slices.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= top).drop("_rank", "_slice")
    return some.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= top)
