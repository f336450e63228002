"""Removal of repeated byte sequences with difference-cover suffix arrays.

A byte goes if a string of ``depth`` bytes that covers it also starts in a document with a smaller id.

1. Anchors that occur once are left out: no repeated string can stand around them (see ``repeats``).
2. The bytes around each repeated anchor, as far as strings with that anchor reach, go to the anchor's group once per batch of
   documents and distinct content, together with all places where the smallest id of the batch has them; places of larger ids are
   known to be repeats.
3. A group sorts its suffixes by the difference cover modulo three: triples at places 1 and 2 modulo 3 are sorted and named, names are
   sorted in recursion where they repeat, the other suffixes are ranked by their first byte and the rank behind it, and both are merged.
   Neighbours in that order are compared over ``depth`` bytes; of each class of equal strings all but the smallest id are repeats.
4. The repeated starts of each document meet its text, and covered bytes are cut. Texts move once; one exchange serves both joins.

Suffixes are only compared within groups, since equal strings have one anchor. An anchor with more than ``HOT`` entries would make a
group too large to sort at once: its strings are then sent one by one, to the groups of their own hashes. Both kinds
combine within batches first.

Defined cases: a null or empty text has no bytes; a document shorter than ``depth`` bytes loses nothing; documents with equal ids (repeated rows
too) do not repeat each other; a null id counts as larger than all others; offsets are bytes, and what is left need not be valid
UTF-8; an empty table gives an empty result. Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from .repeats import (
    BASES,
    ENTRY,
    HOT,
    batches_of,
    by_bytes,
    counted_anchors,
    covered,
    entries_at,
    flat,
    group_of,
    groups_for,
    lists_of,
    longs,
    mixed,
    numbers_of,
    place_lists,
    rolled,
    runs_of,
    short_key,
    texts_of,
    with_runs,
)

DEPTH = 50
GRAM = 16
BATCH_BYTES = 1_000_000
SLICE = 250_000  # bytes of contexts that are sorted together, unless one key has more
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * BASES[1])


def symbols(text: str) -> np.ndarray:
    return BYTES[np.frombuffer(text.encode(), dtype=np.uint8)]


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names from 0, below 2 ** 31, in the order of the pairs."""
    return np.unique((a << 32) | b, return_inverse=True)[1].reshape(-1)


def suffix_ranks(s: np.ndarray) -> np.ndarray:
    """Rank of every suffix of ``s`` (numbers from 1, below 2 ** 31), by the difference cover modulo three.

    Three names are packed into one number while each fits 21 bits; beyond that the first two are named anew as a pair.
    """
    n = len(s)
    if n < 4:
        order = sorted(range(n), key=lambda i: s[i:].tolist())
        ranks = np.empty(n, dtype=np.int64)
        ranks[order] = np.arange(n)
        return ranks
    padded = np.concatenate([s, np.zeros(3, dtype=np.int64)])
    # Sampled places, those of remainder 1 before those of remainder 2. A string that ends with remainder 1 gets one place more, so
    # that the triples of the first part end before those of the second begin.
    one = np.arange(1, n + (n % 3 == 1), 3)
    sampled = np.concatenate([one, np.arange(2, n, 3)])
    narrow = max(int(s.max()), len(sampled) + 1) < 1 << 21
    if narrow:
        triple = (padded[sampled] << 42) | (padded[sampled + 1] << 21) | padded[sampled + 2]
    else:
        triple = (_pairs(padded[sampled], padded[sampled + 1]) << 32) | padded[sampled + 2]
    order = np.argsort(triple)
    names = np.empty(len(sampled), dtype=np.int64)
    sorted_triples = triple[order]
    names[order] = np.cumsum(np.concatenate([[1], (sorted_triples[1:] != sorted_triples[:-1]).astype(np.int64)]))
    sample_ranks = names if names.max() == len(names) else suffix_ranks(names) + 1
    rank = np.zeros(n + 4, dtype=np.int64)  # of sampled suffixes, from 1; 0 behind the end
    rank[sampled] = sample_ranks
    zero = np.arange(0, n, 3)
    two = np.arange(2, n, 3)
    one = np.arange(1, n, 3)
    # Against remainder 1 a byte and the rank behind it decide, against remainder 2 two bytes and the rank behind them.
    by_one = lambda at: (padded[at] << 32) | rank[at + 1]
    if narrow:
        by_two = lambda at: (padded[at] << 42) | (padded[at + 1] << 21) | rank[at + 2]
    else:
        pair = _pairs(padded[:n], padded[1 : n + 1])
        by_two = lambda at: (pair[at] << 32) | rank[at + 2]
    zero_order = np.argsort(by_one(zero))
    zero = zero[zero_order]
    one = one[np.argsort(rank[one])]
    two = two[np.argsort(rank[two])]
    in_one = np.searchsorted(by_one(one), by_one(zero))
    in_two = np.searchsorted(by_two(two), by_two(zero))
    out = np.empty(n, dtype=np.int64)
    out[zero] = np.arange(len(zero)) + in_one + in_two
    real = np.concatenate([one, two])
    real = real[np.argsort(rank[real])]
    before_one = np.searchsorted(by_one(zero), by_one(one))  # suffixes of remainder 0 before each
    before_two = np.searchsorted(by_two(zero), by_two(two))
    among = np.empty(n, dtype=np.int64)
    among[real] = np.arange(len(real))
    out[one] = among[one] + before_one
    out[two] = among[two] + before_two
    return out


def classes(contexts: list[bytes], depth: int) -> np.ndarray:
    """A number for each string of ``depth`` bytes in each context, in order, such that equal strings have equal numbers."""
    raw = np.frombuffer(b"\0".join(contexts), dtype=np.uint8)
    sizes = np.array([len(c) for c in contexts])
    begin = np.cumsum(sizes + 1) - sizes - 1
    between = np.zeros(len(raw), dtype=bool)
    between[begin[1:] - 1] = True
    strings = sizes - depth + 1
    starts = np.repeat(begin - (np.cumsum(strings) - strings), strings) + np.arange(strings.sum())
    ranks = suffix_ranks(np.where(between, 1, raw.astype(np.int64) + 2))
    order = np.argsort(ranks[starts])
    at = starts[order]
    # Eight bytes from every place as one number, without copies: neighbours are compared word by word.
    words = np.ndarray(len(raw) - 7, dtype="<u8", buffer=raw.tobytes(), strides=(1,))
    new = np.zeros(len(at), dtype=bool)
    new[0] = True
    for step in [*range(0, depth - 8, 8), depth - 8]:
        seen = words[at + step]
        new[1:] |= seen[1:] != seen[:-1]
    out = np.empty(len(at), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def rank_ids(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of the ids, equal for equal ones; nulls come last."""
    return pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="min").to_numpy().astype(np.int64)


def _send_contexts(
    batches: Iterator[pa.RecordBatch], depth: int, gram: int, groups: int, hot: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Per group: distinct contexts (list ``key``, and ``content`` with their ``size``), and places with the number of their context in the row (``of``).

    ``bits`` is the number of strings of a place; places that are only reported as repeats have a negative one and no context.
    """
    for batch in (some for whole in batches for some in by_bytes(whole)):
        texts, starts = batch["text"].to_pylist(), batch["starts"].to_pylist()
        parts = []
        for b in batches_of(texts, symbols, depth, gram, BATCH_BYTES):
            use = b.flagged(starts)[b.anchor]
            at, anchor = b.starts[use], b.anchor[use]
            key = b.grams[anchor]
            often = np.isin(short_key(key), hot)
            if often.any():  # strings of their own, each under its own hash
                key[often] = rolled(b.hashes, depth, BASES[0])[at[often]]
            row, start = b.place(at)
            heads, size = runs_of(anchor, np.where(often, at, -1), next_to=at)
            parts.append((row[heads], start[heads], size, key[heads]))
        if not parts:
            continue
        row, start, size, key = [np.concatenate(x) for x in zip(*parts, strict=True)]
        if len(row):
            yield _contexts_by_group(batch, texts, row, start, size, key, depth, groups)


def _contexts_by_group(
    batch: pa.RecordBatch,
    texts: list[str],
    row: np.ndarray,
    start: np.ndarray,
    size: np.ndarray,
    key: np.ndarray,
    depth: int,
    groups: int,
) -> pa.RecordBatch:
    encoded = {r: texts[r].encode() for r in np.unique(row).tolist()}
    content = [encoded[r][a : a + n + depth - 1] for r, a, n in zip(row.tolist(), start.tolist(), size.tolist(), strict=True)]
    number: dict[bytes, int] = {}
    of = np.array([number.setdefault(c, len(number)) for c in content], dtype=np.int64)
    rank = rank_ids(batch["id"])[row]
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, of, rank)
    report = rank > least[of]
    keys = np.empty(len(number), dtype=np.uint64)
    keys[of] = key
    group_of_context = group_of(keys, groups)
    group = np.where(report, row % groups, group_of_context[of])
    # Contexts in the order of their groups, and their numbers inside each.
    by_group = np.argsort(group_of_context, kind="stable")
    per = np.bincount(group_of_context, minlength=groups)
    local = np.empty(len(number), dtype=np.int64)
    local[by_group] = np.arange(len(number)) - np.repeat(np.cumsum(per) - per, per)
    order = np.argsort(group, kind="stable")
    ids, places = np.unique(group[order], return_counts=True)  # every group with a context has a place too
    entries = entries_at(batch, row[order], start[order], np.where(report, -size, size)[order])
    contents = list(number)
    columns = {n: lists_of(entries[n], places, entries[n].type) for n in ENTRY}
    columns["of"] = lists_of(pa.array(np.where(report, -1, local[of])[order], pa.int32()), places, pa.int32())
    columns["key"] = lists_of(longs(keys[by_group]), per[ids], pa.int64())
    sizes = [len(contents[i]) for i in by_group.tolist()]
    columns["size"] = lists_of(pa.array(sizes, pa.int32()), per[ids], pa.int32())
    # All contexts of a row are packed together, since they overlap.
    pack, at, packed = zstandard.ZstdCompressor(level=3), 0, []
    for n in per[ids].tolist():
        packed.append(pack.compress(b"".join([contents[i] for i in by_group[at : at + n].tolist()])))
        at += n
    columns["content"] = pa.array(packed, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *columns.values()], names=["group", *columns])


def _slices(key: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Contexts in the order of their keys, cut between two keys whenever ``SLICE`` bytes have come together."""
    order = np.argsort(key, kind="stable")
    at, total = 0, 0
    for i in range(len(order)):
        if total >= SLICE and key[order[i]] != key[order[i - 1]]:
            yield order[at:i]
            at, total = i, 0
        total += int(sizes[order[i]]) + 1
    if len(order):
        yield order[at:]


def _repeated_strings(table: pa.Table, depth: int) -> pa.Table:
    """Runs of strings that start in a document with a smaller id too: ``(id, mark, start, bits = length)``."""
    number: dict[bytes, int] = {}  # distinct contexts, also where several batches have sent one
    unpack = zstandard.ZstdDecompressor()
    same = np.array(
        [
            number.setdefault(whole[b - n : b], len(number))
            for row, sizes in zip(table.column("content").to_pylist(), table.column("size").to_pylist(), strict=True)
            for whole in (unpack.decompress(row),)
            for n, b in zip(sizes, np.cumsum(sizes, dtype=np.int64).tolist(), strict=True)
        ],
        dtype=np.int64,
    )
    contents = list(number)
    key = np.zeros(len(contents), dtype=np.int64)
    key[same] = numbers_of(table, "key")
    sizes = np.array([len(c) for c in contents], dtype=np.int64)
    strings = sizes - depth + 1
    first = np.cumsum(strings) - strings  # number of a context's first string
    # Strings of one context have their anchor at different places, so they differ: only contexts that share an anchor are sorted.
    shift = int(strings.sum())
    cls = np.arange(shift)
    _, which_key, times = np.unique(key, return_inverse=True, return_counts=True)
    several = np.nonzero(times[which_key] > 1)[0]
    for some in _slices(key[several], sizes[several]):
        some = several[some]
        found = classes([contents[i] for i in some.tolist()], depth)
        n = strings[some]
        cls[np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = found + shift
        shift += len(found) + 1
    # Numbers of contexts are those inside each sent row; add the contexts of the rows before it.
    rows = np.array([len(x) for c in table.column("key").chunks for x in c])
    entries = np.array([len(x) for c in table.column("of").chunks for x in c])
    of = numbers_of(table, "of") + np.repeat(np.cumsum(rows) - rows, entries)
    size, start = numbers_of(table, "bits"), numbers_of(table, "start")
    rank = rank_ids(flat(table, "id"))
    sent = np.nonzero(size > 0)[0]
    n = size[sent]
    place = np.repeat(sent, n)
    step = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
    which = cls[first[same[of[place]]] + step]
    least = np.full(int(which.max()) + 1 if len(which) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, which, rank[place])
    later = rank[place] > least[which]
    place, byte = place[later], (start[place] + step)[later]
    heads, length = runs_of(place, next_to=byte)
    told = np.nonzero(size < 0)[0]
    take = pa.array(np.concatenate([place[heads], told]), pa.int64())
    return pa.table(
        {
            "id": flat(table, "id").take(take),
            "mark": flat(table, "mark").take(take),
            "start": pa.array(np.concatenate([byte[heads], start[told]]), pa.int32()),
            "bits": pa.array(np.concatenate([length, -size[told]]), pa.int32()),
        }
    )


def _cut(batches: Iterator[pa.RecordBatch], depth: int, with_bytes: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, starts, sizes in zip(*[batch[c].to_pylist() for c in ("text", "starts", "sizes")], strict=True):
            raw = (text or "").encode()
            gone = covered(len(raw), starts, sizes, depth)
            left = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
            spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].sum())
            rows.append((len(raw), len(raw) - len(left), spans, hashlib.sha256(left).hexdigest(), left if with_bytes else None))
        n, removed, spans, digest, left = zip(*rows, strict=True) if rows else ((),) * 5
        columns = [batch["id"], *[pa.array(x, pa.int64()) for x in (n, removed, spans)], pa.array(digest, pa.string())]
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_bytes:
            columns, names = [*columns, pa.array(left, pa.binary())], [*names, "kept_bytes"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def cut_later_copies(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = DEPTH,
    gram: int = GRAM,
    hot: int = HOT,
    with_bytes: bool = True,
) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes)`` of every row. ``depth`` is 8 or more."""
    texts = texts_of(df, id_col, text_col)
    id_type, groups = df.schema[id_col].dataType.simpleString(), groups_for(df)
    anchored, often = counted_anchors(texts, symbols, depth, gram, BATCH_BYTES, hot)
    contexts = anchored.mapInArrow(
        lambda it: _send_contexts(it, depth, gram, groups, often),
        f"group int, {place_lists(id_type)}, of array<int>, key array<long>, size array<int>, content binary",
    )
    runs = contexts.groupBy("group").applyInArrow(
        lambda table: _repeated_strings(table, depth), f"id {id_type}, mark int, start int, bits int"
    )
    schema = f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept_bytes binary" if with_bytes else ""
    done = with_runs(texts, runs).mapInArrow(lambda it: _cut(it, depth, with_bytes), schema)
    return done.withColumnRenamed("id", id_col)
