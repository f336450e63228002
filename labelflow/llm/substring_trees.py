"""Removal of repeated word sequences with prefix-partitioned suffix trees.

The tree holds the suffixes of all texts; an internal node ``depth`` words deep or more, with its two or more leaves, is a sequence that
repeats. No task could hold the tree, so suffixes are split by variable-length prefixes: a suffix's prefix ends with the word gram of
its first ``depth`` words that has the smallest hash (its anchor). Equal sequences have equal prefixes, so what shares a prefix is a subtree of its own.

1. Prefixes. Only prefixes whose anchor occurs twice can have an internal node below them. Anchors are every fourteenth word or so; they are
   counted in groups by hash over all documents, and those that repeat go back to their documents. A prefix with over ``HOT`` suffixes
   is lengthened to full depth, so that these spread over all groups.
2. Subtrees. The words around each such anchor, as far as suffixes below it reach, go to the group of the prefix, once per batch of documents and
   distinct content. A group takes its prefixes together until they make ``SUBTREE_WORDS`` words, the bound of what is sorted at once unless one prefix
   alone has more (``HOT`` suffixes at most). It sorts their suffixes by a difference cover, takes the longest common prefixes
   of neighbours, and forms the internal nodes with a stack over them. The leaves below nodes of full depth repeat.
3. The repeated starts of each document meet its text, and covered words are cut.

Both rounds combine before they shuffle: of equal anchors or contents of one batch of documents, the first is sent and the others are
known to repeat at once. So a sequence that a third of all documents hold makes one entry per batch, not one per document. Texts
move once, keyed by document, and that exchange serves both joins. Words are known by 64-bit hashes.

Defined cases: a null or empty text has no words; texts shorter than ``depth`` words lose nothing; repeated rows repeat each other (with
the same id too) and lose what they share; ids may be null; an empty table gives an empty result. Only the id and text columns are
read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
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
    numbers_of,
    place_lists,
    rolled,
    runs_of,
    short_key,
    texts_of,
    with_runs,
)
from .suffix_array import suffix_ranks

DEPTH = 35
GRAM = 8
BATCH_WORDS = 400_000
SUBTREE_WORDS = 250_000
MEMO_WORDS = 1_000_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def symbols(text: str) -> np.ndarray:
    """A hash per word. Bytes are split at ASCII white space."""
    words = text.encode().split()
    return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))


def _send_contexts(
    batches: Iterator[pa.RecordBatch], depth: int, gram: int, groups: int, hot: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Per group: distinct contexts (``key`` of the prefix, ``size`` in words, ``known`` if the batch has it twice, and packed ``content``), and
    places of runs of suffixes with the number of their context in the row (``of``).

    ``bits`` is the number of suffixes of a place; places that are only reported as repeated have a negative one and no context.
    """
    for batch in (some for whole in batches for some in by_bytes(whole)):
        parts, starts, number, of = [], batch["starts"].to_pylist(), {}, []
        for b in batches_of(batch["text"].to_pylist(), symbols, depth, gram, BATCH_WORDS):
            use = b.flagged(starts)[b.anchor]
            at, anchor = b.starts[use], b.anchor[use]
            key = b.grams[anchor]
            often = np.isin(short_key(key), hot)
            key[often] = rolled(b.hashes, depth, BASES[0])[at[often]]  # hot prefixes grow to full depth
            heads, size = runs_of(anchor, np.where(often, at, -1), next_to=at)
            ends = at[heads] + size + depth - 1
            words = b.hashes.tobytes()
            of += [number.setdefault(words[8 * i : 8 * j], len(number)) for i, j in zip(at[heads].tolist(), ends.tolist(), strict=True)]
            row, start = b.place(at[heads])
            parts.append((row, start, size, key[heads]))
        if not of:
            continue
        row, start, size, key = [np.concatenate(x) for x in zip(*parts, strict=True)]
        yield _by_subtree(batch, list(number), np.array(of), row, start, size, key, groups)


def _by_subtree(
    batch: pa.RecordBatch, contents: list[bytes], of: np.ndarray, row: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray, groups: int
) -> pa.RecordBatch:
    _, first, times = np.unique(of, return_index=True, return_counts=True)
    context_group = group_of(key[first], groups)
    by_group = np.argsort(context_group, kind="stable")
    per = np.bincount(context_group, minlength=groups)
    local = np.empty(len(contents), dtype=np.int64)
    local[by_group] = np.arange(len(contents)) - np.repeat(np.cumsum(per) - per, per)
    told = np.nonzero(times[of] > 1)[0]
    # Places: the first of each context with its number, and all of those that the batch has again as repeated.
    where = np.concatenate([first, told])
    group = np.concatenate([context_group, row[told] % groups])
    numbers = np.concatenate([local, np.full(len(told), -1)])
    bits = np.concatenate([size[first], -size[told]])
    order = np.argsort(group, kind="stable")
    ids, places = np.unique(group[order], return_counts=True)
    entries = entries_at(batch, row[where[order]], start[where[order]], bits[order])
    columns = {n: lists_of(entries[n], places, entries[n].type) for n in ENTRY}
    columns["of"] = lists_of(pa.array(numbers[order], pa.int32()), places, pa.int32())
    columns["key"] = lists_of(longs(key[first][by_group]), per[ids], pa.int64())
    columns["known"] = lists_of(pa.array((times > 1)[by_group].astype(np.int8)), per[ids], pa.int8())
    columns["size"] = lists_of(pa.array([len(contents[i]) // 8 for i in by_group.tolist()], pa.int32()), per[ids], pa.int32())
    pack, at, packed = zstandard.ZstdCompressor(level=1), 0, []
    for n in per[ids].tolist():
        packed.append(pack.compress(b"".join([contents[i] for i in by_group[at : at + n].tolist()])))
        at += n
    columns["content"] = pa.array(packed, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *columns.values()], names=["group", *columns])


def internal_nodes(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """``(depth, first leaf, last leaf)`` of a subtree's internal nodes of ``least`` depth or more, children before parents.

    ``lcp[i]`` is the common depth of the sorted suffixes ``i - 1`` and ``i``. The stack holds the nodes on the way to the last leaf.
    """
    stack = [(0, 0)]
    for i, common in enumerate([*lcp[1:], 0], 1):
        left = i - 1
        while stack[-1][0] > common:
            deep, left = stack.pop()
            if deep >= least:
                yield deep, left, i - 1
        if stack[-1][0] < common:
            stack.append((common, left))


def deep_leaves(contexts: list[np.ndarray], depth: int) -> np.ndarray:
    """For each suffix of ``depth`` words or more of each context, in order, the number of the deep node it hangs below, or -1.

    Depths are counted up to ``depth``: what branches further down has the same leaves above it.
    """
    sizes = np.array([len(c) for c in contexts])
    names = np.unique(np.concatenate(contexts), return_inverse=True)[1] + 2
    begin = np.cumsum(sizes + 1) - sizes - 1  # a one stands behind each context
    text = np.ones(int(sizes.sum()) + len(sizes) + depth, dtype=np.int64)
    text[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(names))] = names
    leaves = sizes - depth + 1
    starts = np.repeat(begin - (np.cumsum(leaves) - leaves), leaves) + np.arange(leaves.sum())
    order = np.argsort(suffix_ranks(text[: len(text) - depth])[starts])
    at = starts[order]
    lcp, same = np.zeros(len(at), dtype=np.int64), np.ones(max(0, len(at) - 1), dtype=bool)
    for k in range(depth):
        same &= text[at[1:] + k] == text[at[:-1] + k]
        lcp[1:] += same
    out = np.full(len(at), -1, dtype=np.int64)
    for number, (_, a, b) in enumerate(internal_nodes(lcp.tolist(), depth)):
        out[order[a : b + 1]] = number
    return out


def _subtrees(key: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Contexts in the order of their prefixes, cut between two prefixes whenever ``SUBTREE_WORDS`` words have come together."""
    order = np.argsort(key, kind="stable")
    at, total = 0, 0
    for i in range(len(order)):
        if total >= SUBTREE_WORDS and key[order[i]] != key[order[i - 1]]:
            yield order[at:i]
            at, total = i, 0
        total += int(sizes[order[i]])
    if len(order):
        yield order[at:]


def _deep_nodes(table: pa.Table, depth: int) -> pa.Table:
    """Runs of suffixes that hang below a deep node with other leaves: ``(id, mark, start, bits = length)``."""
    number: dict[bytes, int] = {}  # distinct contexts, also where several batches have sent one
    unpack = zstandard.ZstdDecompressor()
    same = np.array(
        [
            number.setdefault(whole[8 * (b - n) : 8 * b], len(number))
            for row, sizes in zip(table.column("content").to_pylist(), table.column("size").to_pylist(), strict=True)
            for whole in (unpack.decompress(row),)
            for n, b in zip(sizes, np.cumsum(sizes, dtype=np.int64).tolist(), strict=True)
        ],
        dtype=np.int64,
    )
    contexts = [np.frombuffer(c, dtype=np.uint64) for c in number]
    key = np.zeros(len(contexts), dtype=np.int64)
    key[same] = numbers_of(table, "key")
    # A context that a batch has twice, or that two batches have, repeats as a whole.
    many = np.bincount(same, minlength=len(contexts)) > 1
    many[same[numbers_of(table, "known") > 0]] = True
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    leaves = sizes - depth + 1
    first = np.cumsum(leaves) - leaves
    repeats = np.repeat(many, leaves)
    # Suffixes of one context have their anchor at different places, so they differ: only contexts that share a prefix make a subtree.
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    several = np.nonzero(times[which] > 1)[0]
    for some in _subtrees(key[several], sizes[several]):
        some = several[some]
        n = leaves[some]
        node = deep_leaves([contexts[i] for i in some.tolist()], depth)
        repeats[np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())] |= node >= 0
    # Numbers of contexts are those inside each sent row; add the contexts of the rows before it.
    rows = np.array([len(x) for c in table.column("key").chunks for x in c])
    entries = np.array([len(x) for c in table.column("of").chunks for x in c])
    of = numbers_of(table, "of") + np.repeat(np.cumsum(rows) - rows, entries)
    size, start = numbers_of(table, "bits"), numbers_of(table, "start")
    sent = np.nonzero(size > 0)[0]
    n = size[sent]
    place = np.repeat(sent, n)
    step = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
    found = repeats[first[same[of[place]]] + step]
    place, word = place[found], (start[place] + step)[found]
    heads, length = runs_of(place, next_to=word)
    told = np.nonzero(size < 0)[0]
    take = pa.array(np.concatenate([place[heads], told]), pa.int64())
    return pa.table(
        {
            "id": flat(table, "id").take(take),
            "mark": flat(table, "mark").take(take),
            "start": pa.array(np.concatenate([word[heads], start[told]]), pa.int32()),
            "bits": pa.array(np.concatenate([length, -size[told]]), pa.int32()),
        }
    )


def kept_words(text: str | None, starts: list[int] | None, sizes: list[int] | None, depth: int) -> tuple[int, list[bytes]]:
    """Number of words, and those not covered by a repeated suffix's first ``depth`` words."""
    words = (text or "").encode().split()
    gone = covered(len(words), starts, sizes, depth)
    return len(words), [words[i] for i in np.nonzero(~gone)[0].tolist()] if gone.any() else words


def _cut(batches: Iterator[pa.RecordBatch], depth: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, starts, sizes in zip(*[batch[c].to_pylist() for c in ("text", "starts", "sizes")], strict=True):
            n, kept = kept_words(text, starts, sizes, depth)
            left = b" ".join(kept)
            rows.append((n, n - len(kept), hashlib.sha256(left).hexdigest(), left.decode() if with_text else None))
        n, removed, digest, left = zip(*rows, strict=True) if rows else ((), (), (), ())
        columns = [batch["id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
        names = ["id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            columns, names = [*columns, pa.array(left, pa.string())], [*names, "kept_text"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def cut_repeats(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = DEPTH,
    gram: int = GRAM,
    hot: int = HOT,
    with_text: bool = True,
) -> DataFrame:
    """``(id, n_words, n_removed, kept_sha256, kept_text)`` of every row; the text is what is left, joined by spaces."""
    texts = texts_of(df, id_col, text_col)
    id_type, groups = df.schema[id_col].dataType.simpleString(), groups_for(df)
    anchored, often = counted_anchors(texts, symbols, depth, gram, BATCH_WORDS, hot)
    suffixes = anchored.mapInArrow(
        lambda it: _send_contexts(it, depth, gram, groups, often),
        f"group int, {place_lists(id_type)}, of array<int>, key array<long>, known array<tinyint>, size array<int>, content binary",
    )
    runs = suffixes.groupBy("group").applyInArrow(
        lambda table: _deep_nodes(table, depth), f"id {id_type}, mark int, start int, bits int"
    )
    schema = f"id {id_type}, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    done = with_runs(texts, runs).mapInArrow(lambda it: _cut(it, depth, with_text), schema)
    return done.withColumnRenamed("id", id_col)
