"""Substring trees, suffix arrays and line dedup against brute force."""

import random

import numpy as np
import pytest
from labelflow.llm import line_dedup, repeats, substring_trees, suffix_array

from . import brute


def by_id(df, *columns):
    return sorted([tuple(r[c] for c in columns) for r in df.collect()], key=repr)


@pytest.mark.parametrize("hot", [1, 4096])
def test_substring_trees(with_null_ids, hot):
    df, rows = with_null_ids
    got = substring_trees.cut_repeats(df, depth=35, hot=hot)
    expected = [
        (i, n, n - len(kept), " ".join(kept), brute.sha256(" ".join(kept)))
        for (i, _), (n, kept) in zip(rows, brute.without_repeats(rows, 35), strict=True)
    ]
    assert by_id(got, "doc_id", "n_words", "n_removed", "kept_text", "kept_sha256") == sorted(expected, key=repr)


@pytest.mark.parametrize("hot", [1, 4096])
def test_suffix_array(with_null_ids, hot):
    df, rows = with_null_ids
    got = suffix_array.cut_later_copies(df, depth=50, hot=hot)
    expected = [
        (i, n, n - len(kept), spans, kept, brute.sha256(kept))
        for (i, _), (n, spans, kept) in zip(rows, brute.without_copies(rows, 50), strict=True)
    ]
    got = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in by_id(
        got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_bytes", "kept_sha256"
    )]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_suffix_ranks_of_small_strings():
    rng = random.Random(1)
    for _ in range(1500):
        s = [rng.randint(1, rng.choice([1, 2, 3, 200])) for _ in range(rng.randint(1, 40))]
        order = [int(i) for i in np.argsort(suffix_array.suffix_ranks(np.array(s)))]
        assert order == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_ranks_of_long_strings():
    """More places than 21 bits can number, mostly of one period, so that names repeat down the recursion."""
    rng = np.random.default_rng(5)
    s = np.tile(rng.integers(1, 200, 5000), 700)
    s[rng.integers(0, len(s), 300)] = 250
    ranks = suffix_array.suffix_ranks(s)
    order = np.argsort(ranks)
    assert np.array_equal(np.sort(ranks), np.arange(len(s)))
    # Neighbours are in order if their first symbols are, and at a tie the suffixes behind them.
    a, b = order[:-1], order[1:]
    behind = np.append(ranks, -1)
    assert np.all((s[a] < s[b]) | ((s[a] == s[b]) & (behind[a + 1] < behind[b + 1])))


def test_hot_anchors_are_counted_over_all_documents(spark):
    """An anchor that no sample of documents can be relied on to show."""
    rng = random.Random(8)
    noise = lambda n: "".join(chr(rng.randint(97, 122)) for _ in range(n))
    shared = noise(60)
    rows = [(i, noise(80) + (shared if i < 12 else "") + noise(80)) for i in range(40)]
    texts = repeats.texts_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(12), "doc_id", "text")
    _, often = repeats.counted_anchors(texts, suffix_array.symbols, 50, 16, 10**6, 11)
    raw = suffix_array.symbols(shared)
    b = repeats.Batch([0], [raw], 50, 16)
    assert set(repeats.short_key(b.grams[np.unique(b.anchor)]).tolist()) <= set(often.tolist())
    assert len(repeats.counted_anchors(texts, suffix_array.symbols, 50, 16, 10**6, 12)[1]) == 0


def test_random_texts_over_few_symbols(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 25), "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 150)))) for _ in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = suffix_array.cut_later_copies(df, depth=9, gram=4, hot=3)
    cut = [(i, kept) for (i, _), (_, _, kept) in zip(rows, brute.without_copies(rows, 9), strict=True)]
    assert sorted((r.doc_id, bytes(r.kept_bytes)) for r in got.collect()) == sorted(cut)
    got = substring_trees.cut_repeats(df, depth=5, gram=2, hot=3)
    cut = [(i, " ".join(kept)) for (i, _), (_, kept) in zip(rows, brute.without_repeats(rows, 5), strict=True)]
    assert sorted((r.doc_id, r.kept_text) for r in got.collect()) == sorted(cut)


def test_line_dedup(odd, odd_rows):
    found, (n_lines, n_dropped, kept) = line_dedup.dedup_lines(odd)
    assert found.columns[: len(odd.columns)] == odd.columns
    got = by_id(found, "doc_id", n_lines, n_dropped, kept)
    expected = [(i, len(all_), len(all_) - len(left), "\n".join(left)) for i, left, all_ in brute.without_lines(odd_rows)]
    assert got == sorted(expected, key=repr)


def test_line_dedup_null_ids_come_last(spark):
    line = "a line of some length"
    df = spark.createDataFrame([(None, line), (3, line), (None, f"{line}\nx")], "doc_id long, text string")
    found, (_, n_dropped, _) = line_dedup.dedup_lines(df)
    assert by_id(found, "doc_id", n_dropped) == [(3, 0), (None, 1), (None, 1)]


def test_line_dedup_rows_that_share_an_id_lose_only_their_own_lines(spark):
    line, own = "a line of some length", "some unique first line\ny"
    df = spark.createDataFrame(
        [(3, line), (None, f"{line}\nx"), (None, own), (7, f"{line}\nx"), (7, own.replace("first", "other"))], "doc_id long, text string"
    )
    found, (_, _, kept) = line_dedup.dedup_lines(df)
    expected = [(3, line), (None, "x"), (None, own), (7, "x"), (7, own.replace("first", "other"))]
    assert by_id(found, "doc_id", kept) == sorted(expected, key=repr)


def test_line_bitmaps_are_sparse(spark):
    text = "\n".join(f"line number {i:06}" for i in range(1000))
    df = spark.createDataFrame([(1, text), (2, "other\n" * 500 + "line number 000007")], "doc_id long, text string")
    maps = line_dedup.drop_bitmaps(line_dedup.dropped_lines(df)).collect()
    assert [(r["_id"], r["_bits"]) for r in maps] == [(2, {500 // 64: 1 << 500 % 64})]


def test_empty_tables(none):
    assert substring_trees.cut_repeats(none).count() == 0
    assert suffix_array.cut_later_copies(none).count() == 0
    assert line_dedup.dedup_lines(none)[0].count() == 0


def test_internal_nodes_against_all_substrings():
    """Nodes of a small tree: every sequence with two followers or ends, and its leaves."""
    rng = random.Random(2)
    for _ in range(20):
        text = [rng.randint(0, 2) for _ in range(rng.randint(2, 40))] + [-1]
        suffixes = sorted(range(len(text)), key=lambda i: text[i:])
        common = lambda a, b: next(k for k in range(len(text)) if text[a + k] != text[b + k])
        lcp = [0] + [common(a, b) for a, b in zip(suffixes, suffixes[1:])]
        got = {(d, tuple(sorted(suffixes[a : b + 1]))) for d, a, b in substring_trees.internal_nodes(lcp, 1)}
        expected = set()
        for size in range(1, len(text)):
            places = {}
            for i in range(len(text) - size):
                places.setdefault(tuple(text[i : i + size]), []).append(i)
            expected |= {(size, tuple(at)) for at in places.values() if len({text[i + size] for i in at}) > 1}
        assert got == expected


def test_subtrees_stay_under_their_bound(monkeypatch):
    monkeypatch.setattr(substring_trees, "SUBTREE_WORDS", 100)
    rng = np.random.default_rng(0)
    key, sizes = rng.integers(0, 40, 300), rng.integers(35, 50, 300)
    parts = list(substring_trees._subtrees(key, sizes))
    assert sorted(np.concatenate(parts).tolist()) == list(range(300))
    largest = max(sizes[key == k].sum() for k in set(key.tolist()))
    assert all(sizes[p].sum() < 100 + largest for p in parts)
    assert all(len({*key[a].tolist()} & {*key[b].tolist()}) == 0 for a, b in zip(parts, parts[1:]))
