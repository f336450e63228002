"""Ranked search against scores of every document, one by one."""

import math
import random
import re
import string

import pytest
from labelflow.llm import lexical_search as S

from .conftest import EXTRA, SCHEMA, sentence

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_search(docs, items, top):
    terms = [TERM.findall((t or "").translate(LOWER)) for _, t in docs]
    n, length = sum(bool(t) for t in terms), sum(map(len, terms))
    held = {}
    for some in terms:
        for t in set(some):
            held[t] = held.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for (doc, _), some in zip(docs, terms, strict=True):
            m = 75 + 25 * len(some) * n // length if length else 0
            score = 0
            for t in TERM.findall((text or "").translate(LOWER)):
                if tf := some.count(t):
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) * (10**9 * tf // (1000 * tf + 12 * m))
            if score:
                scored.append((-score, doc is None, doc, score))
        best = sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top]
        out += [(item, i + 1, doc, score) for i, (_, _, doc, score) in enumerate(best)]
    return out


def found(spark, df, items, path, top=20, block_chars=S.BLOCK_CHARS, query_chars=S.QUERY_CHARS):
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = S.search(spark, S.write_index(df, path, block_chars=block_chars), asked, top=top, query_chars=query_chars)
    return [(r.item_id, r.rank, r.doc_id, r.score) for r in got.select("item_id", "rank", "doc_id", "score").collect()]


def same(a, b):
    return sorted(a, key=repr) == sorted(b, key=repr)


def test_odd_rows(spark, odd, odd_rows, tmp_path):
    items = [(1, odd_rows[5][1]), (2, "w1 W2 w1, unheard"), (3, None), (4, "!!!"), (None, "é 漢字 token"), (6, "many documents hold"), (1, "w7")]
    assert same(found(spark, odd, items, f"{tmp_path}/a", top=5), plain_search(odd_rows, items, 5))


@pytest.mark.parametrize("block_chars", [300, 5_000])
def test_many_blocks_and_ties(spark, tmp_path, block_chars):
    rng = random.Random(4)
    docs = [(i, sentence(rng, rng.randint(1, 60), 150)) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(60)] + [(None, docs[3][1]), (None, docs[5][1]), (7, docs[7][1])]
    items = [(i, sentence(rng, rng.randint(1, 25), 170)) for i in range(30)] + [(99, docs[3][1])]
    df = spark.createDataFrame([(i, t, *EXTRA) for i, t in docs], SCHEMA).repartition(3)
    for query_chars in (200, S.QUERY_CHARS):
        got = found(spark, df, items, f"{tmp_path}/b{query_chars}", 20, block_chars, query_chars)
        assert same(got, plain_search(docs, items, 20))


def test_empty_tables(spark, none, odd, tmp_path):
    assert found(spark, none, [(1, "a")], f"{tmp_path}/c") == []
    assert found(spark, odd, [], f"{tmp_path}/d") == []
    assert found(spark, odd.where("doc_id <= 3"), [(1, "a")], f"{tmp_path}/e") == []


def test_pair_bounds_skip_more_than_term_bounds():
    """Two rare terms that never meet: the pair's bound keeps both out of the essential units."""
    import pyarrow as pa
    import numpy as np

    asked = S.Queries([0], [S.Counter({"a": 1, "b": 1})])
    asked.weigh({"a": 2, "b": 2}, 4, 40)
    u16 = lambda *x: np.array(x, dtype=np.uint16).tobytes()
    u32 = lambda *x: np.array(x, dtype=np.uint32).tobytes()
    rows = [(None, np.array([10] * 4, dtype=np.int64).tobytes(), None), ("a", u16(0, 1), u32(1, 1)), ("b", u16(2, 3), u32(1, 1))]
    table = pa.table({c: [r[i] for r in rows] for i, c in enumerate(("term", "places", "counts"))})
    postings = S._Postings(table, asked)
    most, reached = S.pair_bounds(postings, asked, 2)
    (bound, terms), = S.units_of(0, asked, postings, most)
    assert most == {} and len(terms) == 2 and bound == reached[0][1]
    docs, score = S.search_block(0, asked, postings, most, bound + 1, 2)
    assert not len(docs) and not len(score)


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(["Ab", "c-d"] * 500)
    whole = S.terms_of(text)
    monkeypatch.setattr(S, "PIECE", 64)
    assert S.terms_of(text) == whole == {b"ab": 500, b"c": 500, b"d": 500}
