"""Whitening against numpy's eigenvectors and exact integer sums."""

import math
import random

import numpy as np
import pytest
from labelflow.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, id string, vec int, component int, n string, whitened int"
EXTRA = ("x", 1, 2, "y", 3)


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, *EXTRA) for i, v in rows], SCHEMA).repartition(parts)


def plain(rows):
    """Ids, scaled entries and exact deviations of the usable rows."""
    used = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in used), default=0)
    x = [[math.floor(64 * c) + 1_000_000 for c in v] + [1_000_000] * (d - len(v)) for _, v in used]
    n, sums = len(x), [sum(column) for column in zip(*x)]
    return [i for i, _ in used], x, [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]


def checked(spark, rows, most=32):
    ids, x, deviation = plain(rows)
    got = W.whitened_rows(table(spark, rows), most=most).collect()
    centred = np.array(x, dtype=float) - np.array([sum(c) / len(x) for c in zip(*x)])
    cov = centred.T @ centred / len(x)
    values = np.linalg.eigvalsh(cov)[::-1][:most]
    assert sorted(((r.vec_id, r.deviation) for r in got if r.component == 1), key=repr) == sorted(zip(ids, deviation, strict=True), key=repr)
    assert len(got) == len(x) * min(most, len(x[0])) and {r.n for r in got} == {len(x)}
    explained = {r.component: r.explained for r in got}
    assert [explained[k + 1] for k in range(len(values))] == pytest.approx(values / np.trace(cov), rel=1e-9, abs=1e-12)
    assert max(r.identity_error for r in got) < 1e-9
    return got, centred, values


def test_random_vectors_match_numpy(spark):
    rng = np.random.default_rng(3)
    rows = list(enumerate((rng.normal(size=(200, 12)) * np.linspace(1, 3, 12) + 5).tolist()))
    got, centred, values = checked(spark, rows, most=7)
    vectors = np.linalg.eigh(centred.T @ centred / len(centred))[1][:, ::-1][:, :7]
    expected = centred @ vectors / np.sqrt(values)
    found = np.zeros_like(expected)
    for r in got:
        found[r.vec_id, r.component - 1] = r.whitened
    sign = np.sign((expected * found).sum(axis=0))
    assert np.abs(expected * sign - found).max() < 1e-9


def test_nulls_ragged_repeated_and_clashing(spark):
    rng = random.Random(5)
    vector = lambda n: [rng.uniform(-2, 2) for _ in range(n)]
    rows = [(i, vector(5)) for i in range(40)]
    rows += [(None, vector(5)), (3, rows[3][1]), (3, rows[3][1]), (50, None), (51, [1.0, None, 1.0, 1.0, 1.0])]
    rows += [(52, [float("nan"), 1.0, 0.0, 0.0, 0.0]), (53, [float("inf")] * 5), (54, []), (55, vector(2))]
    got, _, _ = checked(spark, rows)
    assert {r.vec_id for r in got} & {50, 51, 52, 53} == set() and {54, 55, None} <= {r.vec_id for r in got}


def test_equal_and_zero_variances(spark):
    corners = [[float(s * (i == k)) for k in range(4)] + [0.25, 0.0] for i in range(4) for s in (1, -1)]
    rows = list(enumerate(corners))
    got, _, values = checked(spark, rows)
    assert values[:4] == pytest.approx([values[0]] * 4)
    assert {r.component for r in got if r.whitened is None} == {5, 6}
    for a in range(1, 5):
        for b in range(1, 5):
            w = lambda k: np.array([r.whitened for r in sorted((r for r in got if r.component == k), key=lambda r: r.vec_id)])
            assert (w(a) * w(b)).mean() == pytest.approx(float(a == b), abs=1e-9)


def test_one_value_and_empty_tables(spark):
    got = W.whitened_rows(table(spark, [(i, [1.5, 2.5]) for i in range(3)])).collect()
    assert [(r.deviation, r.whitened, r.explained) for r in got] == [(0, None, 0.0)] * 6
    assert W.whitened_rows(table(spark, [(1, None)])).count() == 0
    assert W.whitened_rows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_entries_stay_exact(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1e9, 1e9) for _ in range(3)]) for i in range(30)]
    got, _, _ = checked(spark, rows)
    assert len(got) == 90
    y = np.array([[rng.randrange(-(1 << 45), 1 << 45) for _ in range(3)] for _ in range(300)])
    exact = [[sum(int(r[i]) * int(r[j]) for r in y) for j in range(3)] for i in range(3)]
    assert W.gram(y).tolist() == exact


def test_polynomial_and_roots_are_exact():
    rng = random.Random(2)
    a = [[rng.randrange(-50, 50) for _ in range(6)] for _ in range(6)]
    gram = [[sum(x * y for x, y in zip(r, s)) for s in a] for r in a]
    primes = W.primes_beyond(2 * W.coefficient_bound(gram))
    c = W.chinese({p: W.charpoly_mod(gram, p) for p in primes})
    numeric = np.poly(np.array(gram, dtype=float))[::-1]
    assert c[-1] == 1 and c[-2] == -sum(gram[i][i] for i in range(6))
    assert [float(x) for x in c] == pytest.approx(list(numeric), rel=1e-6)
    roots = [W._ratio(m, t, 1) for m, t, _ in W.largest_roots(c, 6)]
    assert roots == pytest.approx(np.linalg.eigvalsh(np.array(gram, dtype=float))[::-1], rel=1e-9)
