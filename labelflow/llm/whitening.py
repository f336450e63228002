"""Embedding whitening from the exact characteristic polynomial of the integer scatter matrix.

Entries become integers, ``floor(64 * c) + 1000000``. The scatter ``n * sum(x x') - S S'`` is an integer matrix, ``n ** 2`` times the covariance, that
Spark sums exactly; a constant added to all entries cancels in it, so the sums are taken over ``floor(64 * c)``. From there on
work grows with the dimension only, and is dealt over Spark tasks:

1. the characteristic polynomial modulo many 31-bit primes, a task for some primes: Hessenberg reduction, then the
   recurrence over leading blocks; Chinese remainders give the integer coefficients, as many primes as their bound needs;
2. its roots: they are real, so the sign changes of the polynomial moved to a point count the roots beyond that point, with multiplicity.
   Bisection isolates each root, and signs at dyadic points refine it to ``ROOT_BITS`` significant bits;
3. the null space of each shifted matrix by inverse iteration in ``WORK_BITS`` fixed-point, a task for some roots. Roots that agree in ``SAME_BITS`` bits are
   one root of a higher multiplicity, with an orthonormal basis of its null space.

The rows are scanned once for the sums, twice for the error of the whitened covariance, and once for the result. What reaches the
driver is of the size of the matrix and of the polynomial, whatever the number of rows.

Defined cases: rows whose vector is null or holds a null or non-finite entry are left out; shorter vectors count as padded with zeros up to the longest
one; null ids, equal rows and equal ids each get their own rows; a table without usable vectors gives no rows. A component of
variance zero has no whitened value (null) and explains 0; of equal variances any orthonormal basis is right. Entries of ``2 ** 40`` or
more are an error, since sums would pass 38 digits. ``deviation`` is a long while its bound fits one, else a decimal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import comb, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
ROOT_BITS = 160
SAME_BITS = 128
WORK_BITS = 384
LARGEST = 1 << 46  # of a scaled entry
LIMB = 23


@dataclass(frozen=True)
class Whitening:
    """Number of fitted rows, sums per dimension of the scaled entries, and unit vectors (rows) by falling variance."""

    n: int
    sums: tuple[int, ...]
    span: int
    variances: tuple[float, ...]
    explained: tuple[float, ...]
    vectors: tuple[tuple[float, ...], ...]


# Rows


def scaled(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``floor(64 * c)`` of the usable vectors, one per row, and which rows those are."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    row = np.repeat(np.arange(len(lengths)), lengths)
    bad = np.bincount(row[~np.isfinite(values)], minlength=len(lengths)) > 0
    kept = column.is_valid().to_numpy(zero_copy_only=False) & ~bad
    width = dims if dims is not None else int(lengths[kept].max(initial=0))
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    wide = np.zeros((len(lengths), width))
    use = kept[row]
    wide[row[use], place[use]] = np.floor(SCALE * values[use])
    wide = wide[kept]
    if np.abs(wide).max(initial=0) >= LARGEST:
        raise ValueError(f"entries of {LARGEST // SCALE} or more cannot be summed exactly")
    return wide.astype(np.int64), kept


def gram(y: np.ndarray) -> np.ndarray:
    """Exact sums of products of the columns, as Python integers. Each float product stays below 2 ** 53."""
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    top = int(np.abs(y).max(initial=0))
    limbs = [y] if top < 1 << LIMB else [y & ((1 << LIMB) - 1), y >> LIMB]
    most = min(top, 1 << LIMB) + 1
    step = max(1, (1 << 53) // (most * most))
    for at in range(0, len(y), step):
        parts = [x[at : at + step].astype(np.float64) for x in limbs]
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                total += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(i, j, v)`` of a partition: sums of products, sums at ``j = -1``, range at ``-2`` and ``-3``, and rows at ``(-1, -1)``."""
    n, sums, total, low, high = 0, np.zeros(0, dtype=object), np.zeros((0, 0), dtype=object), 0, 0
    for batch in batches:
        y, _ = scaled(batch["vec"])
        n, d = n + len(y), max(len(sums), y.shape[1])
        y = np.pad(y, ((0, 0), (0, d - y.shape[1])))
        old, old_sums = len(sums), sums
        sums, products = y.sum(axis=0).astype(object), gram(y)
        sums[:old] += old_sums
        products[:old, :old] += total
        total = products
        low, high = min(low, int(y.min(initial=0))), max(high, int(y.max(initial=0)))
    i, j = np.triu_indices(len(sums))
    d = len(sums)
    rows = [*zip(i.tolist(), j.tolist(), total[i, j]), *((k, -1, s) for k, s in enumerate(sums)), (-1, -1, n), (-1, -2, low), (-1, -3, high)]
    columns = list(zip(*rows, strict=True))
    yield pa.RecordBatch.from_pydict(
        {
            "i": pa.array(columns[0], pa.int32()),
            "j": pa.array(columns[1], pa.int32()),
            "v": pa.array([Decimal(int(v)) for v in columns[2]], pa.decimal128(38, 0)),
        }
    )


def moments(vectors: DataFrame) -> tuple[int, list[int], list[list[int]], int]:
    """Rows, sums, scatter matrix ``n * sum(y y') - S S'`` and range of entries of the column ``vec``."""
    found = vectors.mapInArrow(_moments, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(
        F.sum("v").alias("s"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    cells = {(r["i"], r["j"]): r for r in found.collect()}  # half the matrix
    if not cells or not cells[-1, -1]["s"]:
        return 0, [], [], 0
    at = lambda i, j: int(cells[i, j]["s"])
    n, d = at(-1, -1), sum(1 for i, j in cells if i >= 0 and j == -1)
    sums = [at(i, -1) for i in range(d)]
    scatter = [[n * at(min(i, j), max(i, j)) - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    return n, sums, scatter, int(cells[-1, -3]["high"]) - int(cells[-1, -2]["low"])


# Characteristic polynomial


def is_prime(p: int) -> bool:
    """Right below 2 ** 31 with these witnesses."""
    if p % 2 == 0:
        return p == 2
    s = ((p - 1) & -(p - 1)).bit_length() - 1
    for a in (2, 3, 5, 7):
        x = pow(a, (p - 1) >> s, p)
        if x not in (1, p - 1) and all((x := x * x % p) != p - 1 for _ in range(s - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """31-bit primes, from above, whose product is larger than ``bound``."""
    out, product, p = [], 1, (1 << 31) + 1
    while product <= bound:
        p -= 2
        if is_prime(p):
            out.append(p)
            product *= p
    return out


def charpoly_mod(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients modulo ``p``, constant term first: reduction to Hessenberg form by similarity, then its leading blocks."""
    d = len(matrix)
    m = np.array([[x % p for x in row] for row in matrix], dtype=np.int64)
    for k in range(d - 2):
        rows = np.nonzero(m[k + 1 :, k])[0]
        if not len(rows):
            continue
        r = k + 1 + int(rows[0])
        if r != k + 1:
            m[[k + 1, r]] = m[[r, k + 1]]
            m[:, [k + 1, r]] = m[:, [r, k + 1]]
        f = m[k + 2 :, k] * pow(int(m[k + 1, k]), -1, p) % p
        m[k + 2 :] = (m[k + 2 :] - f[:, None] * m[k + 1] % p) % p
        m[:, k + 1] = (m[:, k + 1] + (m[:, k + 2 :] * f % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), dtype=np.int64)
    polys[0, 0] = 1
    for k in range(d):
        weight, product = np.zeros(k + 1, dtype=np.int64), 1
        for i in range(k, -1, -1):  # entries above the diagonal, each with the subdiagonals between
            weight[i] = int(m[i, k]) * product % p
            product = product * int(m[i, i - 1]) % p if i else product
        polys[k + 1] = (np.roll(polys[k], 1) - (weight[:, None] * polys[: k + 1] % p).sum(axis=0)) % p
    return polys[d].tolist()


def coefficient_bound(matrix: list[list[int]]) -> int:
    """No coefficient is larger: by Maclaurin's inequality for the roots, which are not negative."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    return max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))


def chinese(residues: dict[int, list[int]]) -> list[int]:
    """The integers, of either sign, that have these residues."""
    whole = 1
    for p in residues:
        whole *= p
    out = [0] * len(next(iter(residues.values())))
    for p, some in residues.items():
        weight = whole // p * pow(whole // p, -1, p)
        out = [(x + r * weight) % whole for x, r in zip(out, some, strict=True)]
    return [x - whole if 2 * x > whole else x for x in out]


def charpoly(spark, matrix: list[list[int]]) -> list[int]:
    primes = primes_beyond(2 * coefficient_bound(matrix))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"p": frame["p"], "c": [charpoly_mod(matrix, int(p)) for p in frame["p"]]})

    dealt = spark.createDataFrame([(p,) for p in primes], "p long").repartition(max(1, len(primes) // 4))
    return chinese({r["p"]: r["c"] for r in dealt.mapInPandas(run, "p long, c array<long>").collect()})


# Roots, as (m, t) for m * 2 ** t


def _moved(c: list[int], m: int, t: int) -> list[int]:
    """Coefficients, up to positive factors, of the polynomial with the point ``m * 2 ** t`` as its origin."""
    d = len(c) - 1
    q = c if t >= 0 else [x << (-t * (d - k)) for k, x in enumerate(c)]
    a = m << t if t >= 0 else m
    q = list(q)
    for k in range(d):
        for i in range(d - 1, k - 1, -1):
            q[i] += a * q[i + 1]
    return q


def roots_above(c: list[int], m: int, t: int) -> int:
    """Roots beyond the point, with multiplicity: as many as sign changes, since all roots are real."""
    signs = [x > 0 for x in _moved(c, m, t) if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def sign_at(c: list[int], m: int, t: int) -> int:
    d, value = len(c) - 1, 0
    if t >= 0:
        for x in reversed(c):
            value = value * (m << t) + x
    else:
        for k in range(d, -1, -1):
            value = value * m + (c[k] << (-t * (d - k)))
    return (value > 0) - (value < 0)


def largest_roots(c: list[int], wanted: int) -> list[tuple[int, int, int]]:
    """``(m, t, multiplicity)`` of the largest positive roots, falling, until ``wanted`` are covered. All roots are real and none is negative."""
    while c and c[0] == 0:
        c = c[1:]
    top = sum(abs(x) for x in c[-2:-1]).bit_length()  # the sum of all roots
    out: list[tuple[int, int, int]] = []
    # Parts (m * 2 ** t, (m + 1) * 2 ** t] with the roots beyond their lower and their upper end.
    todo = [(0, top, len(c) - 1, 0)] if len(c) > 1 else []
    while todo and sum(r[2] for r in out) < wanted:
        m, t, above, beyond = todo.pop()
        inside = above - beyond
        if not inside:
            continue
        if inside == 1:
            out.append((*_refined(c, m, t), 1))
        elif m.bit_length() > SAME_BITS:
            out.append((2 * m + 1, t - 1, inside))
        else:
            middle = roots_above(c, 2 * m + 1, t - 1)
            todo += [(2 * m, t - 1, above, middle), (2 * m + 1, t - 1, middle, beyond)]
    return out


def _refined(c: list[int], m: int, t: int) -> tuple[int, int]:
    """Bisection of the part's only root until it has ``ROOT_BITS`` bits."""
    high = sign_at(c, m + 1, t)
    if high == 0:
        return m + 1, t
    while m.bit_length() < ROOT_BITS:
        s = sign_at(c, 2 * m + 1, t - 1)
        if s == 0:
            return 2 * m + 1, t - 1
        m, t = 2 * m + (s != high), t - 1
    return 2 * m + 1, t - 1


# Components


def null_space(matrix: list[list[int]], m: int, t: int, multiplicity: int) -> list[list[float]]:
    """Orthonormal vectors that the matrix stretches by the root, from two steps of inverse iteration in fixed-point numbers."""
    d = len(matrix)
    root = (m << (WORK_BITS + t)) if WORK_BITS + t >= 0 else (m >> -(WORK_BITS + t))
    a = np.array([[x << WORK_BITS for x in row] for row in matrix], dtype=object)
    a[np.arange(d), np.arange(d)] -= root
    order = list(range(d))
    for k in range(d):  # rows with factors below the diagonal
        pivot = max(range(k, d), key=lambda r: abs(a[r, k]))
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
            order[k], order[pivot] = order[pivot], order[k]
        a[k, k] = a[k, k] or 1
        if k + 1 < d:
            f = (a[k + 1 :, k] << WORK_BITS) // a[k, k]
            a[k + 1 :, k + 1 :] -= (f[:, None] * a[k, k + 1 :]) >> WORK_BITS
            a[k + 1 :, k] = f

    def solved(b: np.ndarray) -> np.ndarray:
        x = b[order].copy()
        for k in range(d - 1):
            x[k + 1 :] -= (a[k + 1 :, k] * x[k]) >> WORK_BITS
        for k in range(d - 1, -1, -1):
            x[k] = (x[k] << WORK_BITS) // a[k, k]
            x[:k] -= (a[:k, k] * x[k]) >> WORK_BITS
        return unit(x)

    def unit(x: np.ndarray) -> np.ndarray:
        length = isqrt(int((x * x).sum())) or 1
        return (x << WORK_BITS) // length

    rng = np.random.default_rng(1)
    basis: list[np.ndarray] = []
    for _ in range(multiplicity):
        x = np.array(rng.integers(1, 1 << 30, d).tolist(), dtype=object) << (WORK_BITS - 30)
        for _ in range(2):
            x = solved(x)
            for _ in range(2):
                for v in basis:
                    x = x - (v * (int((v * x).sum()) >> WORK_BITS) >> WORK_BITS)
            x = unit(x)
        basis.append(x)
    out = []
    for v in basis:
        most = max(range(d), key=lambda i: abs(v[i]))
        sign = 1 if v[most] > 0 else -1
        out.append([sign * int(x) / (1 << WORK_BITS) for x in v])
    return out


def components(spark, matrix: list[list[int]], roots: list[tuple[int, int, int]]) -> list[list[float]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [null_space(matrix, int(m), t, k) for m, t, k in zip(frame["m"], frame["t"], frame["k"], strict=True)]
            yield pd.DataFrame({"at": frame["at"], "v": found})

    rows = [(i, str(m), t, k) for i, (m, t, k) in enumerate(roots)]
    dealt = spark.createDataFrame(rows, "at int, m string, t int, k int").repartition(max(1, len(rows) // 2))
    found = {r["at"]: r["v"] for r in dealt.mapInPandas(run, "at int, v array<array<double>>").collect()}
    return [list(v) for i in range(len(roots)) for v in found[i]]


def _ratio(m: int, t: int, by: int) -> float:
    return m / (by << -t) if t < 0 else (m << t) / by


def fit(df: DataFrame, vec_col: str = "embedding", most: int = COMPONENTS) -> Whitening:
    """Learn the whitening of the column's vectors."""
    spark = df.sparkSession
    n, sums, matrix, span = moments(df.select(named(df, vec_col).alias("vec")))
    wanted = min(most, len(sums))
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    if not n or not wanted or not trace:
        return Whitening(n, tuple(sums), span, (0.0,) * wanted, (0.0,) * wanted, ((0.0,) * len(sums),) * wanted)
    roots = largest_roots(charpoly(spark, matrix), wanted)
    vectors = components(spark, matrix, roots)
    each = [(m, t) for m, t, k in roots for _ in range(k)][:wanted]
    missing = wanted - len(each)
    return Whitening(
        n,
        tuple(sums),
        span,
        (*[_ratio(m, t, n * n) for m, t in each], *[0.0] * missing),
        (*[_ratio(m, t, trace) for m, t in each], *[0.0] * missing),
        (*[tuple(v) for v in vectors[:wanted]], *[(0.0,) * len(sums)] * missing),
    )


def _projected(y: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened values of scaled rows; components without variance give 0."""
    centred = _centred(y, model).astype(np.float64) / model.n
    deviation = np.sqrt(np.array(model.variances))
    return centred @ np.array(model.vectors).T / np.where(deviation > 0, deviation, 1.0)


def _centred(y: np.ndarray, model: Whitening) -> np.ndarray:
    """``n * x - S``, exact."""
    if model.n * (model.span + 1) < 1 << 62:
        return model.n * y - np.array(model.sums, dtype=np.int64)
    return model.n * y.astype(object) - np.array(model.sums, dtype=object)


def identity_error(df: DataFrame, model: Whitening, vec_col: str = "embedding") -> float:
    """Largest entry, in size, of the whitened rows' covariance minus the identity, over components with variance."""
    some = sum(v > 0 for v in model.variances)
    if not some:
        return 0.0
    vectors, d = df.select(named(df, vec_col).alias("vec")), len(model.sums)

    def summed(mean: np.ndarray | None) -> dict:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(some if mean is None else (some, some))
            for batch in batches:
                w = _projected(scaled(batch["vec"], d)[0], model)[:, :some]
                total += w.sum(axis=0) if mean is None else (w - mean).T @ (w - mean)
            cells = np.indices(total.shape).reshape(total.ndim, -1)
            k, m = cells[0], cells[-1]
            yield pa.RecordBatch.from_pydict({"k": pa.array(k, pa.int32()), "m": pa.array(m, pa.int32()), "v": total.ravel()})

        found = vectors.mapInArrow(run, "k int, m int, v double").groupBy("k", "m").agg(F.sum("v").alias("v"))
        return {(r["k"], r["m"]): r["v"] / model.n for r in found.collect()}

    means = summed(None)
    cells = summed(np.array([means[k, k] for k in range(some)]))
    return max(abs(v - (k == m)) for (k, m), v in cells.items())


def whiten(df: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, deviation, whitened)`` of every usable row: the exact sum of ``(n * x - S) ** 2``, and one value per component."""
    d = len(model.sums)
    wide = d * (model.n * (model.span + 1)) ** 2 >= 1 << 63
    kind = "decimal(38,0)" if wide else "long"
    empty = [v == 0 for v in model.variances]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, kept = scaled(batch["vec"], d)
            c = _centred(y, model)
            c = c.astype(object) if wide else c
            total = (c * c).sum(axis=1)
            deviation = pa.array([Decimal(int(x)) for x in total], pa.decimal128(38, 0)) if wide else pa.array(total.astype(np.int64), pa.int64())
            w = _projected(y, model)
            gone = np.broadcast_to(np.array(empty, dtype=bool), w.shape).ravel()
            values = pa.array(w.ravel(), pa.float64(), mask=gone)
            offsets = pa.array(np.arange(len(y) + 1) * len(model.variances), pa.int32())
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch["id"].filter(pa.array(kept)),
                    "deviation": deviation,
                    "whitened": pa.ListArray.from_arrays(offsets, values),
                }
            )

    rows = df.select(named(df, id_col).alias("id"), named(df, vec_col).alias("vec"))
    return rows.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, deviation {kind}, whitened array<double>")


def whitened_rows(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: ``id, component, n, deviation, whitened, explained, identity_error``."""
    model = fit(df, vec_col, most)
    error = identity_error(df, model, vec_col)
    explained = F.array(*[F.lit(v) for v in model.explained]).cast("array<double>")
    rows = whiten(df, model, id_col, vec_col).select(F.col("id").alias(id_col), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        id_col,
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
