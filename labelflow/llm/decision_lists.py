"""Quality rules as learned decision lists.

Sequential covering over labelled statistics: one rule after another is grown as a conjunction of thresholds
(FOIL gain on the growing part), pruned from its end (on the pruning part), kept if it is precise enough there, and
the rows it covers are taken away. The result is an ordered ``CASE WHEN`` over text statistics, so that applying it
is a narrow, codegen-friendly projection without a shuffle.

The learner never sees rows. Spark counts labelled rows per cell of a grid of thresholds, which has at most
``(THRESHOLDS + 1) ** len(FEATURES)`` cells however many rows there are, and the covering works on those counts.
Statistics for the fit are computed for about ``fit_rows`` labelled rows, picked by a hash of the id.

Defined cases: a null text is an empty text; a text without words has zero statistics and fails the base rule; rows
without a label, with a null label or an id that is null do not take part in the fit; without labelled rows of
both kinds the list is empty and only the base rule decides. Repeated rows count as often as they occur. All
columns of the input, whatever their names, are kept by :func:`filter_quality`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, named, where_computed, whole_text, word_array

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate"]
THRESHOLDS = 8
FIT_ROWS = 20_000


def _without(c: Column, characters: str) -> Column:
    return F.translate(c, characters, "")


def with_statistics(df: DataFrame, text_col: str, names: list[str]) -> DataFrame:
    """``df`` and the five base statistics of the whole text, under the given names.

    Repeated word triples are found by sorting one document's triple hashes; documents without any repeat, most of
    them, are recognised by a hash set and skip the sort. Nothing is exploded and nothing is shuffled.
    """
    words, lines, triples, ranked, starts = fresh(df, "_words", "_lines", "_triples", "_ranked", "_starts")
    columns = [named(df, c) for c in df.columns]
    text = whole_text(named(df, text_col))
    one = df.select(
        *columns,
        word_array(text).alias(words),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)).alias(lines),
        (F.length(text) - F.length(_without(text, "#*$%&|<>"))).cast("long").alias(names[2]),
    )
    w = F.col(words)
    hashes = F.when(
        F.size(w) > 2,
        F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
        ),
    )
    two = one.select("*", hashes.alias(triples))
    t = F.col(triples)
    three = two.select(
        "*",
        F.when(
            F.size(F.array_distinct(t)) < F.size(t),
            F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias(ranked),
    )
    r = F.col(ranked)
    same = lambda x, j: F.coalesce(F.get(r, j)["h"] == x["h"], F.lit(False))
    repeated = F.transform(r, lambda x, j: F.when(same(x, j + 1) | (same(x, j - 1) & (j > 0)), x["i"]))
    four = three.select("*", F.sort_array(F.filter(repeated, lambda i: i.isNotNull())).alias(starts))
    s = F.col(starts)
    covered = F.aggregate(
        F.transform(s, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - p, F.lit(3)))),
        F.lit(0),
        lambda total, n: total + n,
    )
    return four.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.size(w).cast("long").alias(names[0]),
        F.aggregate(w, F.lit(0), lambda total, x: total + F.length(x)).cast("long").alias(names[1]),
        F.col(names[2]),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias(names[3]),
        F.coalesce(covered, F.lit(0)).cast("long").alias(names[4]),
    )


def features(names: list[str]) -> list[Column]:
    """The numbers that rules compare with thresholds, from the statistics under ``names``."""
    n, chars, symbols, dup, repeat = [F.col(f"`{c}`") for c in names]
    per = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    return [n.cast("double"), per(chars, n), per(symbols, n), per(dup, n), per(repeat, n)]


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def column(self, values: list[Column]) -> Column:
        x = values[self.feature]
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)


@dataclass(frozen=True)
class DecisionList:
    """Ordered conjunctions; the first that holds rejects, and a row that meets none is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def keeps(self, values: list[Column]) -> Column:
        verdict = None
        for rule in self.rules:
            holds = reduce(Column.__and__, [c.column(values) for c in rule])
            verdict = F.when(holds, F.lit(False)) if verdict is None else verdict.when(holds, F.lit(False))
        return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))


def _cells(labelled: DataFrame, values: list[Column], label: Column, part: Column) -> tuple[list[list[float]], list]:
    """Thresholds per feature, and rows ``(bin of each feature, part, label, count)``: all that leaves Spark."""
    named_values = labelled.select(
        *[v.alias(f"f{i}") for i, v in enumerate(values)], label.alias("bad"), part.alias("part")
    )
    steps = [(i + 1) / (THRESHOLDS + 1) for i in range(THRESHOLDS)]
    cuts = lambda only: [F.percentile_approx(F.when(only, F.col(f"f{i}")), steps, 10_000) for i in range(len(values))]
    row = named_values.agg(*[F.array(a, b) for a, b in zip(cuts(F.col("bad")), cuts(~F.col("bad")), strict=True)]).first()
    grid = []
    for both in row:
        points = sorted({x for kind in both for x in kind or []})
        # Halfway between neighbours, so that a threshold does not lie on the values it came from.
        grid.append([(a + b) / 2 for a, b in zip(points, points[1:], strict=False)][:: max(1, len(points) // THRESHOLDS)])
    bins = [
        reduce(Column.__add__, [(F.col(f"f{i}") > F.lit(t)).cast("int") for t in ts], F.lit(0)).alias(f"b{i}")
        for i, ts in enumerate(grid)
    ]
    counted = named_values.groupBy(*bins, "part", "bad").agg(F.count("*").alias("n"))
    return grid, counted.collect()


def learn(cells: list, grid: list[list[float]], min_precision: float, min_rows: int) -> DecisionList:
    """Sequential covering over cell counts."""
    if not cells:
        return DecisionList(())
    bins = np.array([r[: len(grid)] for r in cells])
    count = np.array([r["n"] for r in cells], dtype=float)
    bad = np.array([r["bad"] for r in cells])
    grow = np.array([r["part"] for r in cells]) > 0
    tests = [(Condition(f, up, t), (bins[:, f] > k) == up) for f, ts in enumerate(grid) for k, t in enumerate(ts) for up in (True, False)]
    weigh = lambda mask: (count[mask & bad].sum(), count[mask & ~bad].sum())
    left, rules = np.ones(len(count), dtype=bool), []
    while True:
        rule, inside = [], left.copy()
        while True:
            p, n = weigh(inside & grow)
            if p == 0 or n == 0:
                break
            best, gain = None, 1e-9
            for test in tests:
                p1, n1 = weigh(inside & grow & test[1])
                if p1 >= min_rows and (g := p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))) > gain:
                    best, gain = test, g
            if best is None:
                break
            rule.append(best)
            inside &= best[1]
        if not rule:
            return DecisionList(tuple(rules))

        def worth(k: int) -> tuple[float, int]:
            p, n = weigh(reduce(np.logical_and, [m for _, m in rule[:k]], left) & ~grow)
            return ((p - n) / (p + n) if p + n else -1.0, -k)

        rule = rule[: max(range(1, len(rule) + 1), key=worth)]
        covered = reduce(np.logical_and, [m for _, m in rule], left)
        p, n = weigh(covered)
        if p < min_rows or p < min_precision * (p + n):
            return DecisionList(tuple(rules))
        rules.append(tuple(c for c, _ in rule))
        left &= ~covered


def fit(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    fit_rows: int = FIT_ROWS,
    min_precision: float = 0.9,
    min_rows: int = 5,
) -> DecisionList:
    """Learn which texts have label 0. About ``fit_rows`` labelled ids are looked up by a broadcast of that bound."""
    known = labels.select(named(labels, id_col).alias("_id"), named(labels, label_col).alias("_label")).where(
        "_id IS NOT NULL AND _label IN (0, 1)"
    )
    share = min(1.0, fit_rows / max(1, known.count()))
    draw = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    picked = known.where(draw < F.lit(int(share * (1 << 30)))) if share < 1 else known
    texts = df.select(named(df, id_col).alias("_id"), named(df, text_col).alias("_text"))
    found = with_statistics(texts.join(F.broadcast(picked), "_id"), "_text", STATISTICS)
    part = F.pmod(F.xxhash64("_id", F.lit("part")), F.lit(3))
    grid, cells = _cells(found, features(STATISTICS), F.col("_label") == 0, part)
    return learn(cells, grid, min_precision, min_rows)


def base_failed(names: list[str]) -> Column:
    n, repeat = F.col(f"`{names[0]}`"), F.col(f"`{names[4]}`")
    return (n < 50) | (100 * repeat > 50 * n)


def judge(df: DataFrame, learned: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics and verdict of every row: ``id, n_words .. n_repeat_words, base_failed, kept``."""
    slim = df.select(named(df, id_col).alias(id_col), named(df, text_col).alias("_text"))
    found = with_statistics(slim, "_text", STATISTICS)
    return found.select(
        id_col,
        *STATISTICS,
        base_failed(STATISTICS).alias("base_failed"),
        (~base_failed(STATISTICS) & learned.keeps(features(STATISTICS))).alias("kept"),
    )


def filter_quality(df: DataFrame, learned: DecisionList, text_col: str = "text") -> DataFrame:
    """The rows that pass, with the columns of ``df``."""
    names = fresh(df, *STATISTICS)
    found = with_statistics(df, text_col, names)
    kept = where_computed(found, ~base_failed(names) & learned.keeps(features(names)))
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])
