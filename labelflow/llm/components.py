"""Connected components of a graph given by its edges, without any vertex's edges being gathered in one place.

Alternating large-star and small-star steps: every vertex points its larger neighbours, then its smaller ones, at the
smallest vertex it knows. Both steps are one map-side combined minimum and one join, and the edges end as stars around
the smallest vertex of each component, after a number of steps that grows with the logarithm of its size. Each step is
written to the shared folder, so plans stay short and lost executors lose nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def forest(keys: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges ``i, j`` that connect, within runs of equal keys, what links connect, and each place's component. Keys are sorted.

    ``near`` says which of the pairs of places it gets are links.
    """
    label = np.arange(len(keys))

    def root(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    out: list[tuple[int, int]] = []
    at = np.arange(len(keys))
    for d in range(1, len(keys)):
        at = at[at + d < len(keys)]
        at = at[keys[at] == keys[at + d]]
        if not len(at):
            break
        apart = at[label[at] != label[at + d]]
        linked = apart[near(apart, apart + d)]
        for i in linked.tolist():
            a, b = root(i), root(i + d)
            if a != b:
                label[max(a, b)] = min(a, b)
                out.append((i, i + d))
        if len(linked):
            while not np.array_equal(higher := label[label], label):
                label = higher
    i, j = np.array(out, dtype=np.int64).reshape(-1, 2).T
    return i, j, label


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def stars(edges: DataFrame) -> DataFrame:
    """``(vertex, root)`` for every vertex with an edge that is not the smallest of its component.

    ``edges`` has columns ``u`` and ``v``; loops and repeated edges do no harm, nulls are dropped.
    """
    now = cut_lineage(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    before, state = None, _summary(now)
    while state != before:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        others = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut_lineage(others.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
        before, state = state, _summary(now)
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
