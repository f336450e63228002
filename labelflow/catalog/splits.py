"""Checked queries: ranks, holdout, samples, few-shot sets, folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds as D
from ..operators import sampling as S
from ..operators.ranking import stable_rank
from ..sources import views as V
from .registry import folded_sql, query, seeded_rank_sql, six, text_md5, with_views

FOLDS, FOLD_SEED = 5, 3407


@query(
    "n1_stable_rank",
    with_views(f", r AS ({seeded_rank_sql('predicted', 'gold', 7)}) SELECT id, gold, rk AS rank FROM r", "predicted"),
)
def n1_stable_rank(spark, folder):
    return stable_rank(V.predicted(spark, folder).select("id", "gold"), ["gold"], "id", 7)


@query(
    "n1_global_rank",
    with_views(f", r AS ({seeded_rank_sql('predicted', None, 7)}) SELECT id, rk AS rank FROM r", "predicted"),
)
def n1_global_rank(spark, folder):
    return stable_rank(V.predicted(spark, folder).select("id"), [], "id", 7)


def _split_sql(view: str, label: str) -> str:
    return with_views(
        f""", c AS (SELECT {label} AS k, count(*) AS n FROM {view} GROUP BY 1)
, t AS (SELECT k, n, sum(n) OVER () AS total, min(n) OVER () AS smallest FROM c)
, q AS (SELECT k, n, total, smallest, CAST(total - ceil(total * 0.2) AS BIGINT) AS train FROM t)
, b AS (SELECT *, (n * train) // total AS base, (n * train) % total AS rest FROM q)
, f AS (SELECT k, smallest, train, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, k) <= train - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM b)
, r AS ({seeded_rank_sql(view, label, 42)})
, a AS (SELECT id, row_number() OVER (ORDER BY md5('42:' || id), id) AS rk FROM {view})
SELECT r.id, r.{label}, CASE WHEN CASE WHEN f.smallest >= 2 THEN r.rk <= f.quota ELSE a.rk <= f.train END
 THEN 'train' ELSE 'test' END AS part FROM r JOIN f ON f.k = r.{label} JOIN a ON a.id = r.id""",
        view,
    )


@query("d1_stratified_split", _split_sql("labeled", "score"))
def d1_stratified_split(spark, folder):
    return S.stratified_split(V.labeled(spark, folder).select("id", "score"), "score", "id")


@query("d1_stratified_split_large", _split_sql("predicted", "gold"))
def d1_stratified_split_large(spark, folder):
    return S.stratified_split(V.predicted(spark, folder).select("id", "gold"), "gold", "id")


def _sample_sql(view: str, label: str, n: int) -> str:
    return with_views(
        f""", c AS (SELECT {label} AS k, count(*) AS n FROM {view} GROUP BY 1)
, q AS (SELECT k, n, greatest(1, CAST(round_even({n} * n / sum(n) OVER (), 0) AS BIGINT)) AS quota, sum(n) OVER () AS total FROM c)
, r AS ({seeded_rank_sql(view, label, 42)})
, picked AS (SELECT r.id, r.{label} FROM r JOIN q ON q.k = r.{label} WHERE r.rk <= q.quota OR q.total <= {n})
, again AS (SELECT *, row_number() OVER (ORDER BY md5('42:recut:' || id), id) AS rk, count(*) OVER () AS drawn FROM picked)
SELECT id, {label} FROM again WHERE drawn <= {n} OR rk <= {n}""",
        view,
    )


@query("d2_proportional_sample", _sample_sql("labeled", "score", 50))
def d2_proportional_sample(spark, folder):
    return S.proportional_sample(V.labeled(spark, folder).select("id", "score"), "score", "id", 50)


@query("d2_proportional_sample_large", _sample_sql("predicted", "gold", 1003))
def d2_proportional_sample_large(spark, folder):
    return S.proportional_sample(V.predicted(spark, folder).select("id", "gold"), "gold", "id", 1003)


@query(
    "d3_sample_n",
    with_views(f", r AS ({seeded_rank_sql('predicted', None, 11)}) SELECT id, gold, pred FROM r WHERE rk <= 2000", "predicted"),
)
def d3_sample_n(spark, folder):
    return S.sample_n(V.predicted(spark, folder).select("id", "gold", "pred"), "id", 2000, 11)


@query(
    "d4_first_n_per_class",
    with_views(
        """, r AS (SELECT id, text, score, row_number() OVER (PARTITION BY score ORDER BY id) AS rn FROM labeled WHERE score BETWEEN 1 AND 4)
SELECT id, md5(text) AS text_md5, score, CAST(rn AS INTEGER) AS rn FROM r WHERE rn <= 30""",
        "labeled",
    ),
)
def d4_first_n_per_class(spark, folder):
    top = S.first_n_per_class(V.labeled(spark, folder), "score", 30, ["id"])
    return top.select("id", text_md5("text").alias("text_md5"), "score", "rn")


@query(
    "d4_first_n_per_class_large",
    with_views(
        """, r AS (SELECT id, gold, row_number() OVER (PARTITION BY gold ORDER BY id) AS rn FROM predicted)
SELECT id, gold, CAST(rn AS INTEGER) AS rn FROM r WHERE rn <= 30""",
        "predicted",
    ),
)
def d4_first_n_per_class_large(spark, folder):
    return S.first_n_per_class(V.predicted(spark, folder).select("id", "gold"), "gold", 30, ["id"])


@query(
    "d5_few_shot_sets",
    with_views(
        f""", r AS ({seeded_rank_sql('labeled', 'score', 42)}), k(per_class) AS (VALUES (0), (1), (2), (3))
SELECT k.per_class * 4 AS shots, r.score, CAST(r.rk AS INTEGER) AS rn, r.id, md5(r.text) AS text_md5
FROM r JOIN k ON r.rk <= k.per_class""",
        "labeled",
    ),
)
def d5_few_shot_sets(spark, folder):
    sets = S.few_shot_sets(V.labeled(spark, folder), "score", "id")
    return sets.select("shots", "score", "rn", "id", text_md5("text").alias("text_md5"))


@query(
    "d6_stratified_kfold",
    with_views(folded_sql("labeled", "score", FOLDS, FOLD_SEED) + "SELECT id, score, fold FROM folded", "labeled"),
)
def d6_stratified_kfold(spark, folder):
    rows = V.labeled(spark, folder).select("id", "score")
    return D.stratified_kfold(rows, "score", "id", FOLDS, FOLD_SEED)


@query(
    "d6_stratified_kfold_large",
    with_views(folded_sql("predicted", "gold", FOLDS, FOLD_SEED) + "SELECT id, gold, fold FROM folded", "predicted"),
)
def d6_stratified_kfold_large(spark, folder):
    rows = V.predicted(spark, folder).select("id", "gold")
    return D.stratified_kfold(rows, "gold", "id", FOLDS, FOLD_SEED)


def _folded(spark, folder):
    rows = V.predicted(spark, folder).select("id", (F.col("gold") - 1).alias("label"))
    return D.stratified_kfold(rows, "label", "id", FOLDS, FOLD_SEED)


_FOLDED = folded_sql("predicted", "gold", FOLDS, FOLD_SEED)


@query(
    "d7_fold_view",
    with_views(
        _FOLDED + "SELECT id, gold - 1 AS label, fold, CASE WHEN fold = 2 THEN 'test' ELSE 'train' END AS part FROM folded",
        "predicted",
    ),
)
def d7_fold_view(spark, folder):
    return D.fold_view(_folded(spark, folder), 2)


@query(
    "d7_split_sizes",
    with_views(
        _FOLDED
        + """SELECT fold, CAST(count(*) AS BIGINT) AS test_size,
 CAST((SELECT count(*) FROM folded) - count(*) AS BIGINT) AS train_size FROM folded GROUP BY fold""",
        "predicted",
    ),
)
def d7_split_sizes(spark, folder):
    return D.split_sizes(_folded(spark, folder))


_CELLS = """, cells AS (SELECT f.fold, g.label, count(d.id) AS test_n FROM (SELECT DISTINCT fold FROM folded) f
 JOIN (VALUES (0), (1), (2), (3)) g(label) ON true LEFT JOIN folded d ON d.fold = f.fold AND d.gold - 1 = g.label GROUP BY 1, 2)
, wide AS (SELECT *, sum(test_n) OVER (PARTITION BY label) - test_n AS train_n, sum(test_n) OVER (PARTITION BY fold) AS test_size,
 sum(test_n) OVER () - sum(test_n) OVER (PARTITION BY fold) AS train_size FROM cells)
"""


@query(
    "d8_fold_classes",
    with_views(
        _FOLDED
        + _CELLS
        + """SELECT fold, label, CAST(test_n AS BIGINT) AS test_n, CAST(train_n AS BIGINT) AS train_n,
 CAST(test_size AS BIGINT) AS test_size, CAST(train_size AS BIGINT) AS train_size,
 round(test_n / test_size, 6) AS test_ratio, round(train_n / train_size, 6) AS train_ratio FROM wide""",
        "predicted",
    ),
)
def d8_fold_classes(spark, folder):
    cells = D.fold_classes(_folded(spark, folder), FOLDS)
    return cells.withColumns({"test_ratio": six("test_ratio"), "train_ratio": six("train_ratio")})


@query(
    "d8_fold_summary",
    with_views(
        _FOLDED
        + _CELLS
        + """, s AS (SELECT DISTINCT fold, test_size, train_size FROM wide)
, c AS (SELECT label, sum(test_n) AS n, stddev_pop(train_n / train_size) AS tr, stddev_pop(test_n / test_size) AS te FROM wide GROUP BY label)
SELECT CAST((SELECT count(*) FROM folded) AS BIGINT) AS n_rows, 5 AS n_splits,
 (SELECT string_agg(fold || ':' || train_size || '/' || test_size, ' ' ORDER BY fold) FROM s) AS sizes,
 (SELECT string_agg((label + 1) || '=' || n, ' ' ORDER BY label) FROM c) AS class_counts,
 (SELECT round(stddev_pop(train_size), 6) FROM s) AS train_size_std, (SELECT round(stddev_pop(test_size), 6) FROM s) AS test_size_std,
 (SELECT round(sum(tr), 6) FROM c) AS train_ratio_std_sum, (SELECT round(sum(te), 6) FROM c) AS test_ratio_std_sum""",
        "predicted",
    ),
)
def d8_fold_summary(spark, folder):
    summary = D.fold_summary(_folded(spark, folder), FOLDS, FOLD_SEED)
    total = lambda m: six(F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x))
    size = lambda f: F.concat(f["fold"].cast("string"), F.lit(":"), f["train_size"].cast("string"), F.lit("/"), f["test_size"].cast("string"))
    pair = lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    return summary.select(
        "n_rows",
        "n_splits",
        F.array_join(F.transform("folds", size), " ").alias("sizes"),
        F.array_join(F.transform(F.map_entries("class_counts"), pair), " ").alias("class_counts"),
        six("train_size_std").alias("train_size_std"),
        six("test_size_std").alias("test_size_std"),
        total("train_ratio_std").alias("train_ratio_std_sum"),
        total("test_ratio_std").alias("test_ratio_std_sum"),
    )
