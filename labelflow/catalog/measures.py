"""Checked queries: metrics, comparisons, and upserts of fold metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.replies import parse_marked
from ..operators import metrics as H
from ..operators import runs as C
from ..operators.labels import mark_correct, valid_predictions, with_mode
from ..operators.sampling import class_totals
from ..sources import views as V
from .registry import query, six, with_views


@query("h1_class_counts", with_views("SELECT gold, CAST(count(*) AS BIGINT) AS n FROM predicted GROUP BY gold", "predicted"))
def h1_class_counts(spark, folder):
    return H.class_counts(V.predicted(spark, folder), "gold").orderBy("gold")


@query(
    "h1_class_counts_zero_filled",
    with_views(
        """SELECT g.label AS gold, CAST(count(p.id) AS BIGINT) AS n FROM (VALUES (0), (1), (2), (3), (4), (5)) g(label)
LEFT JOIN predicted p ON p.gold = g.label GROUP BY g.label""",
        "predicted",
    ),
)
def h1_class_counts_zero_filled(spark, folder):
    return H.class_counts(V.predicted(spark, folder), "gold", (0, 1, 2, 3, 4, 5))


@query(
    "h1_min_class_count",
    with_views(
        "SELECT CAST(min(n) AS BIGINT) AS min_n, CAST(count(*) AS BIGINT) AS classes FROM (SELECT count(*) AS n FROM predicted GROUP BY gold)",
        "predicted",
    ),
)
def h1_min_class_count(spark, folder):
    return H.min_class_count(V.predicted(spark, folder), "gold")


def _accuracy_sql(where: str) -> str:
    return with_views(
        f""", p AS (SELECT gold, CASE WHEN pred = 4 THEN -1 ELSE pred END AS pred FROM predicted)
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE gold = pred) AS BIGINT) AS correct,
 round(avg(CAST(gold = pred AS INTEGER)), 6) AS accuracy FROM p {where}""",
        "predicted",
    )


def _with_failures(spark, folder):
    """Every prediction of level 4 counts as a failed call."""
    rows = V.predicted(spark, folder)
    return rows.withColumn("pred", F.when(F.col("pred") == 4, F.lit(-1)).otherwise(F.col("pred")))


@query("h2_accuracy_valid", _accuracy_sql("WHERE pred > 0"))
def h2_accuracy_valid(spark, folder):
    out = H.accuracy(_with_failures(spark, folder), "gold", "pred", "valid")
    return out.withColumn("accuracy", six("accuracy"))


@query("h2_accuracy_all", _accuracy_sql(""))
def h2_accuracy_all(spark, folder):
    out = H.accuracy(_with_failures(spark, folder), "gold", "pred", "all")
    return out.withColumn("accuracy", six("accuracy"))


@query(
    "h3_accuracy_by",
    with_views(
        """SELECT model || '_' || prompt_type AS model_mode, gold, CAST(grouping(model || '_' || prompt_type, gold) AS BIGINT) AS grouping,
 CAST(count(*) AS BIGINT) AS rows, round(100 * avg(CAST(gold = pred AS INTEGER)), 6) AS accuracy_percent
FROM predicted GROUP BY GROUPING SETS ((model || '_' || prompt_type), (gold), ())""",
        "predicted",
    ),
)
def h3_accuracy_by(spark, folder):
    rows = mark_correct(with_mode(V.predicted(spark, folder)), "pred", "gold")
    out = H.accuracy_by(rows, "is_correct", [["model_mode"], ["gold"], []])
    return out.withColumn("accuracy_percent", six("accuracy_percent"))


@query(
    "h4_confusion",
    with_views(
        """, p AS (SELECT gold, CASE WHEN pred = 4 THEN -1 ELSE pred END AS pred FROM predicted)
, l AS (SELECT gold AS label FROM p UNION SELECT pred FROM p)
SELECT a.label AS gold, b.label AS pred, CAST(count(p.gold) AS BIGINT) AS n FROM l a CROSS JOIN l b
LEFT JOIN p ON p.gold = a.label AND p.pred = b.label GROUP BY 1, 2""",
        "predicted",
    ),
)
def h4_confusion(spark, folder):
    return H.confusion(_with_failures(spark, folder), "gold", "pred", (-1, 1, 2, 3, 4))


@query(
    "h5_confusion_fixed",
    with_views(
        """, p AS (SELECT CAST(gold AS VARCHAR) AS gold, CASE WHEN pred = 4 THEN '解析失敗' ELSE CAST(pred AS VARCHAR) END AS pred FROM predicted)
SELECT g.gold, """
        + ", ".join(
            f"CAST(count(*) FILTER (WHERE p.pred = '{c}') AS BIGINT) AS \"pred_{c}\"" for c in ("1", "2", "3", "4", "解析失敗")
        )
        + " FROM (VALUES ('1'), ('2'), ('3'), ('4')) g(gold) LEFT JOIN p ON p.gold = g.gold GROUP BY g.gold",
        "predicted",
    ),
)
def h5_confusion_fixed(spark, folder):
    rows = V.predicted(spark, folder).select(
        F.col("gold").cast("string").alias("gold"),
        F.when(F.col("pred") == 4, "解析失敗").otherwise(F.col("pred").cast("string")).alias("pred"),
    )
    return H.confusion_fixed(rows, "gold", "pred", ("1", "2", "3", "4"), "解析失敗")


_REPORT = """, s AS (SELECT g.label, (SELECT count(*) FROM p WHERE gold = g.label AND pred = g.label) AS tp,
 (SELECT count(*) FROM p WHERE gold = g.label) AS sup, (SELECT count(*) FROM p WHERE pred = g.label) AS pr
 FROM (VALUES (1), (2), (3), (4)) g(label))
, c AS (SELECT label, sup, tp, coalesce(tp / nullif(pr, 0), 0) AS precision, coalesce(tp / nullif(sup, 0), 0) AS recall,
 coalesce(2 * tp / nullif(pr + sup, 0), 0) AS f1 FROM s)
, report AS (SELECT CAST(label AS VARCHAR) AS label, precision, recall, f1, sup AS support FROM c
UNION ALL SELECT 'accuracy', sum(tp) / sum(sup), sum(tp) / sum(sup), sum(tp) / sum(sup), sum(sup) FROM c
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(sup) FROM c
UNION ALL SELECT 'weighted avg', sum(precision * sup) / sum(sup), sum(recall * sup) / sum(sup), sum(f1 * sup) / sum(sup), sum(sup) FROM c)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM report"""


def _rounded(report):
    return report.withColumns({c: six(c) for c in ("precision", "recall", "f1")})


@query("h6_classification_report", with_views(", p AS (SELECT gold, pred FROM predicted)" + _REPORT, "predicted"))
def h6_classification_report(spark, folder):
    return _rounded(H.classification_report(V.predicted(spark, folder), "gold", "pred", (1, 2, 3, 4)))


@query(
    "h6_scored_report",
    with_views(
        ", p AS (SELECT score AS gold, CAST(regexp_extract(reply, '【最終分數：([1-4])】', 1) AS INTEGER) AS pred FROM replies)" + _REPORT,
        "replies",
    ),
)
def h6_scored_report(spark, folder):
    scored = valid_predictions(parse_marked(V.replies(spark, folder)))
    return _rounded(H.classification_report(scored, "score", "predicted_score", (1, 2, 3, 4)))


_PRESENT = """, l AS (SELECT gold AS label FROM p UNION SELECT pred FROM p)
, s AS (SELECT label, (SELECT count(*) FROM p WHERE gold = label AND pred = label) AS tp,
 (SELECT count(*) FROM p WHERE gold = label) + (SELECT count(*) FROM p WHERE pred = label) AS sides FROM l)
"""


@query(
    "h7_macro_f1",
    with_views(
        """, p AS (SELECT gold, CASE WHEN pred = 4 THEN -1 ELSE pred END AS pred FROM predicted)"""
        + _PRESENT
        + "SELECT CAST(count(*) AS BIGINT) AS labels, round(avg(2 * tp / sides), 6) AS macro_f1 FROM s",
        "predicted",
    ),
)
def h7_macro_f1(spark, folder):
    return H.macro_f1(_with_failures(spark, folder), "gold", "pred").withColumn("macro_f1", six("macro_f1"))


def _fold_table(spark, folder):
    """One metric row per order priority, standing in for the folds of a run."""
    orders = V.table(spark, folder, "orders")
    fold = (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("fold")
    return orders.groupBy(fold).agg(
        F.avg((F.col("o_orderstatus") == "O").cast("double")).alias("eval_accuracy"),
        F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("eval_macro_f1"),
        (F.avg("o_totalprice") / 1e6).alias("eval_loss"),
    )


_FOLD_TABLE = """f AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS fold, avg(CAST(o_orderstatus = 'O' AS INTEGER)) AS eval_accuracy,
 avg(CAST(o_orderstatus = 'F' AS INTEGER)) AS eval_macro_f1, avg(o_totalprice) / 1e6 AS eval_loss FROM orders GROUP BY 1)"""


@query(
    "h8_cv_summary",
    f"""WITH {_FOLD_TABLE} SELECT CAST(count(*) AS BIGINT) AS n_folds_recorded, string_agg(fold, ',' ORDER BY fold) AS completed,
 round(avg(eval_accuracy), 6) AS mean_eval_accuracy, round(avg(eval_macro_f1), 6) AS mean_eval_macro_f1, round(avg(eval_loss), 6) AS mean_eval_loss,
 round(stddev_pop(eval_accuracy), 6) AS std_eval_accuracy, round(stddev_pop(eval_macro_f1), 6) AS std_eval_macro_f1,
 round(stddev_pop(eval_loss), 6) AS std_eval_loss FROM f""",
)
def h8_cv_summary(spark, folder):
    out = H.cv_summary(_fold_table(spark, folder))
    means = [c for c in out.columns if c.startswith(("mean_", "std_"))]
    out = out.withColumns({c: six(c) for c in means})
    joined = F.array_join(F.transform("completed_folds", lambda f: f.cast("string")), ",")
    return out.withColumn("completed", joined).drop("completed_folds")


@query(
    "h9_running_accuracy",
    with_views(
        """SELECT id, gold, pred, row_number() OVER w AS rows_so_far, CAST(sum(CAST(gold = pred AS INTEGER)) OVER w AS BIGINT) AS correct_so_far,
 round(avg(CAST(gold = pred AS INTEGER)) OVER w, 6) AS running_accuracy FROM predicted
WINDOW w AS (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        "predicted",
    ),
)
def h9_running_accuracy(spark, folder):
    rows = V.predicted(spark, folder).select("id", "gold", "pred")
    return H.running_accuracy(rows, "gold", "pred", ["id"]).withColumn("running_accuracy", six("running_accuracy"))


@query(
    "h10_comparison",
    with_views(
        "SELECT model, "
        + ", ".join(
            f"round(100 * avg(CAST(gold = pred AS INTEGER)) FILTER (WHERE prompt_type = '{c}'), 6) AS \"{c}\"" for c in ("O", "F")
        )
        + " FROM predicted GROUP BY model",
        "predicted",
    ),
)
def h10_comparison(spark, folder):
    rows = mark_correct(V.predicted(spark, folder), "pred", "gold")
    out = H.comparison(rows, "model", "prompt_type", ["O", "F"], "is_correct")
    return out.withColumns({"O": six("O"), "F": six("F")})


@query(
    "c5_merge_fold_metrics",
    f"""WITH {_FOLD_TABLE}
, u AS (SELECT *, 0 AS p FROM f UNION ALL SELECT fold + 2, 1 - eval_accuracy, eval_macro_f1, eval_loss, 1 FROM f)
, r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY p DESC) AS rn FROM u)
SELECT fold, round(eval_accuracy, 6) AS eval_accuracy, round(eval_macro_f1, 6) AS eval_macro_f1, round(eval_loss, 6) AS eval_loss FROM r WHERE rn = 1""",
)
def c5_merge_fold_metrics(spark, folder):
    old = _fold_table(spark, folder)
    new = old.withColumns({"fold": F.col("fold") + 2, "eval_accuracy": 1 - F.col("eval_accuracy")})
    merged = C.merge_fold_metrics(old, new)
    return merged.withColumns({c: six(c) for c in ("eval_accuracy", "eval_macro_f1", "eval_loss")})


_RUN = """, s{0} AS (SELECT label, (SELECT count(*) FROM p{0} WHERE gold = label AND pred = label) AS tp, (SELECT count(*) FROM p{0} WHERE gold = label) AS sup,
 (SELECT count(*) FROM p{0} WHERE pred = label) AS pr FROM (SELECT gold AS label FROM p{0} UNION SELECT pred FROM p{0}))
"""


@query(
    "c7_compare_runs",
    with_views(
        ", p1 AS (SELECT gold, pred FROM predicted), p2 AS (SELECT gold, 1 + pred % 4 AS pred FROM predicted)"
        + _RUN.format(1)
        + _RUN.format(2)
        + " UNION ALL ".join(
            f"SELECT '{n}' AS run, CAST(sum(sup) AS BIGINT) AS rows, round(sum(tp) / sum(sup), 6) AS accuracy, round(avg(2 * tp / (sup + pr)), 6) AS macro_f1 FROM s{i}"
            for i, n in ((1, "as predicted"), (2, "shifted"))
        ),
        "predicted",
    ),
)
def c7_compare_runs(spark, folder):
    rows = V.predicted(spark, folder).select("gold", "pred")
    shifted = rows.withColumn("pred", 1 + F.col("pred") % 4)
    out = C.compare_runs(C.stack_runs({"as predicted": rows, "shifted": shifted}), "gold", "pred")
    return out.withColumns({"accuracy": six("accuracy"), "macro_f1": six("macro_f1")})


@query(
    "l4_best_run",
    f"""WITH {_FOLD_TABLE} SELECT fold AS step, round(eval_macro_f1, 6) AS eval_macro_f1 FROM f ORDER BY f.eval_macro_f1 DESC, fold LIMIT 1""",
)
def l4_best_run(spark, folder):
    candidates = _fold_table(spark, folder).withColumnRenamed("fold", "step")
    return C.best_run(candidates).select("step", six("eval_macro_f1").alias("eval_macro_f1"))


@query(
    "i3_ordered_counts",
    with_views(
        "SELECT gold, CAST(count(*) AS BIGINT) AS n, CAST((SELECT count(*) FROM predicted) AS BIGINT) AS total, "
        "CAST((SELECT min(n) FROM (SELECT count(*) AS n FROM predicted GROUP BY gold)) AS BIGINT) AS smallest FROM predicted GROUP BY gold",
        "predicted",
    ),
)
def i3_ordered_counts(spark, folder):
    return class_totals(V.predicted(spark, folder), "gold").orderBy("gold")
