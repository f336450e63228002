"""Checked queries: the text classifier. The SQL side recomputes multinomial naive Bayes from counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify as L
from ..operators import stepwise as W
from ..operators.folds import held_out, stratified_kfold
from ..operators.runs import compare_runs
from ..session import scratch_path
from ..sources import views as V
from .registry import folded_sql, query, six, with_views

K, SEED = 5, 3407


def _rows(spark, folder):
    return V.labeled(spark, folder).select("id", "text", (F.col("score") - 1).alias("label"))


# Character counts per row, then per fold the counts of all other folds.
_BAYES = (
    folded_sql("labeled", "score", K, SEED)
    + """, chars AS (SELECT id, score - 1 AS label, fold, ch, count(*) AS n FROM (SELECT id, score, fold, unnest(regexp_extract_all(text, '(?s).')) AS ch FROM folded) GROUP BY ALL)
, f(k) AS (VALUES {folds})
, counts AS (SELECT k, label, ch, sum(n) AS n FROM chars JOIN f ON fold <> k GROUP BY ALL)
, vocab AS (SELECT DISTINCT k, ch FROM counts)
, width AS (SELECT k, count(*) AS v FROM vocab GROUP BY k)
, docs AS (SELECT k, score - 1 AS label, count(*) AS d FROM folded JOIN f ON fold <> k GROUP BY ALL)
, prior AS (SELECT k, label, ln(d + {s}) - ln(sum(d) OVER (PARTITION BY k) + count(*) OVER (PARTITION BY k) * {s}) AS pi FROM docs)
, mass AS (SELECT k, label, sum(n) AS m FROM counts GROUP BY ALL)
, base AS (SELECT k, label, ln({s}) - ln(m + v * {s}) AS none, ln(m + v * {s}) AS denom FROM mass JOIN width USING (k))
, theta AS (SELECT v.k, b.label, v.ch, ln(coalesce(c.n, 0) + {s}) - b.denom AS t FROM vocab v JOIN base b USING (k)
  LEFT JOIN counts c ON c.k = v.k AND c.label = b.label AND c.ch = v.ch)
, joint AS (SELECT c.id, c.label AS gold, t.k, t.label, sum(c.n * t.t) + any_value(p.pi) AS raw FROM chars c JOIN theta t ON t.k = c.fold AND t.ch = c.ch
  JOIN prior p ON p.k = t.k AND p.label = t.label GROUP BY c.id, c.label, t.k, t.label)
, best AS (SELECT id, k, gold, arg_max(label, raw) AS pred, max(raw) AS top FROM joint GROUP BY ALL)
, loss AS (SELECT b.id, b.k, b.gold, b.pred, b.top + ln(sum(exp(j.raw - b.top))) - max(CASE WHEN j.label = b.gold THEN j.raw END) AS loss
  FROM best b JOIN joint j ON j.id = b.id AND j.k = b.k GROUP BY b.id, b.k, b.gold, b.pred, b.top)
"""
)


def _bayes(folds: range, smoothing: str = "1.0") -> str:
    return _BAYES.format(folds=", ".join(f"({k})" for k in folds), s=smoothing)


_F1 = """, l AS (SELECT k, gold AS label FROM best UNION SELECT k, pred FROM best)
, f1 AS (SELECT l.k, avg(2 * (SELECT count(*) FROM best b WHERE b.k = l.k AND b.gold = l.label AND b.pred = l.label)
 / ((SELECT count(*) FROM best b WHERE b.k = l.k AND b.gold = l.label) + (SELECT count(*) FROM best b WHERE b.k = l.k AND b.pred = l.label))) AS f1 FROM l GROUP BY l.k)
"""


@query(
    "l1_train_fold",
    with_views(_bayes(range(1)) + "SELECT id, CAST(gold AS INTEGER) AS label, CAST(pred AS INTEGER) AS pred, round(loss, 4) AS loss FROM loss", "labeled"),
)
def l1_train_fold(spark, folder):
    folded = L.folded_input(_rows(spark, folder), K, "id", SEED)
    result = L.train_fold(folded, 0)
    scored = L.predictions(result.model, held_out(folded, 0))
    return scored.select("id", "label", "pred", F.round("loss", 4).alias("loss"))


@query(
    "l4_step_metrics",
    with_views(
        folded_sql("labeled", "score", K, SEED)
        + "SELECT CAST(v.step AS INTEGER) AS step, CAST(count(*) AS BIGINT) AS rows, true AS agrees FROM folded CROSS JOIN (VALUES (4), (8), (12)) v(step) WHERE fold = 0 GROUP BY v.step",
        "labeled",
    ),
)
def l4_step_metrics(spark, folder):
    """Each stored step of the iterated model on fold 0: rows predicted, and whether its metrics are those of its stored predictions."""
    folded, at = L.folded_input(_rows(spark, folder), K, "id", SEED), scratch_path(spark, "steps")
    result = W.train_steps(folded, 0, at, steps=12, every=4)
    again = compare_runs(spark.read.parquet(f"{at}/predictions"), "label", "pred", "step")
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) < 1e-9
    agrees = near("eval_accuracy", "accuracy") & near("eval_macro_f1", "macro_f1") & (result.metrics["step"] % 4 == 0)
    return result.candidates.join(again, "step").select("step", "rows", agrees.alias("agrees"))


_CV_SQL = with_views(
        _bayes(range(K))
        + _F1
        + """SELECT CAST(k AS INTEGER) AS fold, round(avg(CAST(gold = pred AS INTEGER)), 6) AS eval_accuracy, round(any_value(f1), 6) AS eval_macro_f1,
 round(avg(loss), 4) AS eval_loss FROM loss JOIN f1 USING (k) GROUP BY k""",
        "labeled",
    )


@query("l2_cross_validate", _CV_SQL)
def l2_cross_validate(spark, folder):
    merged, _ = L.cross_validate(_rows(spark, folder), K, "id", SEED)
    return merged.select(
        "fold", six("eval_accuracy").alias("eval_accuracy"), six("eval_macro_f1").alias("eval_macro_f1"),
        F.round("eval_loss", 4).alias("eval_loss"),
    )


@query("l2_resumed_folds", _CV_SQL)
def l2_resumed_folds(spark, folder):
    """Folds 0 and 1 first, the others in a second run that reads what the first has stored."""
    path = scratch_path(spark, "fold-metrics")
    L.cross_validate(_rows(spark, folder), K, "id", SEED, folds=tuple(range(2)), metrics_path=path)
    merged, _ = L.cross_validate(_rows(spark, folder), K, "id", SEED, folds=tuple(range(2, K)), metrics_path=path)
    return merged.select(
        "fold", six("eval_accuracy").alias("eval_accuracy"), six("eval_macro_f1").alias("eval_macro_f1"),
        F.round("eval_loss", 4).alias("eval_loss"),
    )


@query(
    "l3_evaluate",
    with_views(
        _bayes(range(1))
        + _F1
        + """SELECT CAST(count(*) AS BIGINT) AS rows, round(avg(CAST(gold = pred AS INTEGER)), 6) AS accuracy, round(any_value(f1), 6) AS macro_f1,
 """
        + " || ' / ' || ".join(
            "concat_ws(' ', " + ", ".join(f"count(*) FILTER (WHERE gold = {g} AND pred = {p})" for p in range(4)) + ")" for g in range(4)
        )
        + " AS matrix FROM best JOIN f1 USING (k)",
        "labeled",
    ),
)
def l3_evaluate(spark, folder):
    """Train with fold 0 held out, save, load, and evaluate the stored model on that fold."""
    folded = L.folded_input(_rows(spark, folder), K, "id", SEED)
    models = scratch_path(spark, "models")
    L.train_fold(folded, 0, model_dir=models)
    model = L.PipelineModel.load(f"{models}/fold_0")
    test = held_out(folded, 0).drop("fold")
    out = L.evaluate(model, test, scratch_path(spark, "rows"), scratch_path(spark, "report"))
    row = lambda r: F.array_join(F.transform(r, lambda n: n.cast("string")), " ")
    matrix = F.array_join(F.transform("confusion_matrix", row), " / ")
    return out.select("rows", six("accuracy").alias("accuracy"), six("macro_f1").alias("macro_f1"), matrix.alias("matrix"))


@query(
    "l5_evaluate_outputs",
    with_views(
        _bayes(range(1))
        + """, outs AS (SELECT 'same' AS run, gold, pred FROM best UNION ALL SELECT 'next', (gold + 1) % 4, pred FROM best)
, l AS (SELECT run, gold AS label FROM outs UNION SELECT run, pred FROM outs)
, s AS (SELECT l.run, l.label, count(*) FILTER (WHERE r.gold = l.label AND r.pred = l.label) AS tp, count(*) FILTER (WHERE r.gold = l.label) AS sup,
 count(*) FILTER (WHERE r.pred = l.label) AS pr FROM l JOIN outs r ON r.run = l.run GROUP BY 1, 2)
SELECT run, CAST(sum(sup) AS BIGINT) AS rows, round(sum(tp) / sum(sup), 6) AS accuracy, round(avg(2 * tp / (sup + pr)), 6) AS macro_f1 FROM s GROUP BY run""",
        "labeled",
    ),
)
def l5_evaluate_outputs(spark, folder):
    folded = L.folded_input(_rows(spark, folder), K, "id", SEED)
    model = L.train_fold(folded, 0).model
    test = held_out(folded, 0).select("id", "text", "label")
    outputs = {"same": test, "next": test.withColumn("label", (F.col("label") + 1) % 4)}
    out = L.evaluate_outputs(model, outputs)
    return out.select("run", "rows", six("accuracy").alias("accuracy"), six("macro_f1").alias("macro_f1"))
