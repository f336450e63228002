import pytest
from labelflow.operators import metrics as H
from labelflow.operators import runs as C

# Published result matrices (rows: true level 1..4), with accuracy in percent and macro F1.
# Published matrices with their accuracy and macro F1.
GOLDEN = [
    ("first series, zero-shot", [[42, 11, 28, 47], [36, 52, 27, 35], [25, 21, 60, 44], [33, 10, 3, 93]], 43.56, 0.4279),
    ("first series, 4-shot", [[40, 14, 27, 47], [43, 24, 36, 47], [45, 32, 30, 43], [19, 16, 28, 76]], 29.98, 0.2869),
    ("first series, 8-shot", [[44, 10, 29, 45], [49, 19, 36, 46], [54, 26, 30, 40], [23, 22, 31, 63]], 27.51, 0.2646),
    ("first series, 12-shot", [[53, 10, 24, 41], [49, 20, 34, 47], [58, 32, 26, 34], [32, 22, 33, 52]], 26.63, 0.2573),
    ("second series, zero-shot", [[42, 18, 30, 38], [44, 45, 32, 29], [45, 41, 32, 32], [47, 44, 23, 25]], 25.40, 0.2516),
    ("second series, 4-shot", [[40, 19, 19, 50], [42, 39, 33, 36], [46, 29, 36, 39], [40, 17, 22, 60]], 30.86, 0.3062),
    ("second series, 8-shot", [[56, 17, 12, 43], [40, 44, 31, 35], [46, 28, 34, 42], [39, 15, 21, 64]], 34.92, 0.3448),
    ("second series, 12-shot", [[63, 16, 11, 38], [39, 44, 35, 32], [38, 30, 40, 42], [46, 14, 21, 58]], 36.16, 0.3586),
    ("scorer", [[25, 3, 0, 0], [1, 17, 0, 0], [0, 0, 18, 0], [0, 1, 1, 25]], 93.41, 0.9331),
]


def pairs(spark, matrix):
    rows = [(g + 1, p + 1) for g, row in enumerate(matrix) for p, n in enumerate(row) for _ in range(n)]
    return spark.createDataFrame(rows, "gold int, pred int")


@pytest.mark.parametrize(("name", "matrix", "percent", "f1"), GOLDEN)
def test_golden_matrices(spark, name, matrix, percent, f1):
    df = pairs(spark, matrix)
    assert round(H.accuracy(df, "gold", "pred").first()["accuracy"] * 100, 2) == percent
    assert round(H.macro_f1(df, "gold", "pred").first()["macro_f1"], 4) == f1
    cells = {(r["gold"], r["pred"]): r["n"] for r in H.confusion(df, "gold", "pred", (1, 2, 3, 4)).collect()}
    assert [[cells[g, p] for p in range(1, 5)] for g in range(1, 5)] == matrix


def test_report_of_the_scorer_matrix(spark):
    report = {r["label"]: r for r in H.classification_report(pairs(spark, GOLDEN[-1][1]), "gold", "pred", (1, 2, 3, 4)).collect()}
    rounded = lambda c: [round(report[str(i)][c], 4) for i in range(1, 5)]
    assert rounded("precision") == [0.9615, 0.8095, 0.9474, 1.0]
    assert rounded("recall") == [0.8929, 0.9444, 1.0, 0.9259]
    assert rounded("f1") == [0.9259, 0.8718, 0.973, 0.9615]
    assert [report[str(i)]["support"] for i in range(1, 5)] == [28, 18, 18, 27]
    assert round(report["accuracy"]["f1"], 4) == 0.9341


def test_accuracy_bases(spark):
    df = spark.createDataFrame([(1, 1), (2, -1), (3, 3)], "gold int, pred int")
    assert H.accuracy(df, "gold", "pred", "valid").first()["accuracy"] == 1.0
    assert round(H.accuracy(df, "gold", "pred", "all").first()["accuracy"], 3) == 0.667
    with pytest.raises(ValueError, match="base"):
        H.accuracy(df, "gold", "pred", "some")


def test_present_and_fixed_labels_differ(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "gold int, pred int")
    assert H.macro_f1(df, "gold", "pred").first()["macro_f1"] == 1.0
    report = {r["label"]: r for r in H.classification_report(df, "gold", "pred", (1, 2, 3, 4)).collect()}
    assert report["macro avg"]["f1"] == 0.5
    assert report["4"]["support"] == 0


def test_confusion_keeps_pairs_beyond_the_list(spark):
    df = spark.range(30).selectExpr("id AS gold", "id AS pred")
    assert H.confusion(df, "gold", "pred", (0, 1)).count() == 32
    assert H.confusion_cells(df, "gold", "pred").count() == 30


def test_fixed_confusion_skips_other_gold(spark):
    df = spark.createDataFrame([("1", "2"), ("9", "1"), ("1", "x")], "gold string, pred string")
    rows = {r["gold"]: r.asDict() for r in H.confusion_fixed(df, "gold", "pred", ("1", "2"), "x").collect()}
    assert rows["1"] == {"gold": "1", "pred_1": 0, "pred_2": 1, "pred_x": 1}
    assert sum(v for k, v in rows["2"].items() if k != "gold") == 0


def test_running_accuracy_ends_at_accuracy(spark):
    df = spark.range(3000).selectExpr("id", "cast(id % 4 AS int) AS gold", "cast(id * 7 % 3 AS int) AS pred")
    last = H.running_accuracy(df, "gold", "pred", ["id"]).orderBy("rows_so_far", ascending=False).first()
    assert last["id"] == 2999
    assert last["running_accuracy"] == pytest.approx(H.accuracy(df, "gold", "pred").first()["accuracy"])


def test_running_accuracy_with_ties_and_null_keys(spark):
    rows = [(1, 1, 1), (1, 1, 2), (1, 2, 2), (None, 1, 1), (None, 2, None), (2, 3, 3)]
    df = spark.createDataFrame(rows, "pos int, gold int, pred int")
    got = sorted(H.running_accuracy(df, "gold", "pred", ["pos"]).collect(), key=lambda r: r["rows_so_far"])
    assert [r["rows_so_far"] for r in got] == [1, 2, 3, 4, 5, 6] and got[-1]["correct_so_far"] == 4
    hits = 0
    for n, r in enumerate(got, 1):
        hits += r["gold"] == r["pred"]
        assert (r["correct_so_far"], r["running_accuracy"]) == (hits, hits / n)


def metrics(spark, rows, fold="int"):
    return spark.createDataFrame(rows, f"fold {fold}, eval_accuracy double, eval_macro_f1 double, eval_loss double")


def test_cv_summary(spark):
    one = H.cv_summary(metrics(spark, [(0, 0.8, 0.7, 1.0)])).first()
    assert (one["mean_eval_accuracy"], one["std_eval_accuracy"]) == (0.8, 0.0)
    two = H.cv_summary(metrics(spark, [(1, 0.8, 0.7, 1.0), (0, 0.9, 0.7, 1.0)])).first()
    assert two["mean_eval_accuracy"] == pytest.approx(0.85)
    assert two["std_eval_accuracy"] == pytest.approx(0.05)
    assert two["completed_folds"] == [0, 1]


def test_fold_metric_upsert(spark):
    old = metrics(spark, [(1, 0.1, 0.1, 1.0), (0, 0.2, 0.2, 1.0)])
    new = metrics(spark, [(1, 0.9, 0.9, 0.5)])
    got = [(r["fold"], r["eval_accuracy"]) for r in C.merge_fold_metrics(old, new).collect()]
    assert got == [(0, 0.2), (1, 0.9)]
    text = metrics(spark, [("1", 0.1, 0.1, 1.0)], "string")
    assert C.merge_fold_metrics(text, new).count() == 1


def test_unreadable_fold_metrics_only_warn(spark, tmp_path):
    bad = tmp_path / "m.json"
    bad.write_text("{not json", encoding="utf-8")
    with pytest.warns(UserWarning, match="could not be read"):
        assert C.read_fold_metrics(spark, str(bad)).count() == 0
    good = tmp_path / "g.json"
    good.write_text('{"fold_metrics":[{"fold":1,"eval_accuracy":0.5,"eval_macro_f1":0.4,"eval_loss":1.0},'
                    '{"fold":"x","eval_accuracy":0.5,"eval_macro_f1":0.4,"eval_loss":1.0}]}', encoding="utf-8")  # fmt: skip
    merged = C.merge_fold_metrics(C.read_fold_metrics(spark, str(good)), metrics(spark, [(0, 0.9, 0.9, 0.1)]))
    assert [r["fold"] for r in merged.collect()] == [0, 1]


def test_best_run_prefers_the_lower_step(spark):
    df = spark.createDataFrame([(2, 0.5), (1, 0.5), (0, 0.4)], "step int, eval_macro_f1 double")
    assert C.best_run(df).first()["step"] == 1
