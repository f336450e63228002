import pytest
from labelflow.operators import classify as L
from labelflow.operators.folds import stratified_kfold
from labelflow.operators.runs import read_fold_metrics

WORDS = {0: "謝謝麻煩", 1: "會議時間", 2: "閉嘴煩死", 3: "真厲害呢"}


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, WORDS[i % 4] * (1 + i % 3) + "的了"[i % 2], i % 4) for i in range(48)]
    return spark.createDataFrame(data, "id long, text string, label int").cache()


def test_separable_classes_are_learned(spark, rows, tmp_path):
    folded = stratified_kfold(rows, "label", "id", 3)
    result = L.train_fold(folded, 1, (0.5, 1.0), str(tmp_path))
    assert result.metrics["eval_accuracy"] == 1.0
    assert result.candidates.count() == 2
    model = L.PipelineModel.load(str(tmp_path / "fold_1"))
    metrics = L.evaluate(model, rows, str(tmp_path / "rows"), str(tmp_path / "report")).first()
    assert metrics["accuracy"] == 1.0
    assert metrics["confusion_matrix"] == [[12 if i == j else 0 for j in range(4)] for i in range(4)]
    assert [r["support"] for r in metrics["classification_report"]] == [12] * 4
    single = L.predictions(model, spark.createDataFrame([("煩死",)], "text string")).first()
    assert single["pred"] == 2


def test_folds_run_one_by_one_are_merged(spark, rows, tmp_path):
    path = str(tmp_path / "metrics")
    L.cross_validate(rows, 3, folds=(0,), metrics_path=path)
    assert read_fold_metrics(spark, f"{path}/run_id=1").count() == 1
    merged, summary = L.cross_validate(rows, 3, folds=(2,), metrics_path=path)
    assert [r["fold"] for r in merged.collect()] == [0, 2]
    assert summary.first()["completed_folds"] == [0, 2]
    assert read_fold_metrics(spark, f"{path}/run_id=2").count() == 2
    with pytest.raises(ValueError, match="no fold"):
        L.cross_validate(rows, 3, folds=())


def test_small_classes_are_refused(spark):
    few = spark.createDataFrame([(i, "x", i % 4) for i in range(8)], "id long, text string, label int")
    with pytest.raises(ValueError, match="k=5 is too large"):
        L.cross_validate(few, 5)


def test_long_texts_keep_a_finite_loss(spark, rows):
    folded = stratified_kfold(rows, "label", "id", 3)
    model = L.train_fold(folded, 0).model
    long = spark.createDataFrame([(1, WORDS[0] * 20_000, 3)], "id long, text string, label int")
    assert 0 < L.predictions(model, long).first()["loss"] < float("inf")


def test_whole_cross_validation_run(spark, rows, tmp_path):
    from labelflow.plans.crossval import cross_validation_run

    records = rows.selectExpr("id", "text", "label + 1 AS score")
    extra = spark.createDataFrame([(1, "會議", "2"), (2, "", "2"), (3, "x", "9")], "id long, sentence string, label string")
    only = cross_validation_run(records, extra, k=3, split_only=True)
    assert only.dropped["dropped"] == 2
    assert sorted(r["test_size"] for r in only.sizes.collect()) == [16, 16, 17]
    full = cross_validation_run(records, extra, k=3, folds=(1,), model_dir=str(tmp_path))
    assert full.metrics.first()["eval_accuracy"] == 1.0
    assert (tmp_path / "fold_1").exists()
