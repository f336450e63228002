"""Empty tables and rows without a class."""

from labelflow.operators import folds as D
from labelflow.operators import metrics as H
from labelflow.operators import ranking as R
from labelflow.operators import sampling as S
from labelflow.operators.tasks import assign_ids, default_ids, expand_targets, score_distinct
from pyspark.sql import functions as F


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, label int, text string, pred int")
    assert S.stratified_split(empty, "label", "id").count() == 0
    assert S.proportional_sample(empty, "label", "id", 5).count() == 0
    assert S.sample_n(empty, "id", 5, 1).count() == 0
    assert S.first_n_per_class(empty, "label", 3, ["id"]).count() == 0
    assert S.few_shot_sets(empty, "label", "id").count() == 0
    assert D.stratified_kfold(empty, "label", "id").count() == 0
    assert R.stable_rank(empty, ["label"], "id").count() == 0
    assert assign_ids(empty, ["id"], out="name").count() == 0
    assert H.running_accuracy(empty, "label", "pred", ["id"]).count() == 0
    assert H.accuracy(empty, "label", "pred").first()["rows"] == 0
    assert H.confusion(empty, "label", "pred", (1, 2)).count() == 4
    assert H.classification_report(empty, "label", "pred", (1, 2)).count() == 5
    assert expand_targets(empty, score="label").count() == 0
    scorer = lambda t: t.withColumn("predicted_score", F.lit(1))
    assert score_distinct(empty, "text", scorer, ["id"]).count() == 0


def test_rows_without_a_class_are_kept(spark):
    label = F.when(F.col("id") % 4 == 0, None).otherwise((F.col("id") % 3).cast("int"))
    df = spark.range(400).select("id", label.alias("label"))
    assert S.stratified_split(df, "label", "id").count() == 400
    folded = D.stratified_kfold(df, "label", "id", 5)
    sizes = [r["count"] for r in folded.where("label IS NULL").groupBy("fold").count().collect()]
    assert sizes == [20] * 5
    ranked = R.stable_rank(df, ["label"], "id")
    assert ranked.count() == 400
    assert ranked.where("label IS NULL").selectExpr("min(rank)", "max(rank)", "count(DISTINCT rank)").first() == (1, 100, 100)


def test_many_classes_with_null_and_text_ids_lose_no_row(spark):
    label = F.when(F.col("id") % 61 == 60, None).otherwise((F.col("id") % 61).cast("int"))
    df = spark.range(6100).select(F.concat(F.lit("n"), "id").alias("id"), label.alias("label"))
    folded = D.stratified_kfold(df, "label", "id", 5)
    assert {r["count"] for r in folded.groupBy("label", "fold").count().collect()} == {20}
    parts = S.stratified_split(df, "label", "id").groupBy("label", "part").count().collect()
    assert sum(r["count"] for r in parts) == 6100
    assert {(r["part"], r["count"]) for r in parts} == {("train", 80), ("test", 20)}
    assert S.proportional_sample(df, "label", "id", 610).groupBy("label").count().select("count").distinct().first()[0] == 10
    ranked = R.stable_rank(df, ["label"], "id")
    assert ranked.groupBy("label").agg(F.max("rank").alias("m"), F.countDistinct("rank").alias("d")).select("m", "d").distinct().collect() == [(100, 100)]


def test_ties_give_exactly_n(spark):
    df = spark.range(40).selectExpr("0 AS id", "cast(1 + id % 4 AS int) AS label")
    assert S.first_n_per_class(df, "label", 3, ["id"]).count() == 12


def test_default_ids_fill_gaps(spark):
    df = spark.createDataFrame([("x", 1), (None, 2), (None, 3)], "id string, pos int")
    got = default_ids(df, ["pos"]).orderBy("pos").collect()
    assert [r["id"] for r in got] == ["x", "2", "3"]
    assert [r["id"] for r in default_ids(df.drop("id"), ["pos"]).orderBy("pos").collect()] == [1, 2, 3]


def test_text_ids(spark):
    df = spark.range(300).select(F.concat(F.lit("n"), "id").alias("id"), (F.col("id") % 4).cast("int").alias("label"))
    folded = D.stratified_kfold(df, "label", "id", 3)
    assert sorted(r["count"] for r in folded.groupBy("label", "fold").count().collect()) == [25] * 12


def test_first_rows_carry_their_other_columns(spark):
    df = spark.range(100).selectExpr("id", "cast(1 + id % 4 AS int) AS label", "concat('t', id) AS text")
    got = S.first_n_per_class(df, "label", 2, ["id"]).collect()
    assert sorted((r["id"], r["text"], r["rn"]) for r in got) == [(i, f"t{i}", 1 + i // 4) for i in range(8)]
