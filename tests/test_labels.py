import pytest
from labelflow.operators import labels as L
from pyspark.sql import functions as F


def normalized(spark, values, kind, base=1):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["label_id"] for r in L.normalize_label(df, "v", base=base).orderBy("i").collect()]


def test_label_values_by_type(spark):
    assert normalized(spark, [1, 4, 0, 5, None], "int") == [0, 3, 0, None, None]
    assert normalized(spark, [2.0, 2.5, float("nan"), float("inf")], "double") == [1, None, None, None]
    texts = ["3", " 3 ", "2.0", "0", "中性", "4-酸", "sarcastic", "Sarcastic"]
    assert normalized(spark, texts, "string") == [2, 2, None, None, 1, 3, 3, None]
    assert normalized(spark, [True, False], "boolean") == [0, 0]
    assert normalized(spark, [0, 3, 4], "int", base=0) == [0, 3, None]


def test_variant_labels_keep_their_type(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    lines = ['{"id":1,"label":2}', '{"id":2,"label":2.0}', '{"id":3,"label":"2.0"}', '{"id":4,"label":"2"}',
             '{"id":5,"label":true}', '{"id":6,"label":null}', '{"id":7}', '{"id":8,"label":""}', '{"id":9,"label":2.5}']
    path.write_text("\n".join(lines), encoding="utf-8")
    df = spark.read.schema("id long, label variant").json(str(path)).withColumn("text", F.lit("t"))
    parts = L.sanitize(df, keep=("id",))
    assert {r["id"]: r["label"] for r in parts.clean.collect()} == {1: 1, 2: 1, 4: 1, 5: 0}
    assert {r["id"]: r["reason"] for r in parts.rejects.collect()} == {
        3: L.BAD_LABEL, 6: L.NO_LABEL, 7: L.NO_LABEL, 8: L.NO_LABEL, 9: L.BAD_LABEL,
    }


def test_label_pick(spark):
    df = spark.createDataFrame([("", "2", "9"), (None, None, "3")], ["label", "score", " Score "])
    assert [r["raw_label"] for r in L.resolve_label(df).collect()] == ["2", "3"]
    zero = spark.createDataFrame([(0, "4")], "label int, score string")
    assert L.resolve_label(zero).first()["raw_label"] == "0"


def test_text_pick(spark):
    one = lambda **kw: L.resolve_text(
        spark.createDataFrame([tuple(kw.values())], ", ".join(f"{k} string" for k in kw))
    ).first()["resolved_text"]
    assert one(sentence="s", text="t") == "s"
    assert one(sentence="", text="t") == "t"
    assert one(instruction=" a ", input=" b ") == "a\n\nb"
    assert one(instruction="a", input=None) == "a"
    assert one(instruction=None, input=None) == ""
    assert one(input="b") == "b"
    assert one(text="") is None


def test_sanitize_fails_when_nothing_is_left(spark):
    df = spark.createDataFrame([("t", 9)], "text string, label int")
    with pytest.raises(ValueError, match="left no rows"):
        L.sanitize(df).report()
    with pytest.raises(Exception, match="unsupported label"):
        L.sanitize(df, on_error="fail").clean.collect()


def test_sanitize_report(spark):
    df = spark.createDataFrame([("t", 1)] + [("t", 9)] * 5, "text string, label int")
    report = L.sanitize(df).report()
    assert report["dropped"] == 5
    assert len(report["samples"]) == 3


def test_required_columns(spark):
    df = spark.createDataFrame([(1,)], "input int")
    with pytest.raises(ValueError, match="instruction, output"):
        L.require_columns(df, ["output", "input", "instruction"])
    assert L.first_present(df, ["text", "input"]) == "input"


def test_scoring_input_needs_output_and_target(spark):
    with pytest.raises(ValueError, match="target"):
        L.to_scoring_input(spark.createDataFrame([("a",)], "generated_text string"))
