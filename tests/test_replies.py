import pytest
from labelflow.functions import replies as R


def outputs(spark, parse, column, replies):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string")
    return [r[column] for r in parse(df).orderBy("i").collect()]


def test_marked_score(spark):
    replies = ["x【最終分數：3】1", "10", "89", "１", "", "　\n", None, "【最終分數：5】"]
    assert outputs(spark, R.parse_marked, "predicted_score", replies) == [3, 1, -1, -1, -3, -3, -3, -1]
    assert outputs(spark, R.parse_marked, "parse_path", replies) == [
        "marked", "fallback", "failed", "failed", "exhausted", "exhausted", "exhausted", "failed",
    ]


def test_integer_score(spark):
    replies = [None, " 4 ", "10", "分數４", "none", "", "-3", "a-3", "+2", "1_0", "４２", "2.0"]
    assert outputs(spark, R.parse_integer, "predicted_score", replies) == [-2, 4, 10, 4, -1, -1, -3, 3, 2, 10, 42, 2]


def test_first_digit(spark):
    assert outputs(spark, R.parse_first_digit, "model_score", ["10", "9", None]) == ["1", "解析失敗", "解析失敗"]


@pytest.mark.parametrize(
    ("reply", "expected"),
    [
        ("好的\n改寫為第 2 級：請坐。", "請坐。"),
        ("改寫為第３級: 快點！\n說明", "快點！"),
        ("坐下吧。\n這個改寫保留了原意", "坐下吧。"),
        ("原句是這樣", "原句是這樣"),
        ("請坐。\nSure, here it is.", "請坐。"),
        ("only ascii", "only ascii"),
        ("改寫為第 1 級：\n\n 慢慢來\n", "慢慢來"),
        ("", ""),
        (None, ""),
        (" \n　", ""),
        ("a" * 50_000, "a" * 50_000),
    ],
)
def test_clean_rewrite(spark, reply, expected):
    assert outputs(spark, R.clean_rewrite, "generated_text", [reply]) == [expected]


def test_first_line(values):
    assert values(R.first_line, ["\n a\nb", "", None, "x \ny"]) == ["a", "Error", "Error", "x "]
