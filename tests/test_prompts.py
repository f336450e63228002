import pytest
from labelflow.operators import prompts as E


def tasks(spark, rows):
    return spark.createDataFrame(rows, "text string, target int, original_score int")


def one(df):
    return df.first()["prompt"]


def test_basic_prompt_forms(spark):
    convert = one(E.rewrite_prompt_basic(tasks(spark, [("句", 2, 4)])))
    assert "第 4 級（四級）" in convert and "第 2 級（二級）" in convert and "60" in convert
    plain = one(E.rewrite_prompt_basic(tasks(spark, [("句", 2, 2)])))
    assert plain == one(E.rewrite_prompt_basic(tasks(spark, [("句", 2, None)])))
    assert "四級" not in plain
    assert E.TARGETS[2] in one(E.rewrite_prompt_basic(tasks(spark, [("句", 9, None)])))
    assert "第-1級" in one(E.rewrite_prompt_basic(tasks(spark, [("句", 2, -1)])))


def test_example_prompt(spark):
    examples = spark.createDataFrame([(2, "乙", 1), (1, "甲", 1), (3, "丙", 3)], "id int, text string, score int")
    table = E.examples_by_level(examples, ["id"])
    rows = E.rewrite_prompt_data(E.attach_examples(tasks(spark, [("句", 1, 2), ("句", 4, 4), ("句", 5, 1)]), table))
    by_target = {r["target"]: r["prompt"] for r in rows.collect()}
    assert "2 個例句：\n- 甲\n- 乙\n" in by_target[1]
    assert E.NO_EXAMPLES in by_target[4]
    assert by_target[5] == E.INVALID_LEVEL


def test_scoring_prefix(spark):
    examples = spark.createDataFrame([(2, "乙", 4), (1, "甲", 1)], "id int, text string, score int")
    prefix = E.scoring_prefix(examples, ["id"], 9, 3).first()[0]
    assert prefix.endswith("「甲」 → 1\n「乙」 → 4\n")
    assert prefix.startswith(E.SCALES[3])
    assert E.HARD_NEGATIVES in E.scoring_prefix(examples, ["id"], 9, hard_negatives=True).first()[0]
    assert E.scoring_prefix(examples, ["id"], 9, scale="own").first()[0].startswith("own\n\n")
    prompt = one(E.scoring_prompt(tasks(spark, [("句", 1, 1)]), E.scoring_prefix(examples, ["id"], 9)))
    assert prompt.endswith("「句" + E.SCORING_SUFFIX[1])
    with pytest.raises(ValueError, match="version"):
        E.scale_text(5)


def test_bad_example_tables_stop_the_job(spark):
    layout = "id int, text string, score int"
    with pytest.raises(Exception, match="at least one row"):
        E.scoring_prefix(spark.createDataFrame([], layout), ["id"], 5).collect()
    many = spark.createDataFrame([(i, "x", 1) for i in range(11)], layout)
    assert E.scoring_prefix(many, ["id"], 10).first()[0].count("「x」") == 10


def test_prompts_show_no_more_examples_than_asked(spark):
    many = spark.range(20_000).selectExpr("id", "concat('t', id) AS text", "cast(1 + id % 4 AS int) AS score")
    assert E.scoring_prefix(many, ["id"], 40).first()[0].count("」 → ") == 40
    judge = E.judge_prefix(many, ["id"], 5).first()[0]
    assert judge.count("  • 「") == 20 and "「t19」" in judge and "「t20」" not in judge
    rows = {r["level"]: r["n_examples"] for r in E.examples_by_level(many, ["id"], 30).collect()}
    assert rows == {1: 30, 2: 30, 3: 30, 4: 30}


def test_paired_examples(spark):
    pairs = spark.createDataFrame([("原", {1: "a", 3: "c"})], "original string, by_level map<int,string>")
    prefix = E.scoring_prefix(pairs, ["original"], 10).first()[0]
    assert prefix.endswith("原句：原\n1: a\n2: \n3: c\n4: \n\n")


def test_judge_prefix_groups_by_level(spark):
    examples = spark.createDataFrame([(3, "丙", 4), (2, "乙", 1), (1, "甲", 1)], "id int, text string, score int")
    prefix = E.judge_prefix(examples, ["id"]).first()[0]
    assert prefix.index("甲") < prefix.index("乙") < prefix.index("【Level 4") < prefix.index("丙")


def test_instruction_nulls_are_empty(spark):
    df = spark.createDataFrame([("do", None, None)], "instruction string, input string, output string")
    assert one(E.instruction_text(df)) == E.INSTRUCTION % ("do", "", "")
    assert "%" not in one(E.instruction_text(df))


def test_built_in_pairs(spark):
    prefix = E.scoring_prefix(E.default_pairs(spark), ["position"], 10).first()[0]
    assert prefix.count("原句：") == 10
    assert prefix.index(E.PAIRED_EXAMPLES[0][0]) < prefix.index(E.PAIRED_EXAMPLES[9][0])
