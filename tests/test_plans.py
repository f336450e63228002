"""What the physical plans must and must not contain."""

import re

import pytest
from labelflow.operators import folds as D
from labelflow.operators import metrics as H
from labelflow.operators import sampling as S
from labelflow.operators import tasks as T
from labelflow.operators.inference import HashModel, ModelSpec, generate
from labelflow.operators.prompts import examples_by_level, attach_examples, scoring_prefix, scoring_prompt
from labelflow.operators.ranking import stable_rank
from labelflow.sources import activity as A
from labelflow.sources import views as V
from labelflow.functions import replies as R


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return re.findall(r"(?<!Broadcast)Exchange (\w+)", plan(df))


@pytest.fixture
def predicted(spark, folder):
    return V.predicted(spark, folder).select("id", "gold", "pred")


def test_splits_do_not_shuffle_rows(predicted):
    for df in (
        S.stratified_split(predicted, "gold", "id"),
        S.sample_n(predicted, "id", 1000, 1),
        D.stratified_kfold(predicted, "gold", "id"),
    ):
        assert shuffles(df) == []


def test_expansion_and_parsing_are_narrow(spark, folder, predicted):
    assert shuffles(T.expand_targets(predicted, score="gold")) == []
    grid = T.experiment_grid(predicted, ["a", "b"], {"x": False})
    assert shuffles(grid) == [] and "Join" not in plan(grid)
    raw = V.raw_replies(spark, folder)
    for parsed in (R.parse_marked(raw), R.parse_integer(raw), R.clean_rewrite(raw)):
        assert shuffles(parsed) == [] and "Python" not in plan(parsed)


def test_ranks_never_window_over_a_whole_class(predicted):
    text = plan(stable_rank(predicted.select("id", "gold"), ["gold"], "id"))
    assert "SinglePartition" not in text
    assert re.search(r"Window \[row_number\(\) windowspecdefinition\(gold#\d+, _b#\d+", text)


def test_top_rows_per_class_are_cut_before_the_shuffle(predicted):
    text = plan(S.first_n_per_class(predicted, "gold", 30, ["id"]))
    assert text.count("WindowGroupLimit") == 2


def test_prompts_add_no_join(spark, folder):
    rows = V.table(spark, folder, "documents").selectExpr("doc_id AS id", "text", "1 AS target")
    few = S.first_n_per_class(V.labeled(spark, folder), "score", 5, ["id"])
    for df in (
        scoring_prompt(rows, scoring_prefix(few, ["id"], 9)),
        attach_examples(rows, examples_by_level(few, ["id"])),
    ):
        outer = plan(df).split("Subquery")[0]
        assert "Join" not in outer and "Exchange" not in outer


def test_metrics_aggregate_before_the_shuffle_and_read_two_columns(predicted):
    for df in (H.classification_report(predicted, "gold", "pred", (1, 2, 3, 4)), H.macro_f1(predicted, "gold", "pred")):
        text = plan(df)
        assert text.count("FileScan") == 1
        assert "ReadSchema: struct<l_partkey:bigint,l_linenumber:int>" in text
        first = text.rindex("Exchange hashpartitioning(gold")
        assert "partial_count(1)" in text[first:]


def test_fold_summary_reads_the_data_once(spark, predicted):
    rows = D.stratified_kfold(predicted.selectExpr("id", "gold - 1 AS label"), "label", "id")
    assert plan(D.fold_summary(rows, 5)).count("/lineitem.parquet]") == 1


def test_only_the_prompt_goes_to_python(spark, folder):
    docs = V.table(spark, folder, "documents")
    text = plan(generate(docs, ModelSpec(HashModel), "text"))
    assert re.search(r"ArrowEvalPython \[run\(struct\(text, text#\d+\)\)", text)


def test_activity_reads_only_the_wanted_days(spark, folder, tmp_path):
    path = A.append_activity(V.activity(spark, folder), str(tmp_path / "log"))
    files = A.read_activity(spark, path, 3, "2024-01-10").inputFiles()
    assert {re.search(r"date=([0-9-]+)/", f)[1] for f in files} == {"2024-01-08", "2024-01-09", "2024-01-10"}
    late = A.read_activity(spark, path, 3, "2024-02-01")
    assert {str(r["date"]) for r in late.select("date").distinct().collect()} <= {"2024-01-30", "2024-01-31", "2024-02-01"}
    assert A.read_activity(spark, path, 3, "2030-01-01").count() == 0
    assert "TakeOrderedAndProject" in plan(A.recent_activity(A.read_activity(spark, path, 3, "2024-01-10")))
