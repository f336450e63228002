import json
import os

import pytest
from labelflow.operators.ranking import dense_position
from labelflow.schemas import ACTIVITY
from labelflow.session import scratch_path
from labelflow.sources import activity as A
from labelflow.sources import files as IO
from labelflow.streaming import activity as SA
from labelflow.streaming import scoring as SS
from pyspark.sql import functions as F

AWKWARD = ['say "hi", ok', " two\nlines\r\n ", "臺　", "\\back\\", "", "a,b", "'", "\ttab"]


def test_csv_round_trip_keeps_awkward_texts(spark, tmp_path):
    df = spark.createDataFrame([(t, i, None) for i, t in enumerate(AWKWARD)], "text string, n int, other string")
    path = IO.write_results_csv(df, str(tmp_path / "out"))
    back = IO.read_scoring_csv(spark, path, "text string, n int, other string").orderBy("n").collect()
    assert [r["text"] for r in back] == AWKWARD
    assert all(r["other"] is None for r in back)


def test_csv_files_have_few_records_each(spark, tmp_path):
    """A file is read by one task, so the rows of a task must not all go to one file."""
    path = IO.write_results_csv(spark.range(3 * IO.FILE_ROWS).coalesce(1).withColumn("text", F.lit("a\nb")), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.csv"))) == 3
    assert IO.read_scoring_csv(spark, path, "id long, text string").distinct().count() == 3 * IO.FILE_ROWS


def test_csv_with_byte_order_mark(spark, tmp_path):
    file = tmp_path / "bom.csv"
    file.write_bytes("﻿text,score\n臺北,2\n".encode())
    assert IO.read_scoring_csv(spark, str(file), "text string, score int").first().asDict() == {"text": "臺北", "score": 2}


def test_jsonl_modes_and_positions(spark, tmp_path):
    file = tmp_path / "x.jsonl"
    file.write_text('{"text":"a","score":"1"}\n\nbroken\n{"text":"b","score":"4"}\n', encoding="utf-8")
    rows = IO.read_jsonl(spark, str(file), "text string, score string").cache().collect()
    assert [r["text"] for r in rows] == ["a", None, "b"]
    assert rows[1]["_corrupt_record"] == "broken"
    with pytest.raises(Exception, match="FAILED_READ_FILE|MALFORMED"):
        IO.read_jsonl(spark, str(file), "text string, score string", "FAILFAST").collect()
    placed = dense_position(IO.read_jsonl(spark, str(file), "text string, score string", position=True), list(IO.POSITION))
    assert [r["text"] for r in placed.orderBy("position").collect()] == ["a", None, "b"]


def test_json_lines_keep_nulls_and_letters(spark, tmp_path):
    path = IO.write_jsonl(spark.createDataFrame([("臺", None)], "text string, label int"), str(tmp_path / "o"))
    written = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "o").glob("part-*"))
    assert written.strip() == '{"text":"臺","label":null}'
    assert path


def test_json_array(spark, tmp_path):
    file = tmp_path / "x.json"
    file.write_text(json.dumps([{"text": "a"}, {"text": "b\nc"}]), encoding="utf-8")
    assert [r["text"] for r in IO.read_json_array(spark, str(file), "text string").collect()] == ["a", "b\nc"]
    file.write_text('{"text": "a"}', encoding="utf-8")
    with pytest.raises(Exception, match="must be a list"):
        IO.read_json_array(spark, str(file), "text string").collect()


def test_runs_never_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("m", 1)], "model string, n int")
    base = str(tmp_path / "runs")
    assert [IO.run_output(df, base)[-1] for _ in range(3)] == ["1", "2", "3"]
    with pytest.raises(Exception, match="exists"):
        IO.run_output(df, base, run_id=2)
    assert spark.read.parquet(base).count() == 3


def test_report_text(spark, tmp_path):
    lines = IO.report_lines({"model": "m"}, "p" * 2000, 93.4065, [[1, 0], [2, 3]])
    path = IO.write_report(spark, lines, str(tmp_path / "report"))
    text = "\n".join(r["value"] for r in spark.read.text(path).collect())
    assert "accuracy: 93.41%" in text
    assert "2 3" in text
    assert "p" * 1000 in text
    assert "p" * 1001 not in text


def entries(spark, n=60, day="2024-03-05"):
    rows = [(i, f"{day} 10:00:{i:02d}", "輸入" * 20, "4", "out", 1 + i % 4, i % 2 == 0) for i in range(n)]
    layout = "event_id int, at string, input_text string, target_level string, output_text string, predicted_score int, success boolean"
    return spark.createDataFrame(rows, layout).selectExpr("*", "to_timestamp(at) AS timestamp", "'localhost' AS ip_address").drop("at")


def test_activity_log(spark, tmp_path):
    path = str(tmp_path / "log")
    for day in ("2024-03-05", "2024-03-06", "2024-03-09"):
        A.append_activity(entries(spark, 3, day), path)
    A.append_activity(entries(spark, 2, "2024-03-09"), path)
    assert A.read_activity(spark, path, 1, "2024-03-09").count() == 5
    assert A.read_activity(spark, path, 4, "2024-03-09").count() == 8
    assert A.read_activity(spark, path, 1, "2024-03-08").count() == 0
    assert sorted(p.name for p in (tmp_path / "log").glob("date=*")) == ["date=2024-03-05", "date=2024-03-06", "date=2024-03-09"]


def test_digest(spark):
    assert A.activity_digest(entries(spark, 0)).first()["digest"] == A.EMPTY_NOTICE
    text = A.activity_digest(entries(spark), 50, "event_id").first()["digest"]
    assert text.startswith("📊 最近使用記錄 (共 50 筆)\n\n❌ 2024-03-05T10:00:59\n輸入: " + "輸入" * 15 + "...\n")
    assert text.count("---\n") == 50


def test_rollup_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    for day in ("2024-03-05", "2024-03-06", "2024-03-07"):
        A.append_activity(entries(spark, 8, day), path)
    stored = spark.read.schema(f"{ACTIVITY}, date date").json(path)
    batch = sorted(tuple(r) for r in SA.daily_rollup(stored).collect())
    stream = SS.latest_result(SA.daily_rollup(SA.stream_activity(spark, path, 1)), str(tmp_path / "table"), str(tmp_path / "state"))
    assert sorted(tuple(r) for r in stream.collect()) == batch


def test_append_mode_emits_closed_days_only(spark, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    for day in ("2024-03-05", "2024-03-06", "2024-03-07"):
        A.append_activity(entries(spark, 8, day), path)
    rollup = SA.daily_rollup(SA.stream_activity(spark, path))
    SS.score_stream(rollup, lambda df: df, out, str(tmp_path / "state")).awaitTermination()
    assert sorted(str(r["day"]) for r in spark.read.parquet(out).collect()) == ["2024-03-05", "2024-03-06"]


def test_stream_resumes_where_it_stopped(spark, tmp_path):
    path, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    run = lambda: SS.score_stream(SA.stream_activity(spark, path), lambda df: df, out, state).awaitTermination()
    A.append_activity(entries(spark, 4, "2024-03-05"), path)
    run()
    run()
    assert spark.read.parquet(out).count() == 4
    A.append_activity(entries(spark, 4, "2024-03-06"), path)
    run()
    assert spark.read.parquet(out).count() == 8


def test_scratch_paths_are_fresh_and_under_one_root(spark):
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b
    assert a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]


def test_fold_export(spark, tmp_path):
    from labelflow.plans.foldexport import export_folds

    records = spark.createDataFrame([(i, f"句{i}", str(1 + i % 4)) for i in range(44)], "id long, sentence string, score string")
    row = export_folds(records, str(tmp_path), 5, input_file="in.jsonl").first()
    assert row["input_file"] == "in.jsonl" and row["n_rows"] == 44 and len(row["folds"]) == 5
    for fold in row["folds"]:
        assert spark.read.json(fold["test_path"]).count() == fold["test_size"]
        assert spark.read.json(fold["train_path"]).count() == fold["train_size"]
    with pytest.raises(ValueError, match="without usable text"):
        export_folds(records.unionByName(records.limit(1).selectExpr("id", "'' AS sentence", "score")), str(tmp_path / "b"), 5)


def test_scratch_is_cleared(spark):
    from labelflow.session import clear_scratch, cut_lineage

    df = cut_lineage(spark.range(3))
    path = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
    assert os.path.exists(path)
    assert clear_scratch(spark) >= 1
    assert not os.path.exists(path)


@pytest.mark.parametrize("name", ["answers.parquet", "answers", "answers.parquet/lang=de", "answers/lang=de/day=1"])
def test_source_stem_of_a_folder_is_the_tables(spark, tmp_path, name):
    """A table in several files, in folders of partitions or not, is one input and has one name."""
    spark.range(20).repartition(3).write.parquet(f"{tmp_path}/{name}")
    rows = IO.with_source_stem(spark.read.parquet(f"{tmp_path}/{name.split('/')[0]}"), "stem")
    assert {r["stem"] for r in rows.select("stem").collect()} == {"answers"}


def test_source_stem_of_single_files_is_their_own(spark, tmp_path):
    for name in ("one.json", "two.json"):
        (tmp_path / name).write_text('{"a": 1}\n')
    rows = IO.with_source_stem(spark.read.schema("a int").json(str(tmp_path)), "stem")
    assert {r["stem"] for r in rows.select("stem").collect()} == {"one", "two"}
