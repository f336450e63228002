"""Days of the log in one file each, and runs that publish at the same time."""

import datetime as dt
import glob
import threading

import pytest
from labelflow.operators import classify as L
from labelflow.operators.runs import read_fold_metrics
from labelflow.sources import activity as A
from labelflow.sources import files as IO
from labelflow.streaming import activity as SA
from labelflow.streaming import scoring as SS


def entries(spark, texts, day):
    rows = [(dt.datetime.fromisoformat(f"{day} 10:00:{i:02d}.000123"), t, "1", None, 1, True, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, A.ACTIVITY).repartition(3)


def texts(spark, path, days=3, as_of="2024-03-07"):
    return sorted(r["input_text"] for r in A.read_activity(spark, path, days, as_of).collect())


def test_closed_days_become_one_file(spark, tmp_path):
    path = str(tmp_path / "log")
    out, state = str(tmp_path / "copy"), str(tmp_path / "state")
    stream = lambda: SS.score_stream(SA.stream_activity(spark, path), lambda df: df, out, state).awaitTermination()
    for day, names in (("2024-03-05", "abcde"), ("2024-03-06", "fgh"), ("2024-03-07", "xyz")):
        A.append_activity(entries(spark, names, day), path)
    stream()
    assert A.merge_days(spark, path, "2024-03-07") == ["2024-03-05", "2024-03-06"]
    assert texts(spark, path) == sorted("abcdefghxyz")
    assert len(glob.glob(f"{path}-merged/date=2024-03-05/v=1/part-*.json")) == 1
    A.append_activity(entries(spark, "i", "2024-03-06"), path)  # late, beside the merged day
    assert texts(spark, path) == sorted("abcdefghixyz")
    stream()
    assert A.merge_days(spark, path, "2024-03-07") == ["2024-03-06"]
    assert not glob.glob(f"{path}/date=2024-03-05/part-*") and texts(spark, path) == sorted("abcdefghixyz")
    assert A.merge_days(spark, path, "2024-03-07") == [] and texts(spark, path) == sorted("abcdefghixyz")
    stream()
    copied = spark.read.parquet(out)
    assert sorted(r["input_text"] for r in copied.collect()) == sorted("abcdefghixyz")
    row = A.read_activity(spark, path, 3, "2024-03-07").where("input_text = 'i'").first()
    assert row["timestamp"] == dt.datetime(2024, 3, 6, 10, 0, 0, 123) and row["date"] == dt.date(2024, 3, 6)


def test_two_runs_at_once_keep_both_their_folds(spark, tmp_path):
    base, words = str(tmp_path / "metrics"), {0: "謝謝", 1: "會議", 2: "閉嘴", 3: "厲害"}
    rows = spark.createDataFrame([(i, words[i % 4] * (1 + i % 3), i % 4) for i in range(48)], "id long, text string, label int")
    failed = []

    def run(folds):
        try:
            L.cross_validate(rows, 3, folds=folds, metrics_path=base)
        except Exception as problem:  # noqa: BLE001 - told by the main thread
            failed.append(problem)

    threads = [threading.Thread(target=run, args=((f,),)) for f in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    stored = read_fold_metrics(spark, f"{base}/run_id=3").selectExpr("CAST(fold AS INT) AS fold")
    assert sorted(r["fold"] for r in stored.collect()) == [0, 1, 2]


def test_a_taken_number_is_tried_again_and_a_dead_claim_is_passed(spark, tmp_path):
    base, seen = str(tmp_path / "runs"), []

    def write(before, at):
        seen.append(before)
        if len(seen) == 1:  # another run publishes meanwhile
            spark.range(1).write.parquet(f"{base}/run_id=1")
        spark.range(2).write.parquet(at)

    assert IO.publish_run(spark, base, write) == f"{base}/run_id=2"
    assert seen == [None, f"{base}/run_id=1"]
    (tmp_path / "runs" / "_claim-3").write_text("")
    waits = []
    assert IO.publish_run(spark, base, write, patience=1.0, sleep=waits.append) == f"{base}/run_id=4"
    assert sum(waits) >= 1.0 and not glob.glob(f"{base}/_staged*")
    assert IO.next_run_id(spark, base) == 5


@pytest.mark.parametrize("n", [0, 1])
def test_nothing_to_merge(spark, tmp_path, n):
    path = str(tmp_path / "log")
    if n:
        A.append_activity(entries(spark, "a", "2024-03-07"), path)
    assert A.merge_days(spark, path, "2024-03-07") == [] and len(texts(spark, path)) == n
