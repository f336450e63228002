"""Late entries, state that shrinks, and running accuracy over batches."""

import datetime as dt

from labelflow.operators import metrics as H
from labelflow.sources.folders import numbered
from labelflow.streaming import rollup as SR
from labelflow.streaming import scoring as SS

ENTRY = "timestamp timestamp, target_level string, success boolean"


def put(spark, path, rows):
    spark.createDataFrame(rows, ENTRY).coalesce(1).write.mode("append").parquet(path)


def at(day, hour=10):
    return dt.datetime(2024, 3, day, hour)


def shown(df):
    return sorted((tuple(r) for r in df.selectExpr("day(day)", "target_level", "events", "success_rate", "status").collect()), key=repr)


def test_late_entries_stay_apart_and_state_shrinks(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    run = lambda: SR.run_rollup(spark.readStream.schema(ENTRY).parquet(inbox), out, state)
    put(spark, inbox, [(at(5), "1", True), (at(5), "1", False), (at(5), "2", None), (at(6), "2", True)])
    sizes = run()
    assert sizes[0] == 3 and sizes[-1] == 1  # day 5 closes: day 6 was seen at 10 o'clock
    put(spark, inbox, [(at(7), "1", True)])
    run()
    put(spark, inbox, [(at(5), "1", True), (at(5, 11), "1", True), (at(7), "1", False), (at(7, 12), None, True)])
    assert run()[-1] == 2
    expected = [
        (5, "1", 2, 0.5, "closed"), (5, "1", 2, 1.0, "late"), (5, "2", 1, None, "closed"), (6, "2", 1, 1.0, "closed"),
        (7, "1", 2, 0.5, "open"), (7, None, 1, 1.0, "open"),
    ]
    assert shown(SR.read_rollup(spark, out)) == sorted(expected, key=repr)
    before = len(numbered(spark, out, "batch"))
    SR.merge_batches(spark, out)
    assert len(numbered(spark, out, "batch")) == SR.KEEP < before
    run()
    put(spark, inbox, [(at(9), "1", True), (at(6), "2", True)])
    run()
    SR.merge_batches(spark, out)
    rows = {(r.day.day, r.target_level, r.status): r.events for r in SR.read_rollup(spark, out).collect()}
    assert rows == {
        (5, "1", "closed"): 2, (5, "1", "late"): 2, (5, "2", "closed"): 1, (6, "2", "closed"): 1, (6, "2", "late"): 1,
        (7, "1", "closed"): 2, (7, None, "closed"): 1, (9, "1", "open"): 1,
    }
    assert len(numbered(spark, out, "merged")) == 2


def test_rollup_of_nothing(spark, tmp_path):
    assert SR.read_rollup(spark, str(tmp_path / "none")).count() == 0
    SR.merge_batches(spark, str(tmp_path / "none"))


def test_running_accuracy_of_a_stream_equals_that_of_the_table(spark, tmp_path):
    rows = spark.range(900).selectExpr("id", "id div 300 AS part", "cast(id % 4 AS int) AS gold", "cast(id * 7 % 3 AS int) AS pred")
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in range(3):
        rows.where(f"part = {part}").coalesce(2).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(rows.schema).parquet(inbox)
        done = SS.running_accuracy_stream(stream, "gold", "pred", ["id"], out, state)
    expected = H.running_accuracy(rows, "gold", "pred", ["id"])
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, expected.collect()))
    again = SS.running_accuracy_stream(spark.readStream.schema(rows.schema).parquet(inbox), "gold", "pred", ["id"], out, state)
    assert again.count() == 900 and len(numbered(spark, f"{out}/totals", "batch")) <= 2


def test_latest_result_keeps_two_batches(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for i in range(4):
        spark.createDataFrame([(1, i)], "gold int, pred int").write.mode("append").parquet(inbox)
        stream = spark.readStream.schema("gold int, pred int").parquet(inbox)
        got = SS.latest_result(SS.live_accuracy(stream), out, state).first()
    assert (got["rows"], got["correct"]) == (4, 1) and len(numbered(spark, out, "batch")) == 2
