"""Checked queries: sources, sinks, the activity log, and streams. Files go to the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.replies import parse_marked
from ..operators import folds as D
from ..operators.inference import NO_WAIT, HashModel, ModelSpec, score_table
from ..operators.metrics import accuracy
from ..operators.prompts import fixed_prompt
from ..operators.ranking import dense_position
from ..plans.foldexport import export_folds
from ..schemas import ACTIVITY
from ..session import scratch_path
from ..sources import activity as A
from ..sources import files as IO
from ..sources import views as V
from ..streaming import activity as SA
from ..streaming import rollup as SR
from ..streaming import scoring as SS
from .prompting import _FIXED, _digit
from .registry import folded_sql, query, six, text_md5, with_views

_ROUND_TRIP = with_views("SELECT id, md5(text) AS text_md5, score FROM labeled", "labeled")


def _digested(df):
    return df.select("id", text_md5("text").alias("text_md5"), F.col("score").cast("int").alias("score"))


@query("a1_read_jsonl", _ROUND_TRIP)
def a1_read_jsonl(spark, folder):
    rows = V.labeled(spark, folder).withColumn("score", F.col("score").cast("string"))
    path = IO.write_jsonl(rows, scratch_path(spark, "jsonl"))
    return _digested(IO.read_jsonl(spark, path, "id long, text string, score string", "FAILFAST"))


@query(
    "a1_file_positions",
    with_views("SELECT id, row_number() OVER (ORDER BY id) - 1 AS position FROM labeled", "labeled"),
)
def a1_file_positions(spark, folder):
    """Rows written in id order get dense positions in that order when read back."""
    rows = V.labeled(spark, folder).repartitionByRange(8, "id").sortWithinPartitions("id")
    path = IO.write_jsonl(rows, scratch_path(spark, "positions"))
    stored = IO.read_jsonl(spark, path, "id long, text string", "PERMISSIVE", position=True)
    return dense_position(stored, list(IO.POSITION)).select("id", "position")


@query("a2_read_json_array", _ROUND_TRIP)
def a2_read_json_array(spark, folder):
    """One array file per run of 4096 ids, so that no group grows with the table."""
    rows = V.labeled(spark, folder).withColumn("chunk", F.floor(F.col("id") / 4096))
    record = F.to_json(F.struct("id", "text", "score"))
    arrays = rows.groupBy("chunk").agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("value"))
    path = scratch_path(spark, "arrays")
    arrays.write.partitionBy("chunk").text(path)
    return _digested(IO.read_json_array(spark, path, "id long, text string, score int"))


_SCORING = with_views("SELECT md5(text) AS text_md5, target, md5(text || '\"') AS output_md5, 'm' AS model_name FROM tasks", "tasks")


def _scoring_csv(spark, folder, split):
    rows = V.tasks(spark, folder).select(
        "text", "target", F.concat("text", F.lit('"')).alias("output"), F.lit("m").alias("model_name"), F.lit("p").alias("prompt_type")
    )
    stored = IO.read_scoring_csv(spark, IO.write_results_csv(rows, scratch_path(spark, "scoring-csv")), split=split)
    return stored.select(
        text_md5("text").alias("text_md5"), "target", text_md5("output").alias("output_md5"), "model_name"
    )


@query("a3_read_scoring_csv", _SCORING)
def a3_read_scoring_csv(spark, folder):
    return _scoring_csv(spark, folder, False)


@query("a3_read_split_csv", _SCORING)
def a3_read_split_csv(spark, folder):
    """The same files, each read by as many tasks as its size asks for."""
    return _scoring_csv(spark, folder, True)


@query(
    "a4_concat_datasets",
    """SELECT doc_id AS id, md5(text) AS text_md5, lang FROM documents
UNION ALL SELECT item_id, md5(text), NULL FROM benchmark UNION ALL SELECT doc_id, md5(text), lang FROM documents WHERE lang = 'de'""",
)
def a4_concat_datasets(spark, folder):
    docs = V.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), text_md5("text").alias("text_md5"), "lang")
    extra = V.table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), text_md5("text").alias("text_md5"))
    return IO.concat_datasets(docs, extra, docs.where("lang = 'de'"))


@query(
    "a4_dataset_sizes",
    """SELECT 'train' AS dataset, CAST(count(*) AS BIGINT) AS rows FROM documents UNION ALL SELECT 'extra', count(*) FROM benchmark
UNION ALL SELECT NULL, (SELECT count(*) FROM documents) + (SELECT count(*) FROM benchmark)""",
)
def a4_dataset_sizes(spark, folder):
    return IO.dataset_sizes(train=V.table(spark, folder, "documents"), extra=V.table(spark, folder, "benchmark"))


@query("a5_write_results_csv", _ROUND_TRIP)
def a5_write_results_csv(spark, folder):
    path = IO.write_results_csv(V.labeled(spark, folder), scratch_path(spark, "csv"))
    return _digested(IO.read_scoring_csv(spark, path, "id long, text string, score int"))


@query(
    "a6_write_folds",
    with_views(
        folded_sql("labeled", "score", 5, 3407)
        + """SELECT v.fold, CASE WHEN v.fold = f.fold THEN 'test' ELSE 'train' END AS part, f.id, f.score, md5(f.text) AS text_md5
FROM folded f CROSS JOIN (VALUES (0), (1), (2), (3), (4)) v(fold)""",
        "labeled",
    ),
)
def a6_write_folds(spark, folder):
    folded = D.stratified_kfold(V.labeled(spark, folder), "score", "id", 5, 3407)
    path = IO.write_folds(folded, scratch_path(spark, "folds"), 5)
    stored = IO.read_jsonl(spark, path, "id long, text string, score int, fold int, part string", "FAILFAST")
    return stored.select("fold", "part", "id", "score", text_md5("text").alias("text_md5"))


@query(
    "a7_write_metrics",
    with_views(
        "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE gold = pred) AS BIGINT) AS correct, "
        "round(avg(CAST(gold = pred AS INTEGER)), 6) AS accuracy FROM predicted",
        "predicted",
    ),
)
def a7_write_metrics(spark, folder):
    path = IO.write_metrics(accuracy(V.predicted(spark, folder), "gold", "pred"), scratch_path(spark, "metrics"))
    stored = spark.read.schema("rows long, correct long, accuracy double").json(path)
    return stored.withColumn("accuracy", six("accuracy"))


@query(
    "a8_run_output",
    with_views(
        "SELECT v.run_id, p.model, CAST(count(*) AS BIGINT) AS n FROM predicted p CROSS JOIN (VALUES (1), (2)) v(run_id) GROUP BY 1, 2",
        "predicted",
    ),
)
def a8_run_output(spark, folder):
    """Two runs into one base folder: the second takes the next counter."""
    base = scratch_path(spark, "runs")
    rows = V.predicted(spark, folder)
    for _ in range(2):
        IO.run_output(rows, base)
    return spark.read.parquet(base).groupBy("run_id", "model").agg(F.count("*").alias("n"))


def _log(spark, folder) -> str:
    return A.append_activity(V.activity(spark, folder), scratch_path(spark, "activity"))


@query(
    "a9_append_activity",
    with_views(
        "SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, CAST(count(*) AS BIGINT) AS n, "
        "CAST(sum(microsecond(timestamp)) AS BIGINT) AS micros FROM activity GROUP BY 1",
        "activity",
    ),
)
def a9_append_activity(spark, folder):
    stored = spark.read.schema(f"{ACTIVITY}, date date").json(_log(spark, folder))
    micros = F.pmod(F.unix_micros("timestamp"), F.lit(60_000_000))
    return stored.groupBy(F.col("date").cast("string").alias("day")).agg(
        F.count("*").alias("n"), F.sum(micros).alias("micros")
    )


@query(
    "a10_read_activity",
    with_views(
        """SELECT strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS at, CAST(target AS VARCHAR) AS target_level, predicted_score, success, input_text, output_text
FROM activity WHERE CAST(timestamp AS DATE) > DATE '2024-01-20' - 7 AND CAST(timestamp AS DATE) <= DATE '2024-01-20'""",
        "activity",
    ),
)
def a10_read_activity(spark, folder):
    recent = A.read_activity(spark, _log(spark, folder), 7, "2024-01-20")
    at = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("at")
    return recent.select(at, "target_level", "predicted_score", "success", "input_text", "output_text")


_RECENT = """, recent AS (SELECT * FROM activity WHERE CAST(timestamp AS DATE) > DATE '2024-01-20' - 3 AND CAST(timestamp AS DATE) <= DATE '2024-01-20'
 ORDER BY timestamp DESC, event_id LIMIT 50)
"""


def _recent_days(spark, folder):
    rows = V.activity(spark, folder).withColumn("date", F.to_date("timestamp"))
    return A.last_days(rows, 3, "2024-01-20")


@query("i1_recent_activity", with_views(_RECENT + "SELECT event_id, input_text, success FROM recent", "activity"))
def i1_recent_activity(spark, folder):
    return A.recent_activity(_recent_days(spark, folder), 50, "event_id").select("event_id", "input_text", "success")


_SHORT = "CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n}) || '...' ELSE {c} END"


@query(
    "i2_activity_digest",
    with_views(
        _RECENT
        + f"""SELECT '📊 最近使用記錄 (共 ' || count(*) || ' 筆)' || chr(10) || chr(10) || string_agg(
 CASE WHEN success THEN '✅' ELSE '❌' END || ' ' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || chr(10) || '輸入: ' || {_SHORT.format(c="input_text", n=30)} || chr(10)
 || '目標: ' || target || ' | 結果: Level ' || predicted_score || chr(10) || '輸出: ' || {_SHORT.format(c="output_text", n=50)} || chr(10) || '---' || chr(10),
 '' ORDER BY timestamp DESC, event_id) AS digest FROM recent""",
        "activity",
    ),
)
def i2_activity_digest(spark, folder):
    return A.activity_digest(_recent_days(spark, folder), 50, "event_id")


@query(
    "j1_stream_activity",
    with_views(
        "SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, CAST(target AS VARCHAR) AS target_level, CAST(count(*) AS BIGINT) AS n FROM activity GROUP BY 1, 2",
        "activity",
    ),
)
def j1_stream_activity(spark, folder):
    """The daily folders read as a stream into a file sink, then counted."""
    stream = SA.stream_activity(spark, _log(spark, folder), files_per_trigger=16)
    out = scratch_path(spark, "activity-copy")
    SS.score_stream(stream, lambda df: df, out, scratch_path(spark, "stream-state")).awaitTermination()
    stored = spark.read.parquet(out)
    return stored.groupBy(F.col("date").cast("string").alias("day"), "target_level").agg(F.count("*").alias("n"))


_ROLLUP = with_views(
    """SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, CAST(target AS VARCHAR) AS target_level,
 CAST(count(*) AS BIGINT) AS events, round(avg(CAST(success AS INTEGER)), 6) AS success_rate FROM activity GROUP BY 1, 2""",
    "activity",
)


def _shown(rollup):
    return rollup.withColumns({"day": F.col("day").cast("string"), "success_rate": six("success_rate")})


@query("j2_daily_rollup", _ROLLUP)
def j2_daily_rollup(spark, folder):
    return _shown(SA.daily_rollup(V.activity(spark, folder)))


def _event_stream(spark, folder):
    """The events table as a stream of its files."""
    layout = V.table(spark, folder, "events").schema
    return spark.readStream.schema(layout).option("pathGlobFilter", "events.parquet").parquet(folder)


@query("j2_daily_rollup_stream", _ROLLUP)
def j2_daily_rollup_stream(spark, folder):
    rollup = SA.daily_rollup(V.as_activity(_event_stream(spark, folder)))
    state = scratch_path(spark, "rollup")
    return _shown(SS.latest_result(rollup, scratch_path(spark, "rollup-table"), state))


@query(
    "j2_rollup_late_entries",
    with_views(
        """, parts AS (SELECT *, event_id % 40 = 7 AS second FROM activity)
, mark AS (SELECT max(timestamp) FILTER (NOT second) - INTERVAL 1 HOUR AS w FROM parts)
, told AS (SELECT CAST(timestamp AS DATE) AS d, target, success, second AND CAST(timestamp AS DATE) + INTERVAL 1 DAY <= w AS late FROM parts, mark)
, ends AS (SELECT max(timestamp) - INTERVAL 1 HOUR AS w FROM activity)
SELECT CAST(d AS VARCHAR) AS day, CAST(target AS VARCHAR) AS target_level, CAST(count(*) AS BIGINT) AS events,
 round(avg(CAST(success AS INTEGER)), 6) AS success_rate,
 CASE WHEN late THEN 'late' WHEN d + INTERVAL 1 DAY <= any_value(w) THEN 'closed' ELSE 'open' END AS status FROM told, ends GROUP BY d, target, late""",
        "activity",
    ),
)
def j2_rollup_late_entries(spark, folder):
    """One entry in forty arrives in a second batch: those whose day is closed by then stay apart."""
    inbox, out = scratch_path(spark, "entries"), scratch_path(spark, "rollup")
    rows, state = V.activity(spark, folder), scratch_path(spark, "rollup-state")
    for second in (False, True):
        rows.where((F.col("event_id") % 40 == 7) == second).write.mode("append").parquet(inbox)
        SR.run_rollup(spark.readStream.schema(rows.schema).parquet(inbox), out, state)
    return _shown(SR.read_rollup(spark, out))


@query(
    "j3_score_stream",
    with_views(f"SELECT id, score, {_digit(_FIXED)} AS predicted_score FROM labeled", "labeled"),
)
def j3_score_stream(spark, folder):
    inbox, out = scratch_path(spark, "inbox"), scratch_path(spark, "scored")
    V.labeled(spark, folder).repartition(4, "id").write.parquet(inbox)
    stream = spark.readStream.schema("id long, text string, score int").option("maxFilesPerTrigger", 2).parquet(inbox)
    score = lambda df: score_table(df, ModelSpec(HashModel), fixed_prompt, parse_marked, NO_WAIT)
    SS.score_stream(stream, score, out, scratch_path(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(out).select("id", "score", "predicted_score")


@query(
    "j4_live_accuracy",
    "SELECT l_returnflag AS model, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE l_linenumber % 4 = l_partkey % 4) AS BIGINT) AS correct, "
    "round(avg(CAST(l_linenumber % 4 = l_partkey % 4 AS INTEGER)), 6) AS accuracy FROM lineitem GROUP BY 1",
)
def j4_live_accuracy(spark, folder):
    layout = V.table(spark, folder, "lineitem").schema
    stream = spark.readStream.schema(layout).option("pathGlobFilter", "lineitem.parquet").parquet(folder)
    rows = stream.select(
        F.col("l_returnflag").alias("model"), (F.col("l_linenumber") % 4).alias("gold"), (F.col("l_partkey") % 4).alias("pred")
    )
    state = scratch_path(spark, "live")
    return SS.latest_result(SS.live_accuracy(rows, by=("model",)), scratch_path(spark, "live-table"), state).withColumn(
        "accuracy", six("accuracy")
    )


@query(
    "j4_running_accuracy_stream",
    with_views(
        """, parts AS (SELECT *, row_number() OVER (ORDER BY pred = 2, id) AS rows_so_far FROM predicted)
SELECT id, CAST(rows_so_far AS BIGINT) AS rows_so_far, CAST(sum(CAST(gold = pred AS INTEGER)) OVER (ORDER BY rows_so_far) AS BIGINT) AS correct_so_far FROM parts""",
        "predicted",
    ),
)
def j4_running_accuracy_stream(spark, folder):
    """Two batches, the second with all predictions of level 2; each row carries the totals up to itself."""
    inbox, out, state = (scratch_path(spark, n) for n in ("inbox", "running", "running-state"))
    rows = V.predicted(spark, folder)
    for second in (False, True):
        rows.where((F.col("pred") == 2) == second).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(rows.schema).parquet(inbox)
        done = SS.running_accuracy_stream(stream, "gold", "pred", ["id"], out, state)
    return done.select("id", "rows_so_far", "correct_so_far")


@query("k_file_stem", "SELECT doc_id, 'documents' AS stem FROM documents")
def k_file_stem(spark, folder):
    return IO.with_source_stem(V.table(spark, folder, "documents"), "stem").select("doc_id", "stem")


@query(
    "d8_fold_export",
    with_views(
        folded_sql("labeled", "score", 2, 5)
        + """SELECT fold, CAST(count(*) AS BIGINT) AS test_rows, CAST((SELECT count(*) FROM folded) - count(*) AS BIGINT) AS train_rows,
 'labels.parquet' AS input_file, 'fold=' || fold || '/part=test' AS test_folder FROM folded GROUP BY fold""",
        "labeled",
    ),
)
def d8_fold_export(spark, folder):
    """Rows per fold as counted in the exported files, and the paths as the stored summary names them."""
    at = scratch_path(spark, "export")
    summary = export_folds(V.labeled(spark, folder), at, 2, 5, input_file="labels.parquet")
    stored = spark.read.schema("id long, label int, fold int, part string").json(f"{at}/folds")
    is_test = (F.col("part") == "test").cast("long")
    counted = stored.groupBy("fold").agg(F.sum(is_test).alias("test_rows"), F.sum(1 - is_test).alias("train_rows"))
    named = summary.select("input_file", F.explode("folds").alias("f")).select(
        "input_file", F.col("f.fold").alias("fold"), F.regexp_extract("f.test_path", "[^/]+/[^/]+$", 0).alias("test_folder")
    )
    return counted.join(named, "fold").select("fold", "test_rows", "train_rows", "input_file", "test_folder")
