"""The daily roll-up of a stream as keyed state: days close, their state goes, and late entries are kept apart.

Entries are first summed up per task, so that a busy day and target sends one row from each task and not all its entries. State
is one row for each open (day, target), in Spark's state store; a timer at the end of the day, in event time, closes it. Entries of a
closed day are told apart instead of dropped unseen. Every batch writes the rows it changed to a folder of its own, so a
batch that is run again replaces its own rows, and the newest row of each (day, target) is the roll-up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..sources.folders import drop_folders, file_system, numbered

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTS = "events long, known long, right long"
CHANGES = f"day date, target_level string, {COUNTS}, status string"
KEEP = 2  # batch folders beside the merged one, for readers that have just listed them


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("day", pa.date32()), ("target_level", pa.string()), ("ends", pa.int64()), *[(n, pa.int64()) for n in ("events", "known", "right")]]
    )
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by(["day", "target_level", "ends"])
        summed = table.aggregate([([], "count_all"), ("success", "count"), ("success", "sum")])
        columns = [summed[c] for c in ("day", "target_level", "ends", "count_all", "success_count", "success_sum")]
        columns = [c.cast(t) for c, t in zip(columns, schema.types, strict=True)]
        columns[-1] = columns[-1].fill_null(0)
        yield from pa.Table.from_arrays(columns, schema=schema).combine_chunks().to_batches()


class OpenDays(StatefulProcessor):
    """Totals of each open (day, target). Entries without a timestamp have no day that could close."""

    def init(self, handle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", COUNTS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        day, target = key
        events = known = right = 0
        ends = None
        for r in rows:
            events, known, right, ends = events + r.events, known + r.known, right + r.right, r.ends
        if ends is not None and ends <= timerValues.getCurrentWatermarkInMs():
            yield self._row(day, target, events, known, right, "late")
            return
        if self.totals.exists():
            before = self.totals.get()
            events, known, right = events + before[0], known + before[1], right + before[2]
        elif ends is not None:
            self.handle.registerTimer(ends)
        self.totals.update((events, known, right))
        yield self._row(day, target, events, known, right, "open")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        counts = self.totals.get()
        self.totals.clear()
        yield self._row(*key, *counts, "closed")

    def close(self) -> None:
        pass

    @staticmethod
    def _row(day, target, events, known, right, status) -> Row:
        return Row(day=day, target_level=target, events=events, known=known, right=right, status=status)


def daily_changes(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """New totals of open days, last totals of days that close, and sums of late entries, batch by batch.

    A day closes when the newest entry of earlier batches is more than ``late`` behind its end.
    """
    marked = stream.withWatermark("timestamp", late)
    entries = marked.select(
        F.to_date("timestamp").alias("day"),
        F.col("target_level").cast("string").alias("target_level"),
        F.unix_millis(F.date_add(F.to_date("timestamp"), 1).cast("timestamp")).alias("ends"),
        F.col("success").cast("int").alias("success"),
    )
    partial = entries.mapInArrow(_partial_counts, f"day date, target_level string, ends long, {COUNTS}")
    return partial.groupBy("day", "target_level").transformWithState(OpenDays(), CHANGES, "Update", "EventTime")


def run_rollup(stream: DataFrame, path: str, checkpoint: str, late: str = "1 hour") -> list[int]:
    """Roll up what is there and stop; returns the rows of state after each batch. A restart goes on after the last whole batch."""
    spark = stream.sparkSession

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS_DB)  # read when the query starts
    try:
        query = (
            daily_changes(stream, late)
            .writeStream.outputMode("update")
            .foreachBatch(store)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(STATE_STORE, before)
    query.awaitTermination()
    return [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]


def _changes(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest merged folder and of all batches after it, with the number of their batch."""
    merged = max(numbered(spark, path, "merged"), default=None)
    after = [n for n in numbered(spark, path, "batch") if merged is None or n > merged]
    folders = [f"{path}/batch={n}" for n in after] + ([f"{path}/merged={merged}"] if merged is not None else [])
    layout = f"{CHANGES}, number long"
    if not folders:
        return spark.createDataFrame([], layout)
    rows = spark.read.schema(f"{layout}").option("recursiveFileLookup", True).parquet(*folders)
    own = F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/", 1)
    return rows.withColumn("number", F.coalesce("number", own.try_cast("long")))


def _newest(changes: DataFrame) -> DataFrame:
    """The last row of each (day, target), and the sums of late entries, in the layout of the changes."""
    counts = ("events", "known", "right")
    last = F.max_by(F.struct(*counts, "status"), F.struct("number", F.col("status") == "closed")).alias("m")
    kept = changes.where("status <> 'late'").groupBy("day", "target_level").agg(last, F.max("number").alias("number"))
    kept = kept.select("day", "target_level", "m.*", "number")
    late = changes.where("status = 'late'").groupBy("day", "target_level").agg(
        *[F.sum(c).alias(c) for c in counts], F.lit("late").alias("status"), F.max("number").alias("number")
    )
    return kept.unionByName(late)


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """``day, target_level, events, success_rate, status``: ``open`` and ``closed`` days, and what came ``late`` for closed ones."""
    rate = F.try_divide(F.col("right"), F.col("known")).alias("success_rate")
    return _newest(_changes(spark, path)).select("day", "target_level", "events", rate, "status")


def merge_batches(spark: SparkSession, path: str) -> None:
    """Write the newest rows as one folder and drop the batches it covers, but for the last ``KEEP``, whose readers may still run.

    The merged folder appears under its name only when it is whole, and readers take batches after its number only, so
    nothing is counted twice or missed at any time. Run it between runs of the stream.
    """
    batches, old = numbered(spark, path, "batch"), numbered(spark, path, "merged")
    if not batches or max(batches) in old:
        return
    _newest(_changes(spark, path)).coalesce(1).write.mode("overwrite").parquet(f"{path}/_making")
    files, made = file_system(spark, f"{path}/_making")
    files.rename(made, file_system(spark, f"{path}/merged={max(batches)}")[1])
    drop_folders(spark, [f"{path}/batch={n}" for n in sorted(batches)[:-KEEP]] + [f"{path}/merged={n}" for n in sorted(old)[:-1]])
