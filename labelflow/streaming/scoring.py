"""Scoring a stream: rows are durable as they finish, and accuracy is kept live."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..operators.metrics import running_accuracy
from ..sources.folders import drop_folders, numbered


def score_stream(
    source: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Score what is there and stop. A restart with the same checkpoint goes on after the last whole batch.

    ``score`` is a stateless step, so the file sink writes every row exactly once.
    """
    return (
        score(source)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def live_accuracy(stream: DataFrame, gold: str = "gold", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows, right rows and accuracy so far; failures count as wrong."""
    hit = F.coalesce((F.col(gold) == F.col(pred)).cast("double"), F.lit(0.0))
    return stream.groupBy(*by).agg(
        F.count("*").alias("rows"), F.sum(hit).cast("long").alias("correct"), F.avg(hit).alias("accuracy")
    )


def latest_result(aggregate: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an aggregating stream over what is there, keep its last result as a table at ``path``, and return that.

    Each batch writes its whole result to a folder of its own (a batch that is run again writes the same one anew), so nothing
    is held on the driver; the folders of all but the last two batches go. A stream without any new data returns what the newest
    folder has. The whole result is kept in state: see ``rollup`` for one whose closed days leave it.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    _run(aggregate.writeStream.outputMode("complete").foreachBatch(store), checkpoint)
    spark = aggregate.sparkSession
    batches = numbered(spark, path, "batch")
    drop_folders(spark, [f"{path}/batch={n}" for n in batches[:-2]])
    if not batches:
        return spark.createDataFrame([], aggregate.schema)
    return spark.read.schema(aggregate.schema).parquet(f"{path}/batch={batches[-1]}")


def _run(writer: DataStreamWriter, checkpoint: str) -> None:
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def running_accuracy_stream(stream: DataFrame, gold: str, pred: str, order: list[str], path: str, checkpoint: str) -> DataFrame:
    """Running rows, right rows and accuracy for every row of a stream, as a table at ``path``.

    Rows count in the order of batches, and by ``order`` inside a batch. A batch starts from the totals that the one before it has
    stored; it is laid out in ranges like a table, so its size is not that of a task. A batch that is run again starts from the same
    totals and writes the same folder anew.
    """
    spark = stream.sparkSession
    totals = "rows long, correct long"

    def store(batch: DataFrame, number: int) -> None:
        earlier = [n for n in numbered(spark, f"{path}/totals", "batch") if n < number]
        last = spark.read.schema(totals).parquet(f"{path}/totals/batch={earlier[-1]}").first() if earlier else (0, 0)
        done = running_accuracy(batch, gold, pred, order, *last)
        done.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        stored = spark.read.schema(done.schema).parquet(f"{path}/rows/batch={number}")
        after = stored.agg(F.max("rows_so_far").alias("rows"), F.max("correct_so_far").alias("correct"))
        after.select(F.coalesce("rows", F.lit(last[0])).alias("rows"), F.coalesce("correct", F.lit(last[1])).alias("correct")).coalesce(
            1
        ).write.mode("overwrite").parquet(f"{path}/totals/batch={number}")
        drop_folders(spark, [f"{path}/totals/batch={n}" for n in earlier[:-1]])

    _run(stream.writeStream.foreachBatch(store), checkpoint)
    folders = [f"{path}/rows/batch={n}" for n in numbered(spark, f"{path}/rows", "batch")]
    layout = T.StructType(list(stream.schema.fields))
    for name, new in (("rows_so_far", T.LongType()), ("correct_so_far", T.LongType()), ("running_accuracy", T.DoubleType())):
        layout = layout.add(name, new)
    return spark.read.schema(layout).parquet(*folders) if folders else spark.createDataFrame([], layout)
