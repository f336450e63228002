"""Views of the standard test tables in the shapes the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tasks import expand_targets


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def labeled(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled sentences: ``id, text, score`` with score 1..4."""
    labels = table(spark, folder, "labels")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    score = (1 + 2 * F.col("quality") + F.col("toxic")).cast("int")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), "text", score.alias("score"))


def predicted(spark: SparkSession, folder: str) -> DataFrame:
    """Gold and predicted levels with a unique text id."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")]
    return table(spark, folder, "lineitem").select(
        F.concat_ws("-", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]).alias("id"),
        (1 + F.col("l_linenumber") % 4).cast("int").alias("gold"),
        (1 + F.col("l_partkey") % 4).cast("int").alias("pred"),
        F.col("l_returnflag").alias("model"),
        F.col("l_linestatus").alias("prompt_type"),
    )


def stand_in_reply(text: str = "text"):
    """The hash model's reply as an expression."""
    digit = F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(F.col(text).cast("binary")), 1, 1))
    return F.concat(F.lit("【最終分數："), (1 + (digit - 1) % 4).cast("string"), F.lit("】"))


def replies(spark: SparkSession, folder: str) -> DataFrame:
    return labeled(spark, folder).withColumn("reply", stand_in_reply())


def raw_replies(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("reply"))


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    return expand_targets(labeled(spark, folder))


def activity(spark: SparkSession, folder: str) -> DataFrame:
    """Activity entries; ``event_id`` is kept to order equal timestamps."""
    return as_activity(table(spark, folder, "events"))


def as_activity(events: DataFrame) -> DataFrame:
    target = (1 + F.col("event_id") % 4).cast("int")
    score = (1 + F.floor("value") % 4).cast("int")
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("timestamp"),
        "user_id",
        target.cast("string").alias("target_level"),
        score.alias("predicted_score"),
        (target == score).alias("success"),
        F.col("event_type").alias("input_text"),
        F.col("props").alias("output_text"),
        F.lit("localhost").alias("ip_address"),
    )


def instructions(spark: SparkSession, folder: str) -> DataFrame:
    """Instruction, input and output from conversations: system turn, user turn, the reply to it."""
    turns = table(spark, folder, "conversations")
    system = turns.where("role = 'system'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("instruction"))
    users = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("input"))
    replies = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output")
    )
    return (
        users.join(replies, ["conv_id", "turn"])
        .join(system, "conv_id", "left")
        .select("conv_id", "turn", "instruction", "input", "output")
    )


def logits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("logits"), F.col("label").alias("gold")
    )
