"""A ledger of model replies: what has been answered is never asked again, also after a run that failed half-way.

A reply is known by the digest of model name, prompt and settings. Prompts that the ledger lacks are asked once each, in batches; each batch
is appended as soon as it is done, so an error later in the run, or the end of the driver, loses one batch at most. The rows
of the table then meet the ledger by digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import REPLY
from ..session import cut_lineage
from ..sources.folders import numbered
from .inference import SCORER_RETRY, ModelSpec, RetryPolicy, generate
from .joins import spread_lookup

LAYOUT = f"_key string, {REPLY}, number long"
SETTLED = ("ok", "null")


def reply_key(model_name: str, prompt: str, settings: tuple[str, ...] = ()) -> Column:
    """Digest of what an answer depends on. Nulls differ from empty texts, and names from values."""
    asked = F.to_json(F.struct(F.lit(model_name).alias("model"), F.col(prompt).alias("prompt"), *settings), {"ignoreNullFields": "false"})
    return F.sha2(asked.cast("binary"), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """``_key, reply, attempts, status, error``: the last settled reply of each key, or else its last failure."""
    folders = [f"{path}/batch={n}" for n in numbered(spark, path, "batch")]
    rows = spark.read.schema(LAYOUT).parquet(*folders) if folders else spark.createDataFrame([], LAYOUT)
    newest = F.max_by(F.struct("reply", "attempts", "status", "error"), F.struct(F.col("status").isin(*SETTLED), "number"))
    return rows.groupBy("_key").agg(newest.alias("r")).select("_key", "r.*")


def generate_once(
    df: DataFrame,
    model: ModelSpec,
    model_name: str,
    path: str,
    prompt: str = "prompt",
    retry: RetryPolicy = SCORER_RETRY,
    settings: tuple[str, ...] = (),
    batches: int = 8,
    parallelism: int | None = None,
    rate: float | None = None,
    spread_by: tuple[str, ...] = (),
) -> DataFrame:
    """:func:`generate` through the ledger at ``path``: adds ``reply, attempts, status, error``.

    Equal prompts with equal settings are asked once. ``batches`` is how often replies are made durable on the way; a batch is a part of
    the digests, so parts are of one size whatever the texts. Failed calls are recorded too, and asked again by the next run. One
    run at a time may write a ledger: batches are numbered folders that are never written twice. ``spread_by`` names columns that tell rows with one frequent prompt apart (the prompt's own
    key otherwise, which leaves such rows together).
    """
    spark = df.sparkSession
    keyed = df.withColumn("_key", reply_key(model_name, prompt, settings))
    known = read_ledger(spark, path).where(F.col("status").isin(*SETTLED)).select("_key")
    asked = keyed.select("_key", prompt, *settings).dropDuplicates(["_key"]).join(known, "_key", "left_anti")
    asked = cut_lineage(asked.withColumn("_part", F.pmod(F.xxhash64("_key"), F.lit(batches))), "asked")
    number = max(numbered(spark, path, "batch"), default=-1)
    for part in range(batches):
        some = asked.where(F.col("_part") == part)
        if some.isEmpty():
            continue
        number += 1
        answered = generate(some, model, prompt, retry, settings, parallelism, rate=rate)
        answered.select("_key", "reply", "attempts", "status", "error", F.lit(number).cast("long").alias("number")).write.parquet(
            f"{path}/batch={number}"
        )
    ledger = read_ledger(spark, path)
    return spread_lookup(keyed, ledger, "_key", list(spread_by) or ["_key"]).drop("_key")
