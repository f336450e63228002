"""Convert-and-judge requests, and same-level paraphrases, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.replies import first_line
from ..functions.text import parse_level
from ..operators.inference import GENERATE_ONCE, JUDGE_RETRY, ModelSpec, RetryPolicy, generate
from ..operators.labels import mark_correct
from ..operators.prompts import attach_examples, paraphrase_prompt, rewrite_prompt_basic
from ..session import cut_lineage
from ..sources.activity import usable_requests
from .experiment import judge, rewritten


def convert_and_score(
    requests: DataFrame,
    generator: ModelSpec,
    judge_model: ModelSpec,
    judge_prefix: DataFrame,
    gen_retry: RetryPolicy = GENERATE_ONCE,
    judge_retry: RetryPolicy = JUDGE_RETRY,
    parallelism: int | None = None,
) -> DataFrame:
    """Activity entries for requests (``timestamp, input_text, target_level`` such as ``4-...``).

    Blank requests are left out. The result is ready for :func:`append_activity`.
    """
    usable = usable_requests(requests).withColumn("_level", parse_level("target_level"))
    usable = usable.repartition(parallelism) if parallelism else usable
    prompts = rewrite_prompt_basic(usable, "input_text", "_level", None)
    converted = cut_lineage(
        rewritten(prompts, generator, gen_retry, clean=False)
        .drop("prompt", "reply", "attempts", "status", "error")
        .withColumnRenamed("generated_text", "output_text")
    )
    judged = judge(converted, judge_model, judge_prefix, "output_text", judge_retry, parallelism)
    scored = judged.withColumn("predicted_score", F.col("predicted_score").cast("int"))
    return mark_correct(scored, "predicted_score", "_level", "success").select(
        *[c for c in requests.columns if c not in ("output_text", "predicted_score", "success")],
        "output_text",
        "predicted_score",
        "success",
    )


def paraphrase(
    df: DataFrame, by_level: DataFrame, model: ModelSpec, level: str = "level", retry: RetryPolicy = GENERATE_ONCE
) -> DataFrame:
    """Same-level rewrite of each text: the first line of the reply, or ``Error``."""
    prompts = paraphrase_prompt(attach_examples(df, by_level, level), level=level).drop("examples")
    answered = generate(prompts, model, retry=retry)
    return answered.withColumn("paraphrase", first_line("reply")).select(*df.columns, "paraphrase")
