"""A generation experiment: sample tasks, score originals once, rewrite per model and prompt, judge, compare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.replies import clean_rewrite, parse_integer
from ..operators.inference import (
    GENERATE_ONCE,
    JUDGE_RETRY,
    ModelSpec,
    RetryPolicy,
    generate,
    routed,
    score_table,
    templated,
)
from ..operators.labels import mark_correct, with_mode
from ..operators.metrics import accuracy_by
from ..operators.prompts import (
    JUDGE_SUFFIX,
    attach_examples,
    examples_by_level,
    judge_prefix,
    rewrite_prompt_basic,
    rewrite_prompt_data,
)
from ..operators.sampling import proportional_sample, sample_n
from ..operators.tasks import assign_ids, experiment_grid, score_distinct
from ..session import cut_lineage
from ..sources.files import run_output

PROMPT_TYPES = {"Basic": False, "Data": True}
COLUMNS = (
    "id", "original_text", "original_score", "model", "prompt_type",
    "use_data", "target_level", "generated_text", "predicted_score", "is_correct",
)


def rewritten(
    df: DataFrame, model: ModelSpec, retry: RetryPolicy, clean: bool = True, settings: tuple[str, ...] = ()
) -> DataFrame:
    """Generate and clean; a failed call gives the text ``Error``."""
    answered = generate(df, model, retry=retry, settings=settings)
    out = clean_rewrite(answered) if clean else answered.withColumn("generated_text", F.col("reply"))
    failed = F.col("status").isin("failed", "exhausted")
    return out.withColumn("generated_text", F.when(failed, "Error").otherwise(F.col("generated_text")))


def judge(
    df: DataFrame,
    model: ModelSpec,
    prefix: DataFrame,
    text: str,
    retry: RetryPolicy = JUDGE_RETRY,
    parallelism: int | None = None,
) -> DataFrame:
    """Score ``text`` with the judge prompt and its integer parser. The one-row prefix goes to the workers once."""
    shared = templated(model, prefix.first()[0] + JUDGE_SUFFIX[0], JUDGE_SUFFIX[1])
    return score_table(df, shared, text, parse_integer, retry, parallelism)


def experiment(
    tasks: DataFrame,
    examples: DataFrame,
    models: dict[str, ModelSpec],
    judge_model: ModelSpec,
    n: int | None = None,
    seed: int = 0,
    prompt_types: dict[str, bool] = PROMPT_TYPES,
    gen_retry: RetryPolicy = GENERATE_ONCE,
    judge_retry: RetryPolicy = JUDGE_RETRY,
    parallelism: int | None = None,
    judge_n: int = 50,
) -> DataFrame:
    """Result rows for each task, model and prompt type.

    ``tasks`` has ``task_id, text, target``; ``examples`` has ``id, text, score``; the judge sees the first five of
    each level of a proportional sample of ``judge_n``, the writer the first thirty of the target level. Generated texts and original
    scores are written, because every model call is costly and may answer differently when repeated.
    """
    picked = tasks if n is None else sample_n(tasks, "task_id", n, seed)
    prefix = judge_prefix(proportional_sample(examples, "score", "id", judge_n), ["id"], 5)
    by_level = examples_by_level(examples, ["id"], 30)

    def score_originals(texts: DataFrame) -> DataFrame:
        scored = judge(texts, judge_model, prefix, "text", judge_retry, parallelism)
        return cut_lineage(scored.select("_key", "predicted_score"))

    with_scores = score_distinct(assign_ids(picked, ["task_id"]), "text", score_originals, ["task_id"])
    with_scores = with_scores.withColumn("original_score", F.col("original_score").cast("int"))
    spread = with_scores.repartition(parallelism) if parallelism else with_scores
    grid = experiment_grid(spread, list(models), prompt_types)
    both = rewrite_prompt_data(attach_examples(rewrite_prompt_basic(grid, out="_basic"), by_level), out="_data")
    prompts = both.withColumn("prompt", F.when(F.col("use_data"), F.col("_data")).otherwise(F.col("_basic")))
    prompts = prompts.drop("_basic", "_data", "examples")
    generated = cut_lineage(
        rewritten(prompts, routed(models), gen_retry, settings=("model",)).drop(
            "prompt", "reply", "attempts", "status", "error"
        )
    )
    judged = judge(generated, judge_model, prefix, "generated_text", judge_retry)
    named = judged.withColumnsRenamed({"text": "original_text", "target": "target_level"})
    named = named.withColumn("predicted_score", F.col("predicted_score").cast("int"))
    return mark_correct(named, "predicted_score", "target_level").select(*COLUMNS)


def store_and_compare(results: DataFrame, base: str, run_id: str | None = None) -> tuple[str, DataFrame]:
    """Write the run and return its accuracy by model and mode, and by target level."""
    path = run_output(results, base, run_id)
    stored = with_mode(results.sparkSession.read.parquet(path))
    return path, accuracy_by(stored, "is_correct", [["model_mode"], ["target_level"], []])
