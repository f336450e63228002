import time

import pytest
from labelflow.operators import inference as I
from labelflow.operators.portions import ROWS as PORTION_ROWS
from labelflow.operators.prompts import fixed_prompt
from labelflow.plans.experiment import experiment, store_and_compare
from labelflow.plans.scoring import scoring_run, write_scoring_report
from pyspark.sql import functions as F


class Script:
    """Answers from a list; exceptions in it are raised."""

    def __init__(self, *answers):
        self.answers = list(answers)

    def generate(self, prompt, **settings):
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


def waits(model, policy):
    slept = []
    return I.ask(model, "p", {}, policy, slept.append), slept


def test_waits_double_on_transient_errors():
    limit = RuntimeError("Error 429")
    result, slept = waits(Script(*[limit] * 5), I.SCORER_RETRY)
    assert result == (None, 5, "exhausted", "Error 429")
    assert slept == [2, 4, 8, 16, 32]


def test_blank_replies_are_asked_again():
    result, slept = waits(Script("", " \n", "3"), I.SCORER_RETRY)
    assert result == ("3", 3, "ok", None)
    assert slept == [2, 4, 1]


def test_other_errors_wait_once_or_stop():
    _, slept = waits(Script(RuntimeError("boom"), "3"), I.SCORER_RETRY)
    assert slept == [2, 1]
    result, slept = waits(Script(RuntimeError("boom"), "3"), I.JUDGE_RETRY)
    assert result == (None, 1, "failed", "boom")
    assert slept == []


class Slow:
    def generate(self, prompt, **settings):
        time.sleep(0.05)
        if prompt == "7":
            raise RuntimeError("boom")
        return f"<{prompt}>"


def test_calls_of_a_task_overlap_and_keep_their_order():
    rows = [(str(i), {}) for i in range(200)]
    start = time.perf_counter()
    got = I.ask_all(Slow(), rows, I.RetryPolicy(tries=1, pause=0, retry_other=False))
    assert time.perf_counter() - start < 200 * 0.05 / 8
    assert [g[0] for g in got] == [f"<{i}>" if i != 7 else None for i in range(200)]
    assert got[7][1:] == (1, "failed", "boom")


class Batched:
    """Null for odd prompts on the first call, an error for "4" always."""

    def __init__(self):
        self.calls = []

    def generate_many(self, prompts, settings):
        self.calls.append(list(prompts))
        odd = len(self.calls) == 1
        return [RuntimeError("429") if p == "4" else None if odd and int(p) % 2 else f"<{p}{s}>" for p, s in zip(prompts, settings)]


def test_batches_ask_only_for_what_is_left():
    model, slept = Batched(), []
    got = I.ask_all(model, [(str(i), {"t": i}) for i in range(5)], I.RetryPolicy(tries=3, base_delay=1, pause=0), sleep=slept.append)
    assert model.calls == [["0", "1", "2", "3", "4"], ["1", "3", "4"], ["4"]]
    assert [g[:3] for g in got[:2]] == [("<0{'t': 0}>", 1, "ok"), ("<1{'t': 1}>", 2, "ok")]
    assert got[4] == (None, 3, "exhausted", "429")
    assert slept == [1, 2, 0]


def test_routed_and_templated_models_take_batches():
    spec = I.templated(I.routed({"a": I.ModelSpec(I.EchoModel), "s": I.ModelSpec(Slow)}), "<", ">")
    got = I.ask_all(spec.build(), [("x", {"model": "a"}), ("y", {"model": "s"}), ("z", {"model": "a"})], I.NO_WAIT)
    assert [g[0].split("：")[-1].split("\n")[0] if "：" in g[0] else g[0] for g in got] == ["<x>", "<<y>>", "<z>"]


def test_judge_takes_null_and_blank_as_answers():
    assert waits(Script(None), I.JUDGE_RETRY)[0][:3] == (None, 1, "null")
    assert waits(Script(""), I.JUDGE_RETRY)[0][:3] == ("", 1, "ok")


def test_model_names():
    registry = I.ModelRegistry(fallback=lambda n: ("local", n))
    registry.alias("small", "vendor/small-7b")
    registry.prefix("web", lambda n: ("web", n))
    registry.contains("small", lambda n: ("small", n), unless="cloud")
    registry.contains("cloud", lambda n: ("cloud", n))
    built = {n: registry.resolve(n).build() for n in ("web-1", "Small", "cloud-small", "other")}
    assert built == {
        "web-1": ("web", "web-1"),
        "Small": ("small", "vendor/small-7b"),
        "cloud-small": ("cloud", "cloud-small"),
        "other": ("local", "other"),
    }
    with pytest.raises(ValueError, match="no backend"):
        I.ModelRegistry().resolve("x")


def test_failed_rows_score_minus_three(spark):
    df = spark.createDataFrame([("a",), ("b",)], "text string")
    out = I.score_table(df, I.ModelSpec(I.NullModel), fixed_prompt, retry=I.RetryPolicy(tries=2, base_delay=0, pause=0))
    assert {(r["predicted_score"], r["status"], r["attempts"]) for r in out.collect()} == {(-3, "exhausted", 2)}


def test_templated_model_equals_rendered_prompts(spark):
    df = spark.createDataFrame([("a",), ("b",), ("臺",)], "text string")
    rendered = df.withColumn("prompt", F.concat(F.lit("<"), "text", F.lit(">")))
    spec = I.ModelSpec(I.HashModel)
    a = {r["text"]: r["reply"] for r in I.generate(rendered, spec, retry=I.NO_WAIT).collect()}
    b = {r["text"]: r["reply"] for r in I.generate(df, I.templated(spec, "<", ">"), "text", I.NO_WAIT).collect()}
    assert a == b


def test_ties_take_the_first_class(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.9],), ([3.0, 1.0],)], "logits array<double>")
    assert [r["pred"] for r in I.predict_class(df).collect()] == [1, 0]


def test_scoring_run_of_a_result_table(spark, tmp_path):
    data = spark.createDataFrame([(i, f"t{i}", 1 + i % 4) for i in range(40)], "id long, text string, score int")
    results = spark.createDataFrame([("x", 2), ("y", 3)], "generated_text string, target_level int")
    run = scoring_run(data, I.ModelSpec(I.HashModel), str(tmp_path), 8, results, retry=I.NO_WAIT)
    assert run.scored.count() == 2
    assert run.counts.first()["valid"] == 2
    assert run.accuracy.first()["rows"] == 2
    assert run.report.count() == 7
    assert "/dataset_scored_" in run.csv_path
    assert spark.read.option("header", True).csv(run.csv_path).count() == 2
    assert "model: HashModel" in [r["value"] for r in spark.read.text(run.report_path).collect()]
    path = write_scoring_report(run, {"model": "hash"}, "prefix", str(tmp_path / "report"))
    assert "model: hash" in [r["value"] for r in spark.read.text(path).collect()]
    with pytest.raises(ValueError, match="no valid"):
        scoring_run(data, I.ModelSpec(I.NullModel), str(tmp_path), 8, retry=I.RetryPolicy(tries=1, base_delay=0))


def test_experiment_rows_and_storage(spark, tmp_path):
    tasks = spark.createDataFrame([(i, f"句{i % 5}", 1 + i % 4) for i in range(12)], "task_id long, text string, target int")
    examples = spark.createDataFrame([(i, f"例{i}", 1 + i % 4) for i in range(8)], "id long, text string, score int")
    models = {"m1": I.ModelSpec(I.EchoModel), "m2": I.ModelSpec(I.NullModel)}
    out = experiment(tasks, examples, models, I.ModelSpec(I.HashModel), n=10, seed=1)
    rows = out.collect()
    assert len(rows) == 10 * 2 * 2
    assert {r["id"] for r in rows} == {f"S{i:03d}" for i in range(1, 11)}
    assert all(r["generated_text"] == r["original_text"] for r in rows if r["model"] == "m1")
    assert all(r["generated_text"] == "" for r in rows if r["model"] == "m2")
    path, by = store_and_compare(out, str(tmp_path))
    assert path.endswith("run_id=1")
    assert by.where("model_mode IS NOT NULL").count() == 4
    assert store_and_compare(out, str(tmp_path))[0].endswith("run_id=2")


def together():
    class Together:
        """Replies with the number of prompts, and of characters, that it was given at once."""

        def generate_many(self, prompts, settings):
            return [f"{len(prompts)} {sum(map(len, prompts))}"] * len(prompts)

    return I.ModelSpec(Together)


def test_long_prompts_are_asked_in_portions(spark):
    """A batch of 10,000 rows, or of a few very long ones, is not held as Python objects at once."""
    for rows, length, most in ((3000, 4, PORTION_ROWS), (40, 200_000, 5)):
        df = spark.range(rows).coalesce(1).select("id", F.repeat(F.lit("x"), length).alias("prompt"))
        replies = I.generate(df, together(), retry=I.NO_WAIT).select("id", "reply").collect()
        assert sorted(r["id"] for r in replies) == list(range(rows))
        assert max(int(r["reply"].split()[0]) for r in replies) <= most


def test_whole_prompts_are_made_for_few_rows_at_a_time():
    got = I.templated(together(), "p" * 300_000, "").build().generate_many(["x"] * 50, [{}] * 50)
    assert len(got) == 50
    assert max(int(r.split()[1]) for r in got) <= I.WHOLE_CHARS
