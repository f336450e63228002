"""A rate shared by tasks, and a ledger that survives failed runs."""

import pathlib
import threading

import pytest
from labelflow.operators import inference as I
from labelflow.operators.ledger import generate_once, read_ledger, reply_key
from pyspark.sql import functions as F


class Clock:
    """Time that passes only by sleeping; each task has its own, all start at once."""

    def __init__(self, start=1000.0):
        self.now = start

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds


def test_four_tasks_stay_under_one_rate():
    calls = []
    for share in range(4):
        clock = Clock(1000.0 + 0.013 * share)
        pace = I.Pace(10.0, share, 4, clock, clock.sleep)
        for _ in range(25):
            pace.wait()
            calls.append(clock.now)
            clock.sleep(0.001 * share)  # calls of different lengths
    calls.sort()
    assert len(calls) == 100 and all(b - a > 0.0999 for a, b in zip(calls, calls[1:]))


def test_slots_of_batches_and_late_callers():
    clock = Clock(0.0)
    pace = I.Pace(2.0, 1, 3, clock, clock.sleep)
    pace.wait(2)  # slots 1 and 4
    assert clock.now == pytest.approx(2.0)
    clock.sleep(10)
    pace.wait()
    assert clock.now == pytest.approx(12.5) and pace.last % 3 == 1
    with pytest.raises(ValueError):
        I.Pace(1.0, 3, 3)


def test_threads_of_a_task_take_different_slots():
    pace, seen = I.Pace(500.0), []

    def call():
        for _ in range(20):
            pace.wait()
            seen.append(pace.last)

    threads = [threading.Thread(target=call) for _ in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert pace.last >= 99 and len(seen) == 100


def test_retries_count(monkeypatch):
    clock = Clock()
    pace = I.Pace(1.0, clock=clock, sleep=clock.sleep)

    class Failing:
        def generate(self, prompt, **settings):
            raise RuntimeError("429")

    I.ask(Failing(), "p", {}, I.NO_WAIT, clock.sleep, pace)
    assert clock.now >= 1000.0 + I.NO_WAIT.tries - 1


def test_rate_over_tasks(spark):
    import time

    df = spark.range(30).selectExpr("id", "cast(id AS string) AS prompt")
    start = time.time()
    out = I.generate(df, I.ModelSpec(I.HashModel), retry=I.NO_WAIT, parallelism=3, rate=20.0)
    assert out.where("status = 'ok'").count() == 30
    assert time.time() - start > 29 / 20
    with pytest.raises(ValueError, match="parallelism"):
        I.generate(df, I.ModelSpec(I.HashModel), rate=1.0)


class Counting:
    """Writes a line for each prompt it is asked, and ends the run at a poisoned one."""

    def __init__(self, path, poison):
        self.path, self.poison = pathlib.Path(path), poison

    def generate(self, prompt, **settings):
        if prompt == self.poison:
            raise SystemExit("the worker dies")
        with (self.path / f"{prompt}.txt").open("a") as f:
            f.write("asked\n")
        if prompt == "fails":
            raise RuntimeError("boom")
        return f"<{prompt}>"


@pytest.fixture(scope="module")
def shipped(spark):
    spark.sparkContext.addPyFile(__file__)  # the model's class, for the workers


def asked(path):
    return {p.stem: p.read_text().count("asked") for p in path.iterdir()}


def test_a_failed_run_goes_on_without_asking_twice(spark, shipped, tmp_path):
    calls, at = tmp_path / "calls", str(tmp_path / "ledger")
    calls.mkdir()
    df = spark.range(60).selectExpr("id", "CASE WHEN id = 59 THEN 'fails' WHEN id < 20 THEN 'same' ELSE concat('p', id) END AS prompt")
    run = lambda poison: generate_once(
        df, I.ModelSpec(Counting, (str(calls), poison)), "m", at, retry=I.JUDGE_RETRY, batches=6, spread_by=("id",)
    )
    part = F.pmod(F.xxhash64(reply_key("m", "prompt")), F.lit(6))
    poison = df.where((part == 3) & F.col("prompt").startswith("p")).first()["prompt"]
    with pytest.raises(Exception):  # noqa: B017 - whatever the worker's end is reported as
        run(poison).collect()
    stored = {r["reply"] for r in read_ledger(spark, at).collect()}
    assert 0 < len(stored) < 41 and set(asked(calls)) >= {s.strip("<>") for s in stored if s}
    before = asked(calls)
    rows = {r["id"]: r for r in run("none").collect()}
    assert len(rows) == 60 and rows[3]["reply"] == "<same>" and rows[33]["reply"] == "<p33>" and rows[59]["status"] == "failed"
    after = asked(calls)
    assert all(after[p] == before[p] for p in before if f"<{p}>" in stored)
    assert run("none").where("status = 'ok'").count() == 59
    assert {p: n for p, n in asked(calls).items() if n != after[p]} == {"fails": after["fails"] + 1}


def test_settings_and_nulls_are_part_of_the_key(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("", 1), ("a", 1)], "prompt string, n int")
    got = generate_once(df, I.ModelSpec(I.HashModel), "m", str(tmp_path / "l"), retry=I.NO_WAIT, settings=("n",), batches=2)
    assert got.count() == 4 and got.columns == ["prompt", "n", "reply", "attempts", "status", "error"]
    assert read_ledger(spark, str(tmp_path / "l")).count() == 3
    other = generate_once(df.where(F.lit(False)), I.ModelSpec(I.HashModel), "m", str(tmp_path / "l2"))
    assert other.count() == 0
