"""Training in steps: metrics per step against counts over stored predictions, and resuming."""

import math
import random

import numpy as np
import pytest
from labelflow.operators import stepwise as S
from labelflow.operators.folds import stratified_kfold
from labelflow.sources.folders import numbered


@pytest.fixture(scope="module")
def folded(spark):
    rng = random.Random(1)
    words = {0: "謝謝麻煩", 1: "會議時間", 2: "閉嘴煩死", 3: "真厲害呢"}
    text = lambda y: "".join(rng.choice(words[y] if rng.random() < 0.7 else "的了嗎在我你") for _ in range(rng.randint(0, 30)))
    rows = [(i, text(i % 4), i % 4) for i in range(160)] + [(200, None, 1), (201, "", 2)]
    return stratified_kfold(spark.createDataFrame(rows, "id long, text string, label int"), "label", "id", 4).cache()


def counted(rows):
    """Accuracy, macro F1 over present labels, and mean loss, by counting."""
    labels = {r["label"] for r in rows} | {r["pred"] for r in rows}
    f1 = []
    for y in labels:
        tp = sum(r["label"] == y == r["pred"] for r in rows)
        f1.append(2 * tp / (sum(r["label"] == y for r in rows) + sum(r["pred"] == y for r in rows)))
    return sum(r["label"] == r["pred"] for r in rows) / len(rows), sum(f1) / len(f1), sum(r["loss"] for r in rows) / len(rows)


def test_metrics_of_each_step_follow_from_stored_predictions(spark, folded, tmp_path):
    result = S.train_steps(folded, 1, str(tmp_path), steps=9, every=2, slots=512)
    stored = spark.read.parquet(f"{tmp_path}/predictions").collect()
    got = {r["step"]: tuple(r)[1:] for r in result.candidates.collect()}
    assert sorted(got) == [2, 4, 6, 8, 9] and len({r["id"] for r in stored}) == folded.where("fold = 1").count()
    for step, values in got.items():
        assert values == pytest.approx(counted([r for r in stored if r["step"] == step]))
    best = max(got, key=lambda s: (got[s][1], -s))
    assert result.metrics["step"] == best and result.metrics["fold"] == 1 and result.metrics["eval_accuracy"] > 0.8
    assert np.array_equal(result.weights, S.load_step(spark, f"{tmp_path}/weights", best)[0])


def test_a_stopped_run_goes_on(spark, folded, tmp_path):
    whole = S.train_steps(folded, 0, str(tmp_path / "a"), steps=6, every=3, slots=256)
    S.train_steps(folded, 0, str(tmp_path / "b"), steps=3, every=3, slots=256)
    files = {p: p.stat().st_mtime for p in (tmp_path / "b" / "weights" / "step=3").iterdir()}
    parts = S.train_steps(folded, 0, str(tmp_path / "b"), steps=6, every=3, slots=256)
    assert files == {p: p.stat().st_mtime for p in (tmp_path / "b" / "weights" / "step=3").iterdir()}
    assert numbered(spark, f"{tmp_path}/b/weights", "step") == [3, 6]
    assert np.allclose(S.load_step(spark, f"{tmp_path}/b/weights", 6)[0], S.load_step(spark, f"{tmp_path}/a/weights", 6)[0])
    assert parts.metrics == pytest.approx(whole.metrics)


def test_gradient_equals_its_plain_sum(spark, folded):
    features = S.with_features(folded, 64, (1, 2))
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(4, 65))
    got, n = S.gradient(features, weights)
    expected = np.zeros_like(weights)
    for r in features.collect():
        x = np.zeros(65)
        x[r["at"]] = r["x"]
        p = np.exp(weights @ x - (weights @ x).max())
        p /= p.sum()
        p[r["label"]] -= 1
        expected += np.outer(p, x)
    assert n == folded.count() and np.allclose(got, expected)


def test_hashed_grams():
    at, x = S.hashed_grams("abab", 1000, (1, 2))
    assert at[-1] == 1000 and x[-1] == 1.0 and math.isclose((x[:-1] ** 2).sum(), 1.0) and len(at) == 5
    assert S.hashed_grams(None)[0].tolist() == [S.SLOTS] == S.hashed_grams("")[0].tolist()
