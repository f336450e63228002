import hashlib
import math
from collections import Counter, defaultdict

import pytest
from labelflow.operators import folds as D
from labelflow.operators import ranking as R
from labelflow.operators import sampling as S
from pyspark.sql import functions as F


def order(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


def table(spark, sizes):
    rows, i = [], 0
    for label, n in sizes.items():
        for _ in range(n):
            rows.append((i, label))
            i += 1
    return spark.createDataFrame(rows, "id long, label int"), rows


SKEWED = {1: 3000, 2: 40, 3: 900, 4: 7}


def by_class(rows):
    out = defaultdict(list)
    for i, label in rows:
        out[label].append(i)
    return out


def test_stable_rank_equals_one_sort(spark):
    df, rows = table(spark, SKEWED)
    got = {r["id"]: r["rank"] for r in R.stable_rank(df, ["label"], "id", 5).collect()}
    for ids in by_class(rows).values():
        assert [got[i] for i in order(ids, 5)] == list(range(1, len(ids) + 1))


def remainder_quota(counts, draw):
    total = sum(counts.values())
    floor = {k: draw * n // total for k, n in counts.items()}
    ranked = sorted(counts, key=lambda k: (-(draw * counts[k] % total), k))
    for k in ranked[: draw - sum(floor.values())]:
        floor[k] += 1
    return floor


def test_holdout_matches_brute_force(spark):
    df, rows = table(spark, SKEWED)
    got = {r["id"]: r["part"] for r in S.stratified_split(df, "label", "id", 0.2, 42).collect()}
    groups = by_class(rows)
    total = len(rows)
    quota = remainder_quota({k: len(v) for k, v in groups.items()}, total - math.ceil(total * 0.2))
    expected = {i: "train" if p < quota[k] else "test" for k, v in groups.items() for p, i in enumerate(order(v, 42))}
    assert got == expected


def test_holdout_sizes_round_up(spark):
    df, _ = table(spark, {1: 140, 2: 90, 3: 90, 4: 132})
    counts = Counter(r["part"] for r in S.stratified_split(df, "label", "id").collect())
    assert counts == {"test": 91, "train": 361}


def test_holdout_falls_back_to_plain_random(spark):
    df, rows = table(spark, {1: 20, 2: 1})
    got = {r["id"]: r["part"] for r in S.stratified_split(df, "label", "id").collect()}
    ids = order([i for i, _ in rows], 42)
    assert got == {i: "train" if p < 16 else "test" for p, i in enumerate(ids)}


@pytest.mark.parametrize(("sizes", "n"), [(SKEWED, 50), ({1: 10, 2: 10, 3: 10, 4: 10}, 6), ({1: 30, 2: 1}, 5), ({1: 3}, 9)])
def test_proportional_sample(spark, sizes, n):
    df, rows = table(spark, sizes)
    got = {r["id"] for r in S.proportional_sample(df, "label", "id", n).collect()}
    groups, total = by_class(rows), len(rows)
    if n >= total:
        expected = {i for i, _ in rows}
    elif min(map(len, groups.values())) < 2:
        expected = set(order([i for i, _ in rows], 42)[:n])
    else:
        picked = [i for v in groups.values() for i in order(v, 42)[: max(1, round(n * len(v) / total))]]
        expected = set(picked if len(picked) <= n else order(picked, "42:recut")[:n])
    assert got == expected
    assert len(got) <= max(n, 0)


def test_sample_n_bounds(spark):
    df, rows = table(spark, {1: 100})
    assert {r["id"] for r in S.sample_n(df, "id", 7, 3).collect()} == set(order(range(100), 3)[:7])
    assert S.sample_n(df, "id", 1000, 3).count() == 100
    assert S.sample_n(df, "id", 0, 3).count() == 0


def test_first_n_ignores_other_levels(spark):
    df, _ = table(spark, {0: 5, 1: 40, 7: 5})
    got = S.first_n_per_class(df, "label", 30, ["id"]).collect()
    assert sorted(r["id"] for r in got) == list(range(5, 35))


def test_few_shot_sets_are_nested(spark):
    df, _ = table(spark, SKEWED)
    sets = defaultdict(set)
    for r in S.few_shot_sets(df, "label", "id").collect():
        sets[r["shots"]].add(r["id"])
    assert {k: len(v) for k, v in sets.items()} == {4: 4, 8: 8, 12: 12}
    assert sets[4] < sets[8] < sets[12]


@pytest.mark.parametrize("k", [2, 3, 5])
def test_fold_sizes_match_the_public_algorithm(spark, k):
    df, rows = table(spark, {3: 41, 1: 13, 2: 29, 4: 6})
    got = Counter((r["label"], r["fold"]) for r in D.stratified_kfold(df, "label", "id", k, 9).collect())
    first = list(dict.fromkeys(label for _, label in rows))
    line = sorted((label for _, label in rows), key=first.index)
    assert got == Counter((label, p % k) for p, label in enumerate(line))


def test_folds_partition_the_rows(spark):
    df, rows = table(spark, SKEWED)
    folded = D.stratified_kfold(df, "label", "id", 5)
    assert sorted(r["id"] for r in folded.collect()) == [i for i, _ in rows]
    test = {r["id"] for r in D.held_out(folded, 2).collect()}
    train = {r["id"] for r in D.train_part(folded, 2).collect()}
    assert not test & train
    assert len(test | train) == len(rows)


def test_fold_guards(spark):
    df, _ = table(spark, {0: 9, 1: 2, 2: 9})
    with pytest.raises(ValueError, match=r"\[9, 2, 9, 0\]"):
        D.check_foldable(df, "label", 2)
    with pytest.raises(ValueError, match=">= 2"):
        D.check_foldable(df, "label", 1)
    assert D.check_foldable(df, "label", 2, (0, 1, 2)) == [9, 2, 9]


def test_fold_summary_against_python(spark):
    from statistics import pstdev

    df, _ = table(spark, {0: 11, 1: 7, 2: 5, 3: 8})
    folded = D.stratified_kfold(df, "label", "id", 5)
    cells = Counter((r["fold"], r["label"]) for r in folded.collect())
    row = D.fold_summary(folded, 5).first()
    sizes = [sum(cells[f, c] for c in range(4)) for f in range(5)]
    assert [f["test_size"] for f in row["folds"]] == sizes
    assert row["class_counts"] == {"1": 11, "2": 7, "3": 5, "4": 8}
    assert row["test_size_std"] == pytest.approx(pstdev(sizes))
    ratios = [cells[f, 1] / sizes[f] for f in range(5)]
    assert row["test_ratio_std"]["2"] == pytest.approx(pstdev(ratios))
    assert row["folds"][3]["test_ratio"]["2"] == pytest.approx(ratios[3])


def test_dense_position_with_a_hot_first_key(spark):
    rows = [(0 if i % 3 else i, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "a long, b long")
    got = R.dense_position(df, ["a", "b"]).collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["position"])] == sorted(rows)
    assert sorted(r["position"] for r in got) == list(range(5000))


def test_no_hot_partition_after_range_layout(spark):
    df = spark.range(20_000).select(F.lit(0).alias("a"), F.col("id").alias("b"))
    sizes = [r["count"] for r in R.lay_out(df, ["a", "b"]).groupBy("_part").count().collect()]
    assert len(sizes) > 4
    assert max(sizes) < 20_000 / 3


@pytest.mark.parametrize("order", [["pos"], ["pos", "text"]])
def test_positions_with_ties_and_null_keys(spark, order):
    rows = [(1, "a", 1), (1, "a", 2), (1, "b", 3), (None, "b", 4), (None, "b", 5), (2, "c", 6), (2, "c", 6), (2, None, 6)]
    df = spark.createDataFrame(rows, "pos int, text string, id int")
    got = R.dense_position(df, order).collect()
    assert sorted(r["position"] for r in got) == list(range(len(rows)))
    assert sorted(((r["pos"], r["text"], r["id"]) for r in got), key=repr) == sorted(rows, key=repr)
    keys = [tuple((r[c] is not None, r[c]) for c in order) for r in sorted(got, key=lambda r: r["position"])]
    assert keys == sorted(keys)


def test_a_hot_key_is_split_over_ranges(spark):
    df = spark.range(20_000).select(F.lit(None).cast("int").alias("a"), F.col("id").alias("b"))
    sizes = [r["count"] for r in R.lay_out(df, ["a"]).groupBy("_part").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 20_000 / 3


def test_ids_with_ties(spark):
    from labelflow.operators.tasks import assign_ids, default_ids

    df = spark.createDataFrame([(1, None), (1, 7), (None, None), (None, None)], "pos int, id long")
    assert sorted(r["name"] for r in assign_ids(df, ["pos"], out="name").collect()) == ["S001", "S002", "S003", "S004"]
    assert default_ids(df, ["pos"]).count() == 4
