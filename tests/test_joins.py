from collections import Counter

from labelflow.operators.joins import complement, spread_lookup
from labelflow.operators.tasks import expand_targets, experiment_grid, score_distinct
from pyspark.sql import functions as F


def skewed(spark, n=9000):
    """A third of the rows on one key, some null keys, the rest unique."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.col("id").cast("string"))
    return spark.range(n).select("id", key.alias("k"))


def test_spread_lookup_equals_plain_join(spark):
    rows = skewed(spark)
    table = rows.where("k IS NOT NULL").select("k").distinct().where("k != '5'").withColumn("v", F.length("k"))
    plain = {r["id"]: r["v"] for r in rows.join(table, "k", "left").collect()}
    spread = spread_lookup(rows, table, "k", ["id"])
    assert {r["id"]: r["v"] for r in spread.collect()} == plain
    assert spread.count() == 9000


def test_hot_key_is_split_over_tasks(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = skewed(spark)
        table = rows.where("k IS NOT NULL").select("k").distinct().withColumn("v", F.lit(1))
        parts = Counter(
            r["p"] for r in spread_lookup(rows, table, "k", ["id"]).select(F.spark_partition_id().alias("p")).collect()
        )
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 10 << 20)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(parts.values()) < 9000 / 3


def test_complement_covers_and_is_disjoint(spark):
    rows = skewed(spark)
    test = rows.where("id % 7 = 0").select("k").unionAll(rows.where("id = 3").select("k"))
    names = {r["k"] for r in test.collect() if r["k"] is not None}
    expected = sorted(r["id"] for r in rows.collect() if r["k"] not in names)
    assert sorted(r["id"] for r in complement(rows, test, "k", ["id"]).collect()) == expected


def test_each_text_is_scored_once(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    seen = []

    def scorer(texts):
        seen.append(texts.count())
        return texts.withColumn("predicted_score", F.length("text"))

    out = score_distinct(rows, "text", scorer, ["id"]).collect()
    assert seen == [rows.select("text").distinct().count()]
    assert len(out) == 1000
    assert all(r["original_score"] == len(r["text"]) for r in out)


def test_task_counts(spark):
    sizes = {1: 61, 2: 39, 3: 39, 4: 50}
    rows = spark.createDataFrame([(s,) for s, n in sizes.items() for _ in range(n)], "score int")
    tasks = expand_targets(rows)
    assert tasks.count() == 567
    by_target = {r["target"]: r["count"] for r in tasks.groupBy("target").count().collect()}
    assert by_target == {1: 128, 2: 150, 3: 150, 4: 139}
    assert experiment_grid(tasks, ["a", "b", "c"], {"x": False, "y": True}).count() == 567 * 6
