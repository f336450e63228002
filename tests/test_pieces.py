"""JSON arrays and CSV with quoted line breaks, cut at every few bytes."""

import csv
import json
import random

import pytest
from labelflow.sources import files as IO
from labelflow.sources.pieces import json_array_records, read_pieces
from pyspark.sql import functions as F

LAYOUT = "id long, text string, more struct<a:array<struct<b:string>>>"


@pytest.fixture(params=[64, 1000])
def small_blocks(spark, request):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def records(n=60):
    rng = random.Random(5)
    parts = ['}', '{', '"', "\\", "],[", "\n", "text", "}]", '\\"', "漢", ","]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
    return [
        {"id": i, "text": None if i % 7 == 0 else word(), "more": None if i % 3 else {"a": [{"b": word()} for _ in range(i % 4)]}}
        for i in range(n)
    ]


def as_rows(found):
    plain = lambda m: None if m is None else [x["b"] for x in m["a"]]
    return sorted(((r["id"], r["text"], plain(r["more"])) for r in found), key=repr)


@pytest.mark.parametrize("indent", [None, 2])
def test_one_array_file_in_many_tasks(spark, small_blocks, tmp_path, indent):
    wanted = records()
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text(json.dumps(wanted, ensure_ascii=False, indent=indent) + "\n", encoding="utf-8")
    one = str(tmp_path / "a.json")
    assert read_pieces(spark, one, "}").rdd.getNumPartitions() > 4
    assert as_rows(IO.read_json_array(spark, one, LAYOUT).collect()) == as_rows(wanted)
    assert as_rows(IO.read_json_array(spark, str(tmp_path), LAYOUT).collect()) == as_rows(wanted * 2)


def test_empty_arrays_and_errors(spark, tmp_path):
    for i, (text, n) in enumerate([("[]", 0), (" [ ] ", 0), ('[{"id": 1}]', 1), ('[{"id":1},{"id":2}\n]\n', 2), ("﻿[{}]", 1)]):
        path = tmp_path / f"{i}.json"
        path.write_text(text, encoding="utf-8")
        assert IO.read_json_array(spark, str(path), "id long").count() == n
    for i, text in enumerate(['{"id": 1}', "[1, 2]", '[{"id": 1} {"id": 2}]', '[[{"id": 1}]]', '[{"id": "x"}]']):
        path = tmp_path / f"bad{i}.json"
        path.write_text(text, encoding="utf-8")
        with pytest.raises(Exception, match=r"list of records|MALFORMED|FAILFAST|malformed"):
            IO.read_json_array(spark, str(path), "id long").collect()


def test_csv_with_quoted_line_breaks_in_many_tasks(spark, small_blocks, tmp_path):
    rng = random.Random(6)
    parts = ['"', "\n", ",", "text", " ", "漢", "\r\n", '""']
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(10))), i % 5) for i in range(80)]
    path = tmp_path / "a.csv"
    with path.open("w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f, quoting=csv.QUOTE_NONNUMERIC)
        out.writerow(["id", "text\nof line", "n"])
        out.writerows(rows)
    schema = "id int, text string, n int"
    got = IO.read_scoring_csv(spark, str(path), schema, split=True)
    assert sorted(map(tuple, got.collect())) == rows


@pytest.mark.parametrize("ends", [True, False])
def test_csv_records_longer_than_several_blocks(spark, small_blocks, tmp_path, ends):
    rows = [(i, ("x" * 40 + "\n") * (i % 4 * 50) + '"', i) for i in range(12)]
    for name in ("a", "b"):
        with (tmp_path / f"{name}.csv").open("w", encoding="utf-8", newline="") as f:
            out = csv.writer(f, quoting=csv.QUOTE_NONNUMERIC, lineterminator="\n")
            out.writerow(["id", "text", "n"])
            out.writerows(rows if ends else [*rows, (99, "end", 1)])
    got = IO.read_scoring_csv(spark, str(tmp_path), "id int, text string, n int", split=True)
    assert sorted(tuple(r) for r in got.collect() if r["id"] < 99) == sorted(rows * 2)


def test_split_csv_moves_no_whole_texts(spark, tmp_path):
    """Records are put together where they are read: only a table of blocks and parts of records across blocks are shuffled."""
    path = IO.write_results_csv(spark.range(200).select("id", F.lit("a\nb").alias("text")), str(tmp_path / "out"))
    got = IO.read_scoring_csv(spark, path, "id long, text string", split=True)
    assert sorted(map(tuple, got.collect())) == [(i, "a\nb") for i in range(200)]
    shuffled = got._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in shuffled.splitlines() if "Exchange hashpartitioning" in line and "_line" in line]
    assert not [p for p in got.inputFiles() if "labelflow-pieces" in p]


def test_csv_nulls_and_empty_texts(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text,n\n1,,5\n2,"",\n\n3," a ",7\n', encoding="utf-8")
    got = IO.read_scoring_csv(spark, str(tmp_path / "a.csv"), "id int, text string, n int", split=True)
    assert sorted(map(tuple, got.collect())) == [(1, None, 5), (2, "", None), (3, " a ", 7)]


def test_records_in_one_piece_are_not_shuffled_together(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": i} for i in range(100)]), encoding="utf-8")
    assert json_array_records(spark, str(tmp_path / "a.json")).count() == 100
