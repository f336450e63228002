"""File sources and sinks: JSON lines, JSON arrays, scoring CSV, folds, metrics, run output."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import file_stem
from ..operators.folds import fold_view
from ..schemas import SCORING_CSV
from .folders import drop_folders, file_system, names, numbered
from .pieces import csv_records, json_array_records

# Quotes are doubled, and blanks at the ends of a value are kept in both directions.
CSV = {
    "header": True,
    "escape": '"',
    "quote": '"',
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
POSITION = ("_file", "_block", "_line")
FILE_ROWS = 4096


def read_jsonl(
    spark: SparkSession, path: str | list[str], schema: str, mode: str = "PERMISSIVE", position: bool = False
) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped.

    ``PERMISSIVE`` keeps a bad line as text in ``_corrupt_record``; ``FAILFAST`` stops at the first one.
    ``position`` adds the columns ``POSITION``, which order rows as they stand in the files.
    """
    layout = schema if mode != "PERMISSIVE" else f"{schema}, _corrupt_record string"
    df = spark.read.schema(layout).option("mode", mode).json(path)
    if not position:
        return df
    # A task reads whole blocks from start to end, so its running row number orders the rows of a block.
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold one JSON array of records; anything else is an error. A large file is read by several tasks."""
    layout = f"struct<{_as_struct(schema)}>"
    return json_array_records(spark, path).select(F.from_json("record", layout, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def _as_struct(schema: str) -> str:
    fields = T.StructType.fromDDL(schema).fields
    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in fields)


def read_scoring_csv(spark: SparkSession, path: str, schema: str = SCORING_CSV, split: bool = False) -> DataFrame:
    """Header CSV with quoted line breaks. One file is one task, unless it is ``split`` at records found by counting quotes.

    Nothing between two commas is null, a quoted nothing is the empty text. They differ only when the null
    marker, which the parser puts in for the former, is a text that no file holds.
    """
    options = {**CSV, "nullValue": "\x00"}
    if not split:
        return spark.read.schema(schema).options(**options, multiLine=True).csv(path)
    texts = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items() if k != "header"}
    return csv_records(spark, path).select(F.from_csv("record", schema, texts).alias("r")).select("r.*")


def concat_datasets(*tables: DataFrame) -> DataFrame:
    """All rows of all tables, duplicates kept; absent columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def dataset_sizes(**tables: DataFrame) -> DataFrame:
    """Rows of each named table and of all together, in one job."""
    named = [t.select(F.lit(name).alias("dataset")) for name, t in tables.items()]
    rows = reduce(DataFrame.unionAll, named)
    return rows.groupingSets([[F.col("dataset")], []], "dataset").agg(F.count("*").alias("rows"))


def write_results_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """CSV with a header per part file; no byte-order mark is written.

    A file with quoted line breaks is read by one task, so none gets more than ``FILE_ROWS`` records.
    """
    df.write.mode(mode).options(**CSV, maxRecordsPerFile=FILE_ROWS).csv(path)
    return path


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> str:
    """JSON lines, UTF-8, null fields written."""
    df.write.mode(mode).option("ignoreNullFields", False).partitionBy(*partition_by).json(path)
    return path


def fold_rows(df: DataFrame, k: int) -> DataFrame:
    """Every row once per fold, marked train or test: what the k train and test files hold together."""
    folds = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda i: F.struct(i.alias("fold"), F.when(i == F.col("_own"), "test").otherwise("train").alias("part")),
    )
    others = [c for c in df.columns if c != "fold"]
    return df.withColumn("_own", F.col("fold")).select(*others, F.inline(folds))


def write_folds(df: DataFrame, path: str, k: int) -> str:
    """``fold=i/part=train|test`` folders of JSON lines. Rows go straight from scan to file, unshuffled."""
    return write_jsonl(fold_rows(df, k), path, partition_by=("fold", "part"))


def write_metrics(df: DataFrame, path: str) -> str:
    """A small metrics table as one JSON text file."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.text(path)
    return path


def report_lines(settings: dict[str, str], prefix: str, accuracy: float, matrix: list[list[int]]) -> list[str]:
    """Text report: settings, the first 1000 characters of the shared prompt, accuracy, matrix."""
    rows = [" ".join(str(n) for n in row) for row in matrix]
    return [
        *[f"{k}: {v}" for k, v in settings.items()],
        "-" * 29,
        prefix[:1000],
        "-" * 29,
        f"accuracy: {accuracy:.2f}%",
        "confusion matrix (rows: true, columns: predicted)",
        *rows,
    ]


def write_report(spark: SparkSession, lines: list[str], path: str) -> str:
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    return path


def next_run_id(spark: SparkSession, base: str) -> int:
    """One more than the highest ``run_id=n`` folder under ``base``; two runs that race for it collide on write."""
    return max(numbered(spark, base, "run_id"), default=0) + 1


def publish_run(
    spark: SparkSession, base: str, write: Callable[[str | None, str], object], patience: float = 60.0, sleep: Callable = time.sleep
) -> str:
    """Store a result that builds on the newest run folder as the next one, also while other runs do the same; returns its path.

    ``write(newest run or None, path)`` writes the result to a folder of its own. The number is claimed by a marker file, which one run
    alone can create, and the folder gets its name by a rename. A run that finds the number taken, or a newer folder than the
    one it has read, begins anew from that. A claim whose folder does not appear within ``patience`` seconds is that of a run that died.
    """
    waited = 0.0
    while True:
        last = max(numbered(spark, base, "run_id"), default=0)
        claims = [int(n.removeprefix("_claim-")) for n in names(spark, base) if n.startswith("_claim-")]
        taken = max([last, *claims])
        if taken > last and waited < patience:  # another run is about to publish
            sleep(0.2)
            waited += 0.2
            continue
        staged = f"{base}/_staged-{uuid.uuid4().hex[:12]}"
        write(f"{base}/run_id={last}" if last else None, staged)
        files, claim = file_system(spark, f"{base}/_claim-{taken + 1}")
        try:
            mine = files.createNewFile(claim)
        except Py4JJavaError:
            mine = False
        newest = max(numbered(spark, base, "run_id"), default=0)
        if mine and newest == last:
            path = f"{base}/run_id={taken + 1}"
            files.rename(file_system(spark, staged)[1], file_system(spark, path)[1])
            drop_folders(spark, [f"{base}/_claim-{n}" for n in claims])
            return path
        drop_folders(spark, [staged, *([f"{base}/_claim-{taken + 1}"] if mine else [])])
        waited = 0.0


def run_output(df: DataFrame, base: str, run_id: int | str | None = None, by: tuple[str, ...] = ("model",)) -> str:
    """Write one run to its own folder, never over an earlier one. Without ``run_id`` the next counter is used."""
    run_id = next_run_id(df.sparkSession, base) if run_id is None else run_id
    path = f"{base}/run_id={run_id}"
    parts = [c for c in by if c in df.columns]
    df.write.mode("errorifexists").partitionBy(*parts).parquet(path)
    return path


def stamped_name(stem: str) -> str:
    """``stem_scored_<epoch seconds>``"""
    return f"{stem}_scored_{int(time.time())}"


# A table stored as a folder: a folder with the ending of a data format, or one that holds the part files of a Spark job.
TABLE_FOLDER = r"(?i)^(.*/[^/=]+\.(?:parquet|orc|avro|csv|jsonl?|txt|text|delta))/.*$"
PART_FILE = r"^(.*?)(?:/[^/=]+=[^/]*)*/part-\d+[^/]*$"


def with_source_stem(df: DataFrame, out: str = "source") -> DataFrame:
    """Add the stem of the file each row was read from, to name a run after its input.

    Of a table that is stored as a folder of files, all rows get the stem of the folder.
    """
    path = F.col("_metadata.file_path")
    table = F.regexp_replace(F.regexp_replace(path, TABLE_FOLDER, "$1"), PART_FILE, "$1")
    return df.withColumn(out, file_stem(table))
