"""The activity log: append by day, read the last days, digest of the newest entries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank, preview, timestamp_text
from ..schemas import ACTIVITY
from .folders import drop_folders, file_system, names, numbered

# The digest's wording.
EMPTY_NOTICE = "📭 目前沒有使用記錄"
HEADER = "📊 最近使用記錄 (共 %d 筆)\n\n"
ENTRY = "%s %s\n輸入: %s\n目標: %s | 結果: Level %d\n輸出: %s\n---\n"
ICONS = ("✅", "❌")
# ISO date and time with microseconds and no zone, as the log's files have it.
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def append_activity(df: DataFrame, path: str) -> str:
    """Add entries to their day's folder. Existing files are not read or rewritten; :func:`merge_days` makes one file of a day."""
    dated = df.withColumn("date", F.to_date("timestamp"))
    writer = dated.write.mode("append").partitionBy("date")
    writer.option("ignoreNullFields", False).option("timestampFormat", TIMESTAMP_FORMAT).json(path)
    return path


def last_days(df: DataFrame, days: int, as_of: dt.date | str, date: str = "date") -> DataFrame:
    """Entries of ``as_of`` and the ``days - 1`` days before it."""
    end = F.lit(str(as_of)).cast("date")
    return df.where((F.col(date) > F.date_sub(end, days)) & (F.col(date) <= end))


def read_activity(spark: SparkSession, path: str, days: int, as_of: dt.date | str) -> DataFrame:
    """The last days of the log. Only the folders of those days are looked up and listed; missing days are just empty.

    A day that has been merged (see :func:`merge_days`) is read from its one file, with what was appended since.
    """
    end = dt.date.fromisoformat(str(as_of))
    return _entries(spark, path, [str(end - dt.timedelta(days=i)) for i in range(days)])


def _entries(spark: SparkSession, path: str, days: list[str]) -> DataFrame:
    schema = f"{ACTIVITY}, date date"
    found = [f for day in days for f in _files_of(spark, path, day)]
    if not found:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(ACTIVITY).option("recursiveFileLookup", True).json(found)
    day = F.regexp_extract(F.col("_metadata.file_path"), r"/date=(\d{4}-\d{2}-\d{2})/", 1)
    return rows.withColumn("date", F.to_date(day))


def merged_path(path: str) -> str:
    """Where merged days lie: beside the log, so that a stream on the log's folders does not read entries again."""
    return f"{path.rstrip('/')}-merged"


def _merged(spark: SparkSession, path: str, day: str) -> tuple[str | None, set[str]]:
    """The newest merged folder of a day, and the names of the log's files that it holds."""
    at = f"{merged_path(path)}/date={day}"
    versions = numbered(spark, at, "v")
    if not versions:
        return None, set()
    newest = f"{at}/v={versions[-1]}"
    return newest, {r[0] for r in spark.read.text(f"{newest}/_held").collect()}  # a row per file of one day


def _files_of(spark: SparkSession, path: str, day: str) -> list[str]:
    """What holds the entries of a day: its merged folder's files, and the log's files that are not in it."""
    newest, held = _merged(spark, path, day)
    own = lambda at: [f"{at}/{n}" for n in names(spark, at) if not n.startswith(("_", "."))]
    return [*(own(newest) if newest else []), *[f for f in own(f"{path}/date={day}") if f.rsplit("/", 1)[1] not in held]]


def merge_days(spark: SparkSession, path: str, before: dt.date | str) -> list[str]:
    """Bring each day before ``before`` into one file; returns the days that have changed.

    The merged file is written apart, with the list of files that it holds, and gets its name by a rename: readers
    see either the files or the merged one. What it holds is deleted by the next call, when readers that had
    listed it are done, so calls should be further apart than a read takes, and a stream on the log no further behind than that. Entries
    appended to a merged day are read beside it until the next call takes them in.
    """
    days = [n.removeprefix("date=") for n in names(spark, path) if n.startswith("date=") and n.removeprefix("date=") < str(before)]
    changed = []
    for day in sorted(days):
        newest, held = _merged(spark, path, day)
        here = {n for n in names(spark, f"{path}/date={day}") if not n.startswith(("_", "."))}
        drop_folders(spark, [f"{path}/date={day}/{n}" for n in here & held])
        at = f"{merged_path(path)}/date={day}"
        versions = numbered(spark, at, "v")
        drop_folders(spark, [f"{at}/v={v}" for v in versions[:-1]])
        if not here - held:
            continue
        staged, version = f"{at}/_staged", (versions or [0])[-1] + 1
        rows = _entries(spark, path, [day]).drop("date").coalesce(1)
        rows.write.mode("overwrite").option("ignoreNullFields", False).option("timestampFormat", TIMESTAMP_FORMAT).json(staged)
        listed = spark.createDataFrame([(n,) for n in sorted(here - held)], "name string")
        listed.coalesce(1).write.mode("overwrite").text(f"{staged}/_held")
        files, made = file_system(spark, staged)
        files.rename(made, file_system(spark, f"{at}/v={version}")[1])
        changed.append(day)
    return changed


def recent_activity(df: DataFrame, n: int = 50, tie: str | None = None) -> DataFrame:
    """The newest n entries; ``tie`` orders equal timestamps."""
    order = [F.desc("timestamp"), *([F.asc(tie)] if tie else [])]
    return df.orderBy(*order).limit(n)


def activity_digest(df: DataFrame, n: int = 50, tie: str | None = None) -> DataFrame:
    """One text for the newest n entries, newest first, under a header with their number."""
    icon = F.when(F.col("success"), ICONS[0]).otherwise(ICONS[1])
    entry = F.format_string(
        ENTRY,
        icon,
        timestamp_text("timestamp"),
        preview("input_text", 30),
        F.col("target_level"),
        F.col("predicted_score"),
        preview("output_text", 50),
    )
    rank = F.struct((-F.unix_micros("timestamp")).alias("t"), *([F.col(tie).alias("tie")] if tie else []))
    listed = recent_activity(df, n, tie).select(F.struct(rank.alias("o"), entry.alias("e")).alias("r"))
    texts = F.transform(F.array_sort(F.collect_list("r")), lambda r: r["e"])
    whole = listed.agg(texts.alias("t"))
    text = F.concat(F.format_string(HEADER, F.size("t")), F.array_join("t", ""))
    return whole.select(F.when(F.size("t") == 0, F.lit(EMPTY_NOTICE)).otherwise(text).alias("digest"))


def usable_requests(df: DataFrame, text: str = "input_text") -> DataFrame:
    """Requests with something to rewrite."""
    return df.where(~is_blank(text))
