"""Numbered folders on the file system that Spark uses: listing, and dropping those that are no longer read."""

from __future__ import annotations

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str) -> tuple:
    """The path's file system and the path, as Hadoop objects."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none where it does not exist."""
    files, folder = file_system(spark, path)
    return [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []


def numbered(spark: SparkSession, path: str, name: str) -> list[int]:
    """The ``n`` of all folders ``name=n`` in ``path``, rising."""
    start = f"{name}="
    return sorted(int(n[len(start) :]) for n in names(spark, path) if n.startswith(start) and n[len(start) :].isdigit())


def drop_folders(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        files, folder = file_system(spark, path)
        files.delete(folder, True)
