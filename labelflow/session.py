"""Session helpers: a local test session, and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, partitions: int = 8, app: str = "labelflow") -> SparkSession:
    """A single-machine session for tests and benches; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A temporary folder is made only when the setting is absent and the session is local.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not configured:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
            configured = tempfile.mkdtemp(prefix="labelflow-", dir="/tmp")
        sc.setCheckpointDir(configured)
    return configured or sc.getCheckpointDir()


_scratch: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, for tables that are written and read back.

    Results read those tables when they run, so they stay until :func:`clear_scratch`.
    """
    path = f"{checkpoint_root(spark).rstrip('/')}/labelflow-{name}-{uuid.uuid4().hex[:12]}"
    _scratch.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables of this process, when all results that read them have been stored; returns their number."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        n += bool(path.getFileSystem(hadoop).delete(path, True))
    return n


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, so that later uses neither re-run nor
    differ, and lost executors lose nothing. Readers of a few columns read only those."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
