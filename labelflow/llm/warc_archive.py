"""A content-addressed WARC archive.

A record is stored in two tables under one folder: ``headers`` has one row per record with its exact header block, and
``payloads`` has each distinct payload once, under the SHA-256 of its bytes. Reading joins them on that digest and gives back
every record byte for byte. Payload digests are verified on reading; equal digests with unequal lengths or SHA-1
digests stop the write.

Of records with equal payloads of at least ``min_bytes``, the one with the largest id is the response and the others are
revisits, whose header block names it. The choice is made on digests and ids alone; payloads move once, in the join that picks
the stored copy.

Defined cases: a null payload is an empty one; shorter payloads are always responses, but are stored once too; records with
one id and one payload (repeated rows) are all responses when that id is the largest; a null id is smaller than all others and
stays null; a null URL gives a header block without target; an empty table gives an empty archive. Only the three named columns
are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named

MIN_BYTES = 1000
END = "\r\n"


def _line(name: str, *value: Column | str) -> Column:
    """One header line, or null if any part of its value is."""
    return F.concat(F.lit(f"{name}: "), *[F.lit(v) if isinstance(v, str) else v for v in value], F.lit(END))


def _uri(kind: str, c: Column) -> Column:
    """A URL may hold characters that would end a header line; they are percent-encoded."""
    return F.regexp_replace(F.regexp_replace(c, "\r", "%0D"), "\n", "%0A") if kind == "url" else c.cast("string")


def header_block(record: DataFrame) -> Column:
    """The WARC header lines of a record, up to and including the empty line."""
    revisit = F.col("record_type") == "revisit"
    lines = [
        F.lit(f"WARC/1.1{END}"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", "<urn:record:", F.col("record_id").cast("string"), ">"),
        _line("WARC-Target-URI", _uri("url", F.col("url"))),
        _line("WARC-Payload-Digest", "sha1:", F.col("payload_digest")),
        F.when(revisit, _line("WARC-Refers-To", "<urn:record:", F.col("refers_to").cast("string"), ">")),
        F.when(revisit, _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("Content-Type", "text/html; charset=utf-8"),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit(END),
    ]
    return F.concat_ws("", *lines).cast("binary")


def write_archive(
    df: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = MIN_BYTES,
) -> None:
    """Write every row of ``df`` as a record of the archive at ``path`` (``headers`` and ``payloads``)."""
    payload = F.coalesce(named(df, payload_col).cast("binary"), F.lit(b""))
    digests = df.select(
        named(df, id_col).alias("record_id"),
        named(df, url_col).alias("url"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.sha1(payload).alias("payload_digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
    )
    per = (
        digests.groupBy("payload_sha256")
        .agg(
            F.max("record_id").alias("owner"),
            F.min(F.struct("payload_bytes", "payload_digest")).alias("least"),
            F.max(F.struct("payload_bytes", "payload_digest")).alias("most"),
        )
        .select(
            "payload_sha256",
            F.when(F.col("least") == F.col("most"), F.col("owner"))
            .otherwise(F.raise_error(F.lit("two payloads share a digest")).cast(digests.schema["record_id"].dataType))
            .alias("owner"),
        )
    )
    revisit = (F.col("payload_bytes") >= min_bytes) & ~F.col("record_id").eqNullSafe(F.col("owner"))
    records = (
        digests.join(per, "payload_sha256")
        .withColumn("record_type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")))
        .withColumn("refers_to", F.when(revisit, F.col("owner")))
    )
    records.select("record_id", "payload_sha256", header_block(records).alias("header")).write.parquet(f"{path}/headers")

    stored = df.select(
        named(df, id_col).alias("record_id"), F.sha2(payload, 256).alias("payload_sha256"), payload.alias("payload")
    )
    owner = per.select(F.col("payload_sha256").alias("_sha256"), F.col("owner").alias("_owner"))
    is_owner = (F.col("payload_sha256") == F.col("_sha256")) & F.col("record_id").eqNullSafe(F.col("_owner"))
    stored.join(owner, is_owner, "left_semi").select("payload_sha256", "payload").write.parquet(f"{path}/payloads")


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads whose bytes are those of their digest; others stop the job."""
    stored = spark.read.parquet(f"{path}/payloads")
    sound = F.sha2("payload", 256) == F.col("payload_sha256")
    checked = F.when(sound, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload is damaged")).cast("binary"))
    return stored.select("payload_sha256", checked.alias("payload"))


def _field(name: str) -> Column:
    found = F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Header fields of every record with what its payload really is, from the archive alone.

    ``(record_id, url, record_type, refers_to, header_digest, payload_sha256, payload_bytes, payload_digest)``; the last two are
    computed from the stored bytes, which are reduced to them before the join.
    """
    headers = spark.read.parquet(f"{path}/headers")
    id_type = headers.schema["record_id"].dataType
    facts = _payloads(spark, path).select(
        "payload_sha256",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
    )
    facts = facts.dropDuplicates(["payload_sha256"])  # repeated rows store a payload more than once
    bare = lambda c, start: F.regexp_extract(c, rf"{start}([^>]*)", 1)
    return headers.join(facts, "payload_sha256").select(
        F.col("record_id"),
        _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"),
        bare(_field("WARC-Refers-To"), "<urn:record:").cast(id_type).alias("refers_to"),
        bare(_field("WARC-Payload-Digest"), "sha1:").alias("header_digest"),
        "payload_sha256",
        "payload_bytes",
        "payload_digest",
    )


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """``(record_id, header, payload, record)``: each original record; a revisit's payload is that of its response.

    ``record`` is what stands in a WARC file: the header block, the payload unless it is a revisit, and two line ends.
    """
    headers = spark.read.parquet(f"{path}/headers")
    payloads = _payloads(spark, path).dropDuplicates(["payload_sha256"])
    body = F.when(F.col("header").cast("string").rlike(r"\r\nWARC-Type: revisit\r\n"), F.lit(b"")).otherwise(F.col("payload"))
    return headers.join(payloads, "payload_sha256").select(
        "record_id", "header", "payload", F.concat("header", body, F.lit((END * 2).encode())).alias("record")
    )
