"""URL block and allow rules, looked up the way blocklist clients do it.

A URL is expanded into expressions: each suffix of its host at a dot, with each prefix of its path at a slash. Rules and
expressions are hashed with SHA-256; they meet in an equi-join on the first 32 bits, which keeps the join key short, and
the full digest, the exact path prefix and then the precedence among rules are settled on the few pairs that meet.

A rule covers its host and all subdomains, for paths that start with the rule's path. The longest rule wins; of two equally
long ones the one with the longer host, then a block before an allow. Expansion stops at the number of host labels and
path slashes that any rule has, so a hostile URL cannot blow it up. Distinct (host, path) pairs are judged once and joined
back, so a URL that very many pages share costs no more than its rows.

Defined cases: a null URL or one without ``://`` has an empty host and an empty path and meets no rule; rules with a null or empty
host, path or verdict are ignored, and repeated rules count once; with no rules at all everything gets the default verdict.
Only the id and URL columns are read, so other columns may have any name. Repeated rows each get a verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, named

PREFIX_DIGITS = 8  # hex digits of the join key: 32 bits
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
RULES_SCHEMA = "host string, path string, verdict string"


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULES_SCHEMA)


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda group: F.coalesce(F.regexp_extract(url, SPLIT, group), F.lit(""))
    return ascii_lower(part(1)), part(2)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path).cast("binary"), 256)


def _host_suffixes(host: Column, labels: int) -> Column:
    """The host itself and its parents of at most ``labels`` labels; a rule with more labels than that does not exist."""
    parts = F.split(host, r"\.", -1)
    n = F.size(parts)
    sizes = F.sequence(F.lit(1), F.least(n, F.lit(labels)))
    return F.transform(sizes, lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))


def _path_prefixes(path: Column, slashes: int) -> Column:
    """The starts of a path that end with one of its first ``slashes`` slashes, and the empty start."""
    parts = F.slice(F.split(path, "/", -1), 1, slashes + 1)
    ends = F.sequence(F.lit(1), F.size(parts))
    return F.transform(
        ends, lambda k: F.when(k == 1, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, k - 1), "/"), F.lit("/")))
    )


def judge_urls(
    df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """``(id, host, path, rule, verdict)`` of every row."""
    host, path = host_and_path(named(df, url_col))
    urls = df.select(named(df, id_col).alias(id_col), host.alias("host"), path.alias("path"))
    full = (
        rules.select(*[F.col(c).cast("string") for c in ("host", "path", "verdict")])
        .where("host <> '' AND path <> '' AND verdict <> ''")
        .select(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
        .distinct()
    )
    # A rule is filed under its path up to the last slash; the rest of it is compared when it has been found.
    filed = F.regexp_extract("rule_path", "(?s)^(.*/)?", 1)
    book = full.withColumn("digest", _digest(F.col("rule_host"), filed)).withColumn(
        "key", F.substring("digest", 1, PREFIX_DIGITS)
    )
    most = full.agg(
        F.max(F.size(F.split("rule_host", r"\.", -1))), F.max(F.size(F.split("rule_path", "/", -1)) - 1)
    ).first()
    labels, slashes = most[0] or 0, most[1] or 0
    if not labels:
        return urls.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    expressions = (
        urls.select("host", "path")
        .where("host <> ''")
        .distinct()
        .withColumn("suffix", F.explode(_host_suffixes(F.col("host"), labels)))
        .withColumn("start", F.explode(_path_prefixes(F.col("path"), slashes)))
        .withColumn("digest", _digest(F.col("suffix"), F.col("start")))
        .withColumn("key", F.substring("digest", 1, PREFIX_DIGITS))
    )
    met = expressions.join(book.withColumnsRenamed({"digest": "rule_digest", "verdict": "rule_verdict"}), "key").where(
        (F.col("digest") == F.col("rule_digest")) & F.startswith("path", F.col("rule_path"))
    )
    rule = F.concat("rule_host", "rule_path")
    rank = F.struct(
        F.length(rule).alias("size"),
        F.length("rule_host").alias("host_size"),
        (F.col("rule_verdict") == "block").alias("blocks"),
        rule.alias("rule"),
        F.col("rule_verdict").alias("verdict"),
    )
    best = met.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(
        id_col,
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
