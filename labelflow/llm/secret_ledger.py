"""Secret scanning over a ledger of content-addressed blobs.

Each version of a file is addressed by the SHA-256 of its text. The ledger says which (blob, rule version) pairs have been
scanned and what was found; only pairs it does not hold yet are scanned, once per distinct text however many
paths carry it, and findings are joined back to every path by digest. Everything is DataFrame functions: spans come
from regular expressions anchored at the end of the previous match, whose gap and match lengths are summed up.

Defined cases: a null text is an empty text; texts without findings get an empty list; several rows with one path
each get their own result; an empty table gives an empty result. Offsets are code points, end exclusive. Only the text
column is read by the scan, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import fresh, let, named, running, whole_text


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping; those whose ``group`` is shorter than ``least`` are dropped.

    ``hint`` is a cheaper pattern that every text with such a match contains.
    """

    kind: str
    pattern: str
    hint: str
    group: int = 0
    least: int = 0


VERSION = "2"
# Kinds in the order in which findings at one place are listed. Inner groups do not capture, except one.
RULES = [
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""",
        1,
        12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{14}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", r"[0-9a-f]{16}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]{8}"),
]


def _lengths(text: Column, rule: Rule, group: int) -> Column:
    """Code points of one group of every step; group 0 is the gap since the previous match with the match itself.

    ``\\G`` ties each step to the end of the one before, so a text is walked once.
    """
    steps = F.regexp_extract_all(text, F.lit(rf"(?s)\G.*?({rule.pattern})"), F.lit(group))
    return F.transform(steps, F.length)


SPANS = "array<struct<start:int,order:int,kind:string,stop:int>>"


def _spans(steps: Column, rule: Rule, order: int) -> Column:
    """Places of the matches from the lengths of all steps before them, summed up in runs: work is in proportion to the findings."""

    def placed(stops: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            stop = F.get(stops, i)
            place = F.struct(
                (stop - x["size"]).alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), stop.alias("stop")
            )
            return F.when(x["value"] >= rule.least, place)

        return F.filter(F.transform(steps, span), lambda x: x.isNotNull())

    return let(running(F.transform(steps, lambda x: x["step"])), placed)


def with_spans(df: DataFrame, text_col: str, out: str, rules: list[Rule] = RULES) -> DataFrame:
    """Adds ``out``: array of ``(start, order, kind, stop)``, sorted, for all findings in the text."""
    names = fresh(df, *[f"_steps{i}" for i in range(len(rules))])
    text = F.col(f"`{text_col}`")
    steps = [
        F.when(
            text.rlike(rule.hint),
            F.arrays_zip(
                _lengths(text, rule, 0).alias("step"),
                _lengths(text, rule, 1).alias("size"),
                _lengths(text, rule, 1 + rule.group).alias("value"),
            ),
        ).alias(name)
        for rule, name in zip(rules, names, strict=True)
    ]
    found = [
        F.coalesce(_spans(F.col(name), rule, order), F.array().cast(SPANS))
        for order, (rule, name) in enumerate(zip(rules, names, strict=True))
    ]
    return df.select("*", *steps).select(
        *[F.col(f"`{c}`") for c in df.columns], F.sort_array(F.concat(*found)).alias(out)
    )


def listed(spans: Column, kinds: list[str] | None = None) -> Column:
    """``kind:start:stop`` of each span, comma-joined; only of some kinds if they are given."""
    chosen = F.filter(spans, lambda x: x["kind"].isin(kinds)) if kinds else spans
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))
    return F.array_join(F.transform(chosen, one), ",")


def scan_unseen(versions: DataFrame, ledger: DataFrame, rules: list[Rule] = RULES, version: str = VERSION) -> DataFrame:
    """Ledger rows ``(blob, rule_version, spans)`` for the pairs that ``ledger`` lacks.

    ``versions`` is ``(blob, path, text)`` with any number of rows per blob. Which row's text is scanned is settled on
    digests and paths alone; texts move once, keyed by blob and path, so that a blob with very many paths is spread.
    """
    one = versions.groupBy("blob").agg(F.min("path").alias("path"))
    seen = ledger.where(F.col("rule_version") == version).select("blob")
    todo = one.join(seen, "blob", "left_anti").withColumnsRenamed({"blob": "_blob", "path": "_path"})
    chosen = (versions["blob"] == todo["_blob"]) & versions["path"].eqNullSafe(todo["_path"])
    scanned = with_spans(versions.join(todo, chosen, "left_semi"), "text", "spans", rules)
    return scanned.select("blob", F.lit(version).alias("rule_version"), "spans").dropDuplicates(["blob"])


def find_secrets(
    df: DataFrame,
    path_col: str = "doc_id",
    text_col: str = "text",
    ledger_path: str | None = None,
    rules: list[Rule] = RULES,
    version: str = VERSION,
) -> DataFrame:
    """``(path, blob, spans)`` of every row of ``df``.

    The ledger at ``ledger_path`` is used and extended (appended to, never rewritten), so that a later run over a
    grown table scans only what is new. Without a path a fresh one is made in the shared folder.
    """
    spark = df.sparkSession
    at = ledger_path or scratch_path(spark, "ledger")
    text = whole_text(named(df, text_col))
    versions = df.select(F.sha2(text.cast("binary"), 256).alias("blob"), named(df, path_col).alias("path"), text.alias("text"))
    schema = f"blob string, rule_version string, spans {SPANS}"
    spark.createDataFrame([], schema).write.mode("append").parquet(at)  # so that a new ledger can be read
    scan_unseen(versions, spark.read.schema(schema).parquet(at), rules, version).write.mode("append").parquet(at)
    # Two runs at once may both have scanned a blob.
    ledger = spark.read.schema(schema).parquet(at).where(F.col("rule_version") == version).select("blob", "spans").dropDuplicates(["blob"])
    found = versions.select("blob", "path").join(ledger, "blob", "left")
    return found.select(F.col("path").alias(path_col), "blob", "spans")
