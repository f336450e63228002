"""Reply parsers. Three of them disagree on purpose: on "10" they give 1, 10 and "1"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE_CLASS, as_column, ascii_digits, is_blank, non_empty, split_lines, ustrip

# Markers and sentinels that other tools of the same data flow write or expect.
SCORE_MARK = "【最終分數：([1-4])】"
REWRITE_MARK = rf"改寫為第{SPACE_CLASS}*\p{{Nd}}+{SPACE_CLASS}*級[:：]{SPACE_CLASS}*([^\n]+)"
UNPARSED_LABEL = "解析失敗"
COMMENT_PHRASES = ("保留", "這個改寫", "原句")
UNPARSED, NULL_REPLY, EXHAUSTED = -1, -2, -3

# One character class, not an alternation: the latter recurses per character and fails on long lines.
# Fixed value: what counts as a line without a sentence in it.
ASCII_LINE = r"(?U)^[A-Za-z0-9.,!?;:'\"()\-\s\x1c-\x1f]+$"
WHOLE_INTEGER = r"^[+-]?\p{Nd}+(?:_\p{Nd}+)*$"


def parse_marked(df: DataFrame, reply: str = "reply", mark: str = SCORE_MARK) -> DataFrame:
    """Marked score, else the first digit 1-4 anywhere, else -1; a blank reply is -3."""
    r = F.col(reply)
    marked = non_empty(F.regexp_extract(r, mark, 1))
    digit = non_empty(F.regexp_extract(r, "[1-4]", 0))
    path = (
        F.when(is_blank(r), "exhausted")
        .when(marked.isNotNull(), "marked")
        .when(digit.isNotNull(), "fallback")
        .otherwise("failed")
    )
    score = (
        F.when(is_blank(r), F.lit(EXHAUSTED))
        .otherwise(F.coalesce(marked.try_cast("int"), digit.try_cast("int"), F.lit(UNPARSED)))
    )
    return df.withColumns({"predicted_score": score, "parse_path": path})


def parse_integer(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Whole reply as an integer, else its first digit run, else -1; null is -2. No range check."""
    s = ustrip(reply)
    whole = F.replace(F.regexp_extract(s, WHOLE_INTEGER, 0), F.lit("_"), F.lit(""))
    run = F.regexp_extract(s, r"\p{Nd}+", 0)
    score = F.when(F.col(reply).isNull(), F.lit(NULL_REPLY).cast("long")).otherwise(
        F.coalesce(
            ascii_digits(non_empty(whole)).try_cast("long"),
            ascii_digits(non_empty(run)).try_cast("long"),
            F.lit(UNPARSED).cast("long"),
        )
    )
    return df.withColumn("predicted_score", score)


def parse_first_digit(df: DataFrame, reply: str = "reply", unparsed: str = UNPARSED_LABEL) -> DataFrame:
    """First digit 1-4 as a string, or the unparsed label."""
    digit = non_empty(F.regexp_extract(F.col(reply), "[1-4]", 0))
    return df.withColumn("model_score", F.coalesce(digit, F.lit(unparsed)))


def clean_rewrite(
    df: DataFrame,
    reply: str = "reply",
    out: str = "generated_text",
    mark: str = REWRITE_MARK,
    phrases: tuple[str, ...] = COMMENT_PHRASES,
) -> DataFrame:
    """Pick the rewritten sentence out of a wordy reply.

    Text after the rewrite mark wins. Of its non-blank lines the last one is taken, unless it reads
    like a comment; a line of ASCII only gives way to the first line that is not.
    """
    taken = non_empty(F.regexp_extract(ustrip(reply), mark, 1))
    lines = F.filter(
        F.transform(split_lines(F.coalesce(taken, ustrip(reply), F.lit(""))), ustrip), lambda x: x != ""
    )
    last = F.try_element_at(F.col("_lines"), F.lit(-1))
    comment = last.rlike("|".join(phrases)) & (F.size("_lines") > 1)
    picked = F.when(comment, F.get(F.col("_lines"), F.lit(0))).otherwise(last)
    other = F.get(F.filter(F.col("_lines"), lambda x: ~x.rlike(ASCII_LINE)), F.lit(0))
    final = F.when(F.col("_picked").rlike(ASCII_LINE), F.coalesce(other, F.col("_picked")))
    # Separate projections keep the line array from being computed once per use.
    return (
        df.withColumn("_lines", lines)
        .withColumn("_picked", picked)
        .withColumn(out, F.coalesce(final.otherwise(F.col("_picked")), F.lit("")))
        .drop("_lines", "_picked")
    )


def first_line(c: Column | str, empty: str = "Error") -> Column:
    """First line of the stripped reply, or ``empty``."""
    return F.coalesce(non_empty(F.substring_index(ustrip(as_column(c)), "\n", 1)), F.lit(empty))


def parse_summary(df: DataFrame, by: list[str] | None = None, path: str = "parse_path") -> DataFrame:
    """Rows per parse outcome, with the valid and total counts of the group."""
    counts = {
        name: F.count_if(F.col(path) == name).alias(name)
        for name in ("marked", "fallback", "failed", "exhausted")
    }
    valid = F.count_if(F.col(path).isin("marked", "fallback")).alias("valid")
    return df.groupBy(*(by or [])).agg(*counts.values(), valid, F.count("*").alias("total"))
