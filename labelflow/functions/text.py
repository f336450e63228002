"""Text expressions with Python's Unicode rules, built only from JVM-side functions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Derived from the rule "str.isspace()", not typed in.
WHITESPACE = "".join(c for c in map(chr, range(0x10000)) if c.isspace())


@lru_cache(maxsize=1)
def _decimals() -> tuple[str, str]:
    """All Unicode decimal digits beyond ASCII, and the ASCII digit each stands for."""
    found = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(found), "".join(str(unicodedata.decimal(c)) for c in found)


LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
SPACE_CLASS = r"[\s\x1c-\x1f]"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c: Column | str) -> Column:
    """Strip every Unicode white-space character; Spark's one-argument trim strips only U+0020."""
    return F.trim(as_column(c), F.lit(WHITESPACE))


def is_blank(c: Column | str) -> Column:
    c = as_column(c)
    return c.isNull() | (ustrip(c) == "")


def non_empty(c: Column | str) -> Column:
    """``c`` where it is neither null nor the empty string, else null."""
    return F.nullif(as_column(c), F.lit(""))


def split_lines(c: Column | str) -> Column:
    return F.split(as_column(c), LINE_BREAK)


def ascii_digits(c: Column | str) -> Column:
    """Map every Unicode decimal digit to 0-9, so that a cast can read it."""
    return F.translate(as_column(c), *_decimals())


def preview(c: Column | str, n: int) -> Column:
    """The first ``n`` characters, with an ellipsis only when something was cut."""
    c = as_column(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def timestamp_text(c: Column | str) -> Column:
    """ISO date and time to the second (the first 19 characters of an ISO timestamp)."""
    return F.date_format(as_column(c), "yyyy-MM-dd'T'HH:mm:ss")


def cap_words(c: Column | str, n: int) -> Column:
    """The first ``n`` space-separated tokens."""
    return F.array_join(F.slice(F.split(as_column(c), " "), 1, n), " ")


def cap_chars(c: Column | str, n: int) -> Column:
    return F.substring(as_column(c), 1, n)


def parse_level(c: Column | str) -> Column:
    """Level number of a display choice such as ``4-name``."""
    return F.split(as_column(c), "-")[0].cast("int")


def file_stem(c: Column | str) -> Column:
    """File name without folder and last extension."""
    return F.regexp_extract(as_column(c), r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
