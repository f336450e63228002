"""Resolve, normalise and validate the text and label of records with varying column names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_blank, non_empty, ustrip

# Class names, and the spellings of each class that input files use.
CLASS_NAMES = ("1-溫和", "2-中性", "3-不滿", "4-酸")
LABEL_SPELLINGS = {
    0: ("1", "1-溫和", "溫和", "mild", "soft"),
    1: ("2", "2-中性", "中性", "neutral"),
    2: ("3", "3-不滿", "不滿", "dissatisfied", "negative"),
    3: ("4", "4-酸", "酸", "sarcastic", "snarky"),
}
LABEL_COLUMNS = ("label", "labels", "score", "output")
NO_TEXT = "no sentence, text, input or instruction"
NO_LABEL = "missing label key/value"
BAD_LABEL = "unsupported label value"


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def require_columns(df: DataFrame, columns: list[str], name: str = "table") -> DataFrame:
    """Return ``df`` unchanged, or raise with the missing columns in ascending order."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"columns absent from {name}: {', '.join(missing)}")
    return df


def first_present(df: DataFrame, candidates: list[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def resolved_text(df: DataFrame) -> Column:
    """``sentence``, then ``text``, then ``instruction`` and ``input`` joined; null when none applies.

    The choice follows which columns exist. Where both ``instruction`` and ``input`` exist the result may
    be the empty string, which counts as text.
    """
    picks = [non_empty(_col(c).cast("string")) for c in ("sentence", "text") if c in df.columns]
    if {"instruction", "input"} <= set(df.columns):
        parts = [F.coalesce(ustrip(_col(c).cast("string")), F.lit("")) for c in ("instruction", "input")]
        picks.append(F.concat_ws("\n\n", *[non_empty(p) for p in parts]))
    elif "input" in df.columns:
        picks.append(non_empty(_col("input").cast("string")))
    return F.coalesce(*picks) if picks else F.lit(None).cast("string")


def resolve_text(df: DataFrame, out: str = "resolved_text") -> DataFrame:
    return df.withColumn(out, resolved_text(df))


def label_candidates(df: DataFrame) -> list[str]:
    """Columns to look for a label in, best first: exact names, then names equal after folding."""
    exact = [c for c in LABEL_COLUMNS if c in df.columns]
    folded = {c.lower().strip(): c for c in df.columns}
    return exact + [folded[c] for c in LABEL_COLUMNS if c in folded and folded[c] not in exact]


def _has_value(df: DataFrame, name: str) -> Column:
    kind, c = df.schema[name].dataType, _col(name)
    if isinstance(kind, T.StringType):
        return c.isNotNull() & (c != "")
    if isinstance(kind, T.VariantType):
        text = F.try_variant_get(c, "$", "string")
        return c.isNotNull() & ~F.is_variant_null(c) & (F.coalesce(text, F.lit("x")) != "")
    return c.isNotNull()


def resolve_label(df: DataFrame, out: str = "raw_label") -> DataFrame:
    """First present label value, as text."""
    picks = [F.when(_has_value(df, c), _as_text(df, c)) for c in label_candidates(df)]
    return df.withColumn(out, F.coalesce(*picks) if picks else F.lit(None).cast("string"))


def _as_text(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.VariantType):
        return F.try_variant_get(_col(name), "$", "string")
    return _col(name).cast("string")


def _from_integer(n: Column, base: int) -> Column:
    if base == 0:
        return F.when(n.between(0, 3), n.cast("int"))
    # 1..4 is tried first, so 0 and 1 both give class 0.
    return F.when(n.between(1, 4), (n - 1).cast("int")).when(n == 0, F.lit(0))


def _from_number(x: Column, base: int) -> Column:
    return F.when(x == F.floor(x), _from_integer(x.cast("double"), base))


def _from_text(s: Column) -> Column:
    key = ustrip(s)
    chain = F.when(key.isin(*LABEL_SPELLINGS[0]), F.lit(0))
    for label in (1, 2, 3):
        chain = chain.when(key.isin(*LABEL_SPELLINGS[label]), F.lit(label))
    return chain


def normalized_label(c: Column, kind: T.DataType, base: int = 1) -> Column:
    """Class id 0..3 of a label column of the given type, or null when it is not a label.

    Numbers and strings differ: 2.0 is class 1 but "2.0" is none, and 0 is class 0 but "0" is none.
    """
    if isinstance(kind, T.BooleanType):
        return _from_integer(c.cast("int"), base)
    if isinstance(kind, T.IntegralType):
        return _from_integer(c, base)
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return _from_number(c, base)
    if isinstance(kind, T.StringType):
        return _from_text(c)
    if isinstance(kind, T.VariantType):
        is_text = F.schema_of_variant(c) == "STRING"
        is_flag = F.schema_of_variant(c) == "BOOLEAN"
        return (
            F.when(is_text, _from_text(F.try_variant_get(c, "$", "string")))
            .when(is_flag, _from_integer(F.try_variant_get(c, "$", "boolean").cast("int"), base))
            .otherwise(_from_number(F.try_variant_get(c, "$", "double"), base))
        )
    return F.lit(None).cast("int")


def normalize_label(df: DataFrame, col: str, out: str = "label_id", base: int = 1) -> DataFrame:
    return df.withColumn(out, normalized_label(_col(col), df.schema[col].dataType, base))


@dataclass
class Sanitized:
    """Usable rows and rejected rows of one table, and the reason (or null) of every row."""

    clean: DataFrame
    rejects: DataFrame
    reasons: DataFrame

    def report(self, samples: int = 3) -> dict:
        """Number of rejects and a few of them; raises when no usable row is left.

        One pass counts both parts; samples end with the first rejects that are found.
        """
        counts = self.reasons.agg(F.count("*").alias("rows"), F.count("reason").alias("dropped")).first()
        if counts["rows"] == counts["dropped"]:
            raise ValueError("preprocessing left no rows")
        return {"dropped": counts["dropped"], "samples": self.rejects.limit(samples).collect() if counts["dropped"] else []}


def sanitize(df: DataFrame, base: int = 1, on_error: str = "drop", keep: tuple[str, ...] = ()) -> Sanitized:
    """Split into ``(text, label)`` rows and rejects with a reason, in one projection.

    ``keep`` names columns, such as a row id, that both parts carry along. With ``on_error="fail"`` a bad
    row stops the job instead.
    """
    names = label_candidates(df)
    value = F.lit(None).cast("int")
    present = F.lit(False)
    for name in reversed(names):
        has = _has_value(df, name)
        value = F.when(has, normalized_label(_col(name), df.schema[name].dataType, base)).otherwise(value)
        present = present | has
    text = resolved_text(df)
    reason = (
        F.when(text.isNull(), NO_TEXT).when(~present, NO_LABEL).when(value.isNull(), BAD_LABEL)
    )
    marked = df.withColumn("_text", text).withColumn("_label", value).withColumn("_reason", reason)
    if on_error == "fail":
        marked = marked.withColumn(
            "_reason", F.when(F.col("_reason").isNotNull(), F.raise_error(F.col("_reason")).cast("string"))
        )
    clean = marked.where(F.col("_reason").isNull()).select(
        *keep, F.col("_text").alias("text"), F.col("_label").alias("label")
    )
    record = F.struct(*[_col(c) for c in df.columns])
    rejects = marked.where(F.col("_reason").isNotNull()).select(
        *keep, F.col("_reason").alias("reason"), record.alias("record")
    )
    return Sanitized(clean, rejects, marked.select(F.col("_reason").alias("reason")))


def drop_blank(df: DataFrame, col: str = "text") -> DataFrame:
    return df.where(~is_blank(_col(col)))


def label_view(df: DataFrame, col: str = "label", names: tuple[str, ...] = CLASS_NAMES) -> DataFrame:
    """Add the external id (1..n) and the class name of an internal id (0..n-1)."""
    listed = F.array(*[F.lit(n) for n in names])
    return df.withColumns({"label_id": F.col(col) + 1, "label_name": F.get(listed, F.col(col))})


def to_scoring_input(df: DataFrame) -> DataFrame:
    """Map generated-result columns onto the columns that scoring reads."""
    if "generated_text" in df.columns:
        df = df.withColumn("output", F.col("generated_text"))
    if "target_level" in df.columns:
        df = df.withColumn("target", F.col("target_level"))
    require_columns(df, ["output", "target"], "scoring input")
    return df.withColumns({"score": F.col("target").cast("int"), "text": F.col("output")})


def valid_predictions(df: DataFrame, col: str = "predicted_score") -> DataFrame:
    return df.where(F.col(col) > 0)


def valid_counts(df: DataFrame, col: str = "predicted_score") -> DataFrame:
    """Valid and total rows; a null prediction is not valid."""
    return df.agg(F.count_if(F.col(col) > 0).alias("valid"), F.count("*").alias("total"))


def mark_correct(df: DataFrame, pred: str, target: str, out: str = "is_correct") -> DataFrame:
    return df.withColumn(out, F.coalesce(F.col(pred) == F.col(target), F.lit(False)))


def with_mode(df: DataFrame, model: str = "model", prompt_type: str = "prompt_type") -> DataFrame:
    return df.withColumn("model_mode", F.concat_ws("_", model, prompt_type))
