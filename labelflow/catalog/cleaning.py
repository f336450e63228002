"""Checked queries: text functions, label cleaning, reply parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import replies as R
from ..functions import text as X
from ..operators import labels as L
from ..operators.metrics import class_counts
from ..operators.folds import check_foldable
from ..operators.tasks import assign_ids, default_ids
from ..sources import views as V
from .registry import query, quoted, text_md5, with_views

WS = quoted(X.WHITESPACE)
# Python's line breaks and white space in the SQL engine's regular expressions.
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
ALIASES = ", ".join(f"({quoted(s)}, {n})" for n, names in L.LABEL_SPELLINGS.items() for s in names)


@query(
    "k_text_functions",
    f"""SELECT doc_id, md5(trim(text, {WS})) AS stripped_md5,
 CAST(length(trim(text, {WS})) AS BIGINT) AS stripped_chars,
 CAST(len(regexp_split_to_array(text, '{BREAK}')) AS BIGINT) AS n_lines,
 CASE WHEN length(text) > 30 THEN substr(text, 1, 30) || '...' ELSE text END AS shown,
 md5(array_to_string(list_slice(string_split(text, ' '), 1, 512), ' ')) AS capped_md5
 FROM documents""",
)
def k_text_functions(spark, folder):
    docs = V.table(spark, folder, "documents")
    return docs.select(
        "doc_id",
        text_md5(X.ustrip("text")).alias("stripped_md5"),
        F.length(X.ustrip("text")).cast("long").alias("stripped_chars"),
        F.size(X.split_lines("text")).cast("long").alias("n_lines"),
        X.preview("text", 30).alias("shown"),
        text_md5(X.cap_words("text", 512)).alias("capped_md5"),
    )


@query(
    "b1_resolve_text",
    with_views(
        f"""SELECT conv_id, turn, md5(CASE
 WHEN turn % 3 = 0 AND output <> '' THEN output
 WHEN trim(coalesce(instruction, ''), {WS}) <> '' AND trim(coalesce(input, ''), {WS}) <> ''
  THEN trim(instruction, {WS}) || chr(10) || chr(10) || trim(input, {WS})
 WHEN trim(coalesce(instruction, ''), {WS}) <> '' THEN trim(instruction, {WS})
 ELSE trim(coalesce(input, ''), {WS}) END) AS resolved_md5 FROM instructions""",
        "instructions",
    ),
)
def b1_resolve_text(spark, folder):
    rows = V.instructions(spark, folder)
    # Every third turn brings its text in the column that is looked at first.
    rows = rows.withColumn("sentence", F.when(F.col("turn") % 3 == 0, F.col("output")))
    resolved = L.resolve_text(rows)
    return resolved.select("conv_id", "turn", text_md5("resolved_text").alias("resolved_md5"))


@query(
    "b2_resolve_label",
    with_views(
        """SELECT id, CASE WHEN gold = 1 THEN NULL WHEN gold = 2 THEN CAST(pred AS VARCHAR)
 WHEN gold = 3 THEN prompt_type ELSE model END AS raw_label FROM predicted""",
        "predicted",
    ),
)
def b2_resolve_label(spark, folder):
    rows = V.predicted(spark, folder).select(
        "id",
        F.when(F.col("gold") == 4, F.col("model")).otherwise("").alias("label"),
        F.when(F.col("gold") == 2, F.col("pred")).alias("score"),
        F.when(F.col("gold") == 3, F.col("prompt_type")).alias(" Output "),
    )
    return L.resolve_label(rows).select("id", "raw_label")


@query(
    "b3_normalize_label",
    f"""WITH alias(spelling, label_id) AS (VALUES {ALIASES})
, raw AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4
   WHEN 0 THEN ' ' || (1 + l_partkey % 5) || ' ' WHEN 1 THEN '酸' WHEN 2 THEN 'neutral' ELSE l_returnflag END AS spelling,
   l_partkey % 6 AS whole, l_quantity / 2 AS half FROM lineitem)
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, l_linenumber, l_partkey, a.label_id AS from_text,
 CASE WHEN whole BETWEEN 1 AND 4 THEN CAST(whole - 1 AS INTEGER) WHEN whole = 0 THEN 0 END AS from_integer,
 CASE WHEN half <> floor(half) THEN NULL WHEN half BETWEEN 1 AND 4 THEN CAST(half - 1 AS INTEGER) WHEN half = 0 THEN 0 END AS from_number
FROM raw LEFT JOIN alias a ON a.spelling = trim(raw.spelling)""",
)
def b3_normalize_label(spark, folder):
    part = F.col("l_linenumber") % 4
    raw = V.table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.when(part == 0, F.concat(F.lit(" "), (1 + F.col("l_partkey") % 5).cast("string"), F.lit(" ")))
        .when(part == 1, "酸")
        .when(part == 2, "neutral")
        .otherwise(F.col("l_returnflag"))
        .alias("spelling"),
        (F.col("l_partkey") % 6).alias("whole"),
        (F.col("l_quantity") / 2).alias("half"),
    )
    out = L.normalize_label(raw, "spelling", "from_text")
    out = L.normalize_label(out, "whole", "from_integer")
    out = L.normalize_label(out, "half", "from_number")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "from_text", "from_integer", "from_number")


def _records(spark, folder):
    """Records with gaps: blank texts, absent labels, labels out of range."""
    part = F.col("id") % 10
    return V.labeled(spark, folder).select(
        "id",
        F.when(part != 3, F.col("text")).otherwise("").alias("text"),
        F.when(part == 5, None).when(part == 7, 9).otherwise(F.col("score")).alias("label"),
    )


@query(
    "b4_sanitize",
    with_views(
        """, raw AS (SELECT id, CASE WHEN id % 10 <> 3 THEN text ELSE '' END AS text,
  CASE id % 10 WHEN 5 THEN NULL WHEN 7 THEN 9 ELSE score END AS label FROM labeled)
, marked AS (SELECT *, CASE WHEN text = '' THEN 'no sentence, text, input or instruction'
  WHEN label IS NULL THEN 'missing label key/value' WHEN label NOT BETWEEN 0 AND 4 THEN 'unsupported label value' END AS reason FROM raw)
SELECT id, coalesce(reason, 'ok') AS outcome, CASE WHEN reason IS NULL THEN md5(text) END AS text_md5,
 CASE WHEN reason IS NULL THEN CAST(label - 1 AS INTEGER) END AS label FROM marked""",
        "labeled",
    ),
)
def b4_sanitize(spark, folder):
    parts = L.sanitize(_records(spark, folder), keep=("id",))
    clean = parts.clean.select("id", F.lit("ok").alias("outcome"), text_md5("text").alias("text_md5"), "label")
    rejects = parts.rejects.select(
        "id", F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("text_md5"),
        F.lit(None).cast("int").alias("label"),
    )
    return clean.unionByName(rejects)


@query(
    "b5_require_columns",
    with_views("SELECT CAST(count(*) AS BIGINT) AS n_rows, 'instruction,input,output' AS columns FROM instructions", "instructions"),
)
def b5_require_columns(spark, folder):
    wanted = ["instruction", "input", "output"]
    rows = L.require_columns(V.instructions(spark, folder), wanted, "instructions")
    return rows.agg(F.count("*").alias("n_rows")).withColumn("columns", F.lit(",".join(wanted)))


@query(
    "b6_drop_blank",
    with_views(
        f""", cut AS (SELECT id, CASE WHEN id % 7 = 0 THEN chr(12288) || ' ' || chr(9) ELSE text END AS text FROM labeled)
SELECT id, md5(text) AS text_md5 FROM cut WHERE trim(text, {WS}) <> ''""",
        "labeled",
    ),
)
def b6_drop_blank(spark, folder):
    rows = V.labeled(spark, folder).withColumn(
        "text", F.when(F.col("id") % 7 == 0, "　 \t").otherwise(F.col("text"))
    )
    return L.drop_blank(rows).select("id", text_md5("text").alias("text_md5"))


@query(
    "b7_to_scoring_input",
    with_views("SELECT id, target, md5(text) AS output_md5, target AS score, md5(text) AS text_md5 FROM tasks", "tasks"),
)
def b7_to_scoring_input(spark, folder):
    results = V.tasks(spark, folder).select(
        "id", F.col("text").alias("generated_text"), F.col("target").alias("target_level")
    )
    return L.to_scoring_input(results).select(
        "id", "target", text_md5("output").alias("output_md5"), "score", text_md5("text").alias("text_md5")
    )


@query(
    "b8_valid_predictions",
    with_views("SELECT id, gold, pred - 2 AS predicted_score FROM predicted WHERE pred - 2 > 0", "predicted"),
)
def b8_valid_predictions(spark, folder):
    rows = V.predicted(spark, folder).select("id", "gold", (F.col("pred") - 2).alias("predicted_score"))
    return L.valid_predictions(rows)


@query(
    "b8_valid_counts",
    with_views(
        "SELECT CAST(count(*) FILTER (WHERE pred > 2) AS BIGINT) AS valid, CAST(count(*) AS BIGINT) AS total FROM predicted",
        "predicted",
    ),
)
def b8_valid_counts(spark, folder):
    rows = V.predicted(spark, folder).select((F.col("pred") - 2).alias("predicted_score"))
    return L.valid_counts(rows)


@query("b9_mark_correct", with_views("SELECT id, gold, pred, pred = gold AS is_correct FROM predicted", "predicted"))
def b9_mark_correct(spark, folder):
    return L.mark_correct(V.predicted(spark, folder), "pred", "gold").select("id", "gold", "pred", "is_correct")


@query(
    "b10_parse_level",
    with_views("SELECT event_id, CAST(target AS INTEGER) AS level FROM activity", "activity"),
)
def b10_parse_level(spark, folder):
    names = F.array(*[F.lit(n) for n in L.CLASS_NAMES])
    rows = V.activity(spark, folder).withColumn("choice", F.get(names, F.col("target_level").cast("int") - 1))
    return rows.select("event_id", X.parse_level("choice").alias("level"))


@query(
    "b11_default_ids",
    "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'd' || doc_id END, "
    "CAST(row_number() OVER (ORDER BY doc_id) AS VARCHAR)) AS id FROM documents",
)
def b11_default_ids(spark, folder):
    own = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    return default_ids(V.table(spark, folder, "documents").select("doc_id", own.alias("id")), ["doc_id"])


@query(
    "b11_assign_ids",
    with_views(
        "SELECT id AS source_id, printf('S%03d', row_number() OVER (ORDER BY id)) AS id FROM predicted", "predicted"
    ),
)
def b11_assign_ids(spark, folder):
    rows = V.predicted(spark, folder).select(F.col("id").alias("source_id"))
    return assign_ids(rows, ["source_id"])


@query(
    "b12_label_view",
    with_views(
        "SELECT id, gold AS label_id, CASE gold "
        + " ".join(f"WHEN {i + 1} THEN {quoted(n)}" for i, n in enumerate(L.CLASS_NAMES))
        + " END AS label_name FROM predicted",
        "predicted",
    ),
)
def b12_label_view(spark, folder):
    rows = V.predicted(spark, folder).select("id", (F.col("gold") - 1).alias("label"))
    return L.label_view(rows).select("id", "label_id", "label_name")


@query(
    "b13_preview",
    """SELECT doc_id, CASE WHEN length(text) > 30 THEN substr(text, 1, 30) || '...' ELSE text END AS short,
 CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS longer FROM documents""",
)
def b13_preview(spark, folder):
    docs = V.table(spark, folder, "documents")
    return docs.select("doc_id", X.preview("text", 30).alias("short"), X.preview("text", 50).alias("longer"))


@query("b14_with_mode", with_views("SELECT id, model || '_' || prompt_type AS model_mode FROM predicted", "predicted"))
def b14_with_mode(spark, folder):
    return L.with_mode(V.predicted(spark, folder)).select("id", "model_mode")


@query(
    "b15_cap_tokens",
    """SELECT doc_id, md5(array_to_string(list_slice(string_split(text, ' '), 1, 512), ' ')) AS words_md5,
 md5(substr(text, 1, 1000)) AS chars_md5 FROM documents""",
)
def b15_cap_tokens(spark, folder):
    docs = V.table(spark, folder, "documents")
    return docs.select(
        "doc_id",
        text_md5(X.cap_words("text", 512)).alias("words_md5"),
        text_md5(X.cap_chars("text", 1000)).alias("chars_md5"),
    )


@query(
    "b16_check_foldable",
    with_views(
        """, grid(label) AS (VALUES (0), (1), (2), (3), (4))
SELECT g.label, CAST(count(p.id) AS BIGINT) AS n FROM grid g LEFT JOIN predicted p ON p.gold = g.label + 1 GROUP BY g.label""",
        "predicted",
    ),
)
def b16_check_foldable(spark, folder):
    rows = V.predicted(spark, folder).select((F.col("gold") - 1).alias("label"))
    check_foldable(rows, "label", 5)
    return class_counts(rows, "label", (0, 1, 2, 3, 4))


_MARKED = """CASE WHEN reply IS NULL OR trim(reply, {ws}) = '' THEN {blank}
 WHEN regexp_extract(reply, '【最終分數：([1-4])】', 1) <> '' THEN {marked}
 WHEN regexp_extract(reply, '[1-4]') <> '' THEN {digit} ELSE {none} END"""
_SCORE = _MARKED.format(
    ws=WS, blank="-3", marked="CAST(regexp_extract(reply, '【最終分數：([1-4])】', 1) AS INTEGER)",
    digit="CAST(regexp_extract(reply, '[1-4]') AS INTEGER)", none="-1",
)
_PATH = _MARKED.format(ws=WS, blank="'exhausted'", marked="'marked'", digit="'fallback'", none="'failed'")
BOTH_REPLIES = ", both_replies AS (SELECT 'stand-in' AS source, id, reply FROM replies UNION ALL SELECT 'raw', id, reply FROM raw_replies)"


def _both_replies(spark, folder):
    """Marked replies and free texts in one table."""
    marked = V.replies(spark, folder).select(F.lit("stand-in").alias("source"), "id", "reply")
    return marked.unionByName(V.raw_replies(spark, folder).select(F.lit("raw").alias("source"), "id", "reply"))


@query(
    "g1_parse_marked",
    with_views(
        f"{BOTH_REPLIES} SELECT source, id, {_SCORE} AS predicted_score, {_PATH} AS parse_path FROM both_replies",
        "replies", "raw_replies",
    ),
)
def g1_parse_marked(spark, folder):
    return R.parse_marked(_both_replies(spark, folder)).select("source", "id", "predicted_score", "parse_path")


@query(
    "g2_parse_integer",
    with_views(
        f"""{BOTH_REPLIES}, s AS (SELECT source, id, reply, trim(reply, {WS}) AS t FROM both_replies)
SELECT source, id, CASE WHEN reply IS NULL THEN -2 ELSE coalesce(
 TRY_CAST(nullif(replace(regexp_extract(t, '^[+-]?[0-9]+(?:_[0-9]+)*$'), '_', ''), '') AS BIGINT),
 TRY_CAST(nullif(regexp_extract(t, '[0-9]+'), '') AS BIGINT), -1) END AS predicted_score FROM s""",
        "replies", "raw_replies",
    ),
)
def g2_parse_integer(spark, folder):
    return R.parse_integer(_both_replies(spark, folder)).select("source", "id", "predicted_score")


@query(
    "g3_parse_first_digit",
    with_views(
        f"{BOTH_REPLIES} SELECT source, id, coalesce(nullif(regexp_extract(reply, '[1-4]'), ''), '解析失敗') AS model_score FROM both_replies",
        "replies", "raw_replies",
    ),
)
def g3_parse_first_digit(spark, folder):
    return R.parse_first_digit(_both_replies(spark, folder)).select("source", "id", "model_score")


_ASCII = rf"(?:[A-Za-z0-9.,!?;:''\"()\-]|{SPACE})+"


@query(
    "g4_clean_rewrite",
    f"""WITH r AS (SELECT doc_id AS id, CASE doc_id % 3
  WHEN 0 THEN '好的。改寫為第 2 級：' || text WHEN 1 THEN text || chr(10) || '這個改寫保留了語意' ELSE text END AS reply FROM documents)
, t AS (SELECT id, trim(reply, {WS}) AS s FROM r)
, m AS (SELECT id, coalesce(nullif(regexp_extract(s, '改寫為第{SPACE}*\\p{{Nd}}+{SPACE}*級[:：]{SPACE}*([^\\n]+)', 1), ''), s) AS s FROM t)
, l AS (SELECT id, list_filter(list_transform(regexp_split_to_array(s, '{BREAK}'), lambda x: trim(x, {WS})), lambda x: x <> '') AS a FROM m)
, p AS (SELECT id, a, CASE WHEN len(a) > 1 AND regexp_matches(a[len(a)], '保留|這個改寫|原句') THEN a[1] ELSE a[len(a)] END AS c FROM l)
SELECT id, md5(coalesce(CASE WHEN regexp_full_match(c, '{_ASCII}')
  THEN coalesce(list_filter(a, lambda x: NOT regexp_full_match(x, '{_ASCII}'))[1], c) ELSE c END, '')) AS cleaned_md5 FROM p""",
)
def g4_clean_rewrite(spark, folder):
    part = F.col("id") % 3
    rows = V.raw_replies(spark, folder).withColumn(
        "reply",
        F.when(part == 0, F.concat(F.lit("好的。改寫為第 2 級："), "reply"))
        .when(part == 1, F.concat("reply", F.lit("\n這個改寫保留了語意")))
        .otherwise(F.col("reply")),
    )
    return R.clean_rewrite(rows).select("id", text_md5("generated_text").alias("cleaned_md5"))


@query(
    "g5_first_line",
    with_views(
        f"SELECT id, md5(coalesce(nullif(split_part(trim(reply, {WS}), chr(10), 1), ''), 'Error')) AS first_md5 FROM raw_replies",
        "raw_replies",
    ),
)
def g5_first_line(spark, folder):
    return V.raw_replies(spark, folder).select("id", text_md5(R.first_line("reply")).alias("first_md5"))


@query(
    "g6_parse_summary",
    with_views(
        f"""{BOTH_REPLIES}, p AS (SELECT source, {_PATH} AS parse_path FROM both_replies)
SELECT source, {", ".join(f"CAST(count(*) FILTER (WHERE parse_path = '{n}') AS BIGINT) AS {n}" for n in ("marked", "fallback", "failed", "exhausted"))},
 CAST(count(*) FILTER (WHERE parse_path IN ('marked', 'fallback')) AS BIGINT) AS valid, CAST(count(*) AS BIGINT) AS total
FROM p GROUP BY source""",
        "replies", "raw_replies",
    ),
)
def g6_parse_summary(spark, folder):
    return R.parse_summary(R.parse_marked(_both_replies(spark, folder)), ["source"])
