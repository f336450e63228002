"""Checked queries: task expansion, joins, prompts, inference, whole plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.replies import parse_first_digit
from ..operators import prompts as E
from ..operators import tasks as T
from ..operators.inference import (
    EchoModel,
    FlakyModel,
    HashModel,
    ModelRegistry,
    ModelSpec,
    NO_WAIT,
    NullModel,
    generate,
    predict_class,
    score_table,
)
from ..operators.joins import complement
from ..operators.ledger import generate_once
from ..operators.metrics import accuracy_by
from ..operators.labels import with_mode
from ..operators.sampling import first_n_per_class
from ..plans.convert import convert_and_score, paraphrase
from ..plans.experiment import experiment
from ..plans.scoring import scoring_run
from ..session import cut_lineage, scratch_path
from ..sources.files import read_scoring_csv
from ..sources import views as V
from .registry import query, quoted, seeded_rank_sql, six, text_md5, with_views

HASH, ECHO = ModelSpec(HashModel), ModelSpec(EchoModel)


def _digit(text: str) -> str:
    """The hash model's score of a text, in SQL."""
    return f"CAST(1 + (instr('0123456789abcdef', substr(md5({text}), 1, 1)) - 1) % 4 AS INTEGER)"


def _case(column: str, names: dict[int, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN {quoted(v)}" for k, v in names.items()) + f" ELSE {default} END"


def _filled(template: str, *values: str) -> str:
    """A format template as a SQL concatenation."""
    parts = template.replace("%d", "%s").split("%s")
    out = [quoted(parts[0])]
    for value, text in zip(values, parts[1:], strict=True):
        out += [value, quoted(text)]
    return "concat(" + ", ".join(out) + ")"


@query("c1_expand_targets", with_views("SELECT id, score, target FROM tasks", "tasks"))
def c1_expand_targets(spark, folder):
    return V.tasks(spark, folder).select("id", "score", "target")


@query(
    "c1_expand_targets_large",
    with_views(
        "SELECT id, gold, v.target FROM predicted JOIN (VALUES (1), (2), (3), (4)) v(target) ON v.target <> gold", "predicted"
    ),
)
def c1_expand_targets_large(spark, folder):
    return T.expand_targets(V.predicted(spark, folder).select("id", "gold"), score="gold")


MODELS, KINDS = ["alpha", "beta", "gamma"], {"Basic": False, "Data": True}


@query(
    "c2_experiment_grid",
    with_views(
        """SELECT id, target, m.model, p.prompt_type, p.prompt_type = 'Data' AS use_data FROM tasks
CROSS JOIN (VALUES ('alpha'), ('beta'), ('gamma')) m(model) CROSS JOIN (VALUES ('Basic'), ('Data')) p(prompt_type)""",
        "tasks",
    ),
)
def c2_experiment_grid(spark, folder):
    grid = T.experiment_grid(V.tasks(spark, folder), MODELS, KINDS)
    return grid.select("id", "target", "model", "prompt_type", "use_data")


# Three examples of the lower levels; level 4 has none and takes the placeholder.
_EXAMPLES = """, top AS (SELECT * FROM (SELECT id, text, score, row_number() OVER (PARTITION BY score ORDER BY id) AS rn FROM labeled WHERE score < 4) WHERE rn <= 3)
, by_level AS (SELECT score AS level, count(*) AS k, string_agg('- ' || text || chr(10), '' ORDER BY id) AS body FROM top GROUP BY score)
, blocks AS (SELECT t.id, t.text, t.score, t.target, coalesce({count} || b.body, {none}) AS examples FROM tasks t LEFT JOIN by_level b ON b.level = t.target)
""".format(count=_filled(E.EXAMPLE_COUNT, "b.k"), none=quoted(E.NO_EXAMPLES))


def _few(spark, folder, n=3, levels=(1, 2, 3)):
    return first_n_per_class(V.labeled(spark, folder), "score", n, ["id"], levels)


def _with_examples(spark, folder):
    table = E.examples_by_level(_few(spark, folder), ["id"])
    return E.attach_examples(V.tasks(spark, folder), table)


@query(
    "c3_attach_examples",
    with_views(_EXAMPLES + "SELECT id, target, md5(examples) AS examples_md5 FROM blocks", "tasks"),
)
def c3_attach_examples(spark, folder):
    return _with_examples(spark, folder).select("id", "target", text_md5("examples").alias("examples_md5"))


@query(
    "c4_score_distinct",
    with_views(f"SELECT id, target, {_digit('text')} AS original_score FROM tasks", "tasks"),
)
def c4_score_distinct(spark, folder):
    scorer = lambda texts: texts.withColumn("predicted_score", V.stand_in_reply().substr(7, 1).cast("int"))
    out = T.score_distinct(V.tasks(spark, folder), "text", scorer, ["id", "target"])
    return out.select("id", "target", "original_score")


@query(
    "c4_score_distinct_hot",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, {_digit('l_returnflag')} AS original_score FROM lineitem",
)
def c4_score_distinct_hot(spark, folder):
    """Three texts share all rows, so every one of them is hot and is salted."""
    rows = V.table(spark, folder, "lineitem")
    scorer = lambda texts: texts.withColumn(
        "predicted_score", V.stand_in_reply("l_returnflag").substr(7, 1).cast("int")
    )
    unique = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    out = T.score_distinct(rows, "l_returnflag", scorer, unique)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "original_score")


@query(
    "c6_complement",
    with_views("SELECT id, gold, pred FROM predicted WHERE id NOT IN (SELECT id FROM predicted WHERE model = 'R')", "predicted"),
)
def c6_complement(spark, folder):
    rows = V.predicted(spark, folder)
    return complement(rows.select("id", "gold", "pred"), rows.where("model = 'R'"), "id")


@query(
    "c6_complement_of_split",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def c6_complement_of_split(spark, folder):
    test = V.table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'")
    orders = V.table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return complement(orders, test.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", ["o_orderkey"])


_LINES = "string_agg('「' || text || '」 → ' || score || chr(10), '' ORDER BY id)"
_PREFIX = quoted(E.SCALES[2].strip() + "\n\n" + E.HARD_NEGATIVES.strip() + "\n\n" + E.EXAMPLES_HEADER)


@query(
    "e1_scoring_prompt",
    with_views(
        _EXAMPLES
        + f""", pre AS (SELECT {_PREFIX} || {_LINES} AS prefix FROM top)
SELECT id, md5(prefix || {quoted(E.SCORING_SUFFIX[0])} || text || {quoted(E.SCORING_SUFFIX[1])}) AS prompt_md5 FROM labeled, pre""",
        "tasks",
    ),
)
def e1_scoring_prompt(spark, folder):
    prefix = E.scoring_prefix(_few(spark, folder), ["id"], 120, 2, hard_negatives=True)
    return E.scoring_prompt(V.labeled(spark, folder), prefix).select("id", text_md5("prompt").alias("prompt_md5"))


@query(
    "e1_scoring_prompt_paired",
    with_views(
        f""", pairs AS (SELECT conv_id, arg_min(text, turn) AS original, max(CASE WHEN turn = 1 THEN text END) AS t1, max(CASE WHEN turn = 2 THEN text END) AS t2,
 max(CASE WHEN turn = 3 THEN text END) AS t3 FROM conversations GROUP BY conv_id ORDER BY conv_id LIMIT 10)
, pre AS (SELECT {quoted(E.SCALES[1] + chr(10) * 2 + E.EXAMPLES_HEADER)} || string_agg('原句：' || original || chr(10) || '1: ' || coalesce(t1, '') || chr(10) || '2: ' || coalesce(t2, '') || chr(10)
 || '3: ' || coalesce(t3, '') || chr(10) || '4: ' || chr(10) || chr(10), '' ORDER BY conv_id) AS prefix FROM pairs)
SELECT id, md5(prefix || {quoted(E.SCORING_SUFFIX[0])} || text || {quoted(E.SCORING_SUFFIX[1])}) AS prompt_md5 FROM labeled, pre""",
        "labeled",
    ),
)
def e1_scoring_prompt_paired(spark, folder):
    turns = V.table(spark, folder, "conversations")
    level = F.map_from_entries(F.collect_list(F.when(F.col("turn").between(1, 3), F.struct(F.col("turn").cast("int"), "text"))))
    pairs = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("original"), level.alias("by_level"))
    prefix = E.scoring_prefix(pairs, ["conv_id"], 10)
    return E.scoring_prompt(V.labeled(spark, folder), prefix).select("id", text_md5("prompt").alias("prompt_md5"))


_JUDGE = f""", judged AS (SELECT score, chr(10) || '【Level ' || score || '：' || {_case("score", E.JUDGE_LEVELS, "'Level ' || score")} || '】' || chr(10)
 || string_agg('  • 「' || text || '」' || chr(10), '' ORDER BY id) AS section FROM top GROUP BY score)
, pre AS (SELECT {quoted(E.JUDGE_SCALE + chr(10) * 2 + E.EXAMPLES_HEADER)} || string_agg(section, '' ORDER BY score) AS prefix FROM judged)
"""


def _judged(text: str) -> str:
    return f"prefix || {quoted(E.JUDGE_SUFFIX[0])} || {text} || {quoted(E.JUDGE_SUFFIX[1])}"


@query(
    "e2_judge_prompt",
    with_views(_EXAMPLES + _JUDGE + f"SELECT id, md5({_judged('text')}) AS prompt_md5 FROM labeled, pre", "tasks"),
)
def e2_judge_prompt(spark, folder):
    prefix = E.judge_prefix(_few(spark, folder), ["id"], 30)
    return E.judge_prompt(V.labeled(spark, folder), prefix).select("id", text_md5("prompt").alias("prompt_md5"))


def _named(c: str) -> str:
    return _case(c, E.LEVEL_NAMES, f"'第' || {c} || '級'")


_GOAL = _case("target", E.TARGETS, quoted(E.TARGETS[2]))
_BASIC = f"""CASE WHEN original_score <> target THEN {_filled(E.CONVERT_BASIC, "original_score", _named("original_score"), "target", _named("target"), _GOAL, "60", "original_score", "text", "target")}
 ELSE {_filled(E.PLAIN_BASIC, "target", _GOAL, "60", "text", "target")} END"""
_DATA = f"""CASE WHEN target NOT BETWEEN 1 AND 4 THEN {quoted(E.INVALID_LEVEL)}
 WHEN original_score <> target THEN {_filled(E.CONVERT_DATA, "original_score", _named("original_score"), "target", _named("target"), _GOAL, "examples", "original_score", "text", "target")}
 ELSE {_filled(E.PLAIN_DATA, _named("target"), _GOAL, "examples", "text", _named("target"))} END"""


def _odd_levels(df):
    """Targets and original levels beyond 1..4, and unknown originals, for every tenth id."""
    part = F.col("id") % 10
    return df.withColumn(
        "original_score", F.when(part == 1, None).when(part == 2, 7).when(part == 3, F.col("target")).otherwise(F.col("score"))
    ).withColumn("target", F.when(part == 4, F.lit(6)).otherwise(F.col("target")))


_ODD = """SELECT id, text, score, examples, CASE id % 10 WHEN 1 THEN NULL WHEN 2 THEN 7 WHEN 3 THEN target ELSE score END AS original_score,
 CASE WHEN id % 10 = 4 THEN 6 ELSE target END AS target, target AS wanted FROM blocks"""


@query(
    "e3_rewrite_prompt_basic",
    with_views(_EXAMPLES + f", odd AS ({_ODD}) SELECT id, wanted, md5({_BASIC}) AS prompt_md5 FROM odd", "tasks"),
)
def e3_rewrite_prompt_basic(spark, folder):
    rows = _odd_levels(V.tasks(spark, folder).withColumn("wanted", F.col("target")))
    return E.rewrite_prompt_basic(rows).select("id", "wanted", text_md5("prompt").alias("prompt_md5"))


@query(
    "e4_rewrite_prompt_data",
    with_views(_EXAMPLES + f", odd AS ({_ODD}) SELECT id, wanted, md5({_DATA}) AS prompt_md5 FROM odd", "tasks"),
)
def e4_rewrite_prompt_data(spark, folder):
    rows = _odd_levels(_with_examples(spark, folder).withColumn("wanted", F.col("target")))
    return E.rewrite_prompt_data(rows).select("id", "wanted", text_md5("prompt").alias("prompt_md5"))


_SAME = f"""{_filled(E.PLAIN_DATA, _named("target"), _GOAL, "examples", "text", _named("target"))} || {quoted(chr(10) * 2 + E.ANSWER_ONLY)}"""
_OWN = """, own AS (SELECT l.id, l.text, l.score AS target, coalesce({count} || b.body, {none}) AS examples FROM labeled l LEFT JOIN by_level b ON b.level = l.score)
""".format(count=_filled(E.EXAMPLE_COUNT, "b.k"), none=quoted(E.NO_EXAMPLES))


@query(
    "e5_paraphrase_prompt",
    with_views(_EXAMPLES + _OWN + f"SELECT id, md5({_SAME}) AS prompt_md5 FROM own", "tasks"),
)
def e5_paraphrase_prompt(spark, folder):
    rows = E.attach_examples(V.labeled(spark, folder), E.examples_by_level(_few(spark, folder), ["id"]), "score")
    return E.paraphrase_prompt(rows, level="score").select("id", text_md5("prompt").alias("prompt_md5"))


_FIXED = f"{quoted(E.FIXED[0])} || text || {quoted(E.FIXED[1])}"


@query("e6_fixed_prompt", with_views(f"SELECT id, md5({_FIXED}) AS prompt_md5 FROM labeled", "labeled"))
def e6_fixed_prompt(spark, folder):
    return E.fixed_prompt(V.labeled(spark, folder)).select("id", text_md5("prompt").alias("prompt_md5"))


@query(
    "e7_instruction_text",
    with_views(
        f"SELECT conv_id, turn, md5({_filled(E.INSTRUCTION, *(f'coalesce({c}, {quoted(str())})' for c in ('instruction', 'input', 'output')))}) AS prompt_md5 FROM instructions",
        "instructions",
    ),
)
def e7_instruction_text(spark, folder):
    rows = E.instruction_text(V.instructions(spark, folder))
    return rows.select("conv_id", "turn", text_md5("prompt").alias("prompt_md5"))


def offline_registry() -> ModelRegistry:
    """Names of offline models, resolved by the same kind of rules as any other backend."""
    registry = ModelRegistry(fallback=lambda name: HashModel())
    registry.alias("null", "always-null")
    registry.prefix("echo", lambda name: EchoModel())
    registry.contains("flaky", lambda name: FlakyModel())
    registry.contains("null", lambda name: NullModel(), unless="flaky")
    return registry


@query(
    "f1_models_by_name",
    with_views(
        f"""SELECT id, m.model, CASE m.model WHEN 'null' THEN NULL WHEN 'echo-1' THEN md5('改寫為第 1 級：'
 || CASE WHEN len(string_split(text, '"')) > 2 THEN string_split(text, '"')[-2] ELSE text END || chr(10) || '以上改自原句，未加內容。')
 ELSE md5('【最終分數：' || {_digit("text")} || '】') END AS reply_md5 FROM labeled CROSS JOIN (VALUES ('hash'), ('null'), ('echo-1'), ('very-flaky-null')) m(model)""",
        "labeled",
    ),
)
def f1_models_by_name(spark, folder):
    rows = V.labeled(spark, folder).select("id", "text")
    registry = offline_registry()
    parts = [
        generate(rows.withColumn("model", F.lit(name)), registry.resolve(name), "text", NO_WAIT).select(
            "id", "model", text_md5("reply").alias("reply_md5")
        )
        for name in ("hash", "null", "echo-1", "very-flaky-null")
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "f2_generate",
    with_views(
        f"SELECT id, target, '【最終分數：' || {_digit('p')} || '】' AS reply, 1 AS attempts, 'ok' AS status FROM (SELECT id, target, {_BASIC.replace('original_score', 'score')} AS p FROM tasks)",
        "tasks",
    ),
)
def f2_generate(spark, folder):
    rows = E.rewrite_prompt_basic(V.tasks(spark, folder), original="score")
    rows = rows.withColumns({"temperature": F.lit(0.5), "max_new_tokens": F.lit(100)})
    out = generate(rows, HASH, retry=NO_WAIT, settings=("temperature", "max_new_tokens"), parallelism=8)
    return out.select("id", "target", "reply", "attempts", "status")


@query(
    "f2_generate_once",
    f"SELECT doc_id AS id, md5(text) AS text_md5, '【最終分數：' || {_digit('text')} || '】' AS reply FROM documents",
)
def f2_generate_once(spark, folder):
    """Half of the documents first, then all of them: the second run asks only for texts that the ledger lacks."""
    at = scratch_path(spark, "replies")
    rows = V.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    ask = lambda df: generate_once(df, HASH, "hash", at, "text", NO_WAIT, batches=2, parallelism=4, spread_by=("id",))
    ask(rows.where("id % 2 = 0"))
    return ask(rows).select("id", text_md5("text").alias("text_md5"), "reply")


@query(
    "f3_retry",
    with_views(
        f"""SELECT id, '【最終分數：' || {_digit("text")} || '】' AS reply,
 CAST(1 + (instr('0123456789abcdef', substr(md5(text), 2, 1)) - 1) % 4 AS INTEGER) AS attempts, 'ok' AS status FROM labeled""",
        "labeled",
    ),
)
def f3_retry(spark, folder):
    out = generate(V.labeled(spark, folder), ModelSpec(FlakyModel), "text", NO_WAIT)
    return out.select("id", "reply", "attempts", "status")


@query(
    "f4_predict_class",
    with_views("SELECT id, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred FROM logits", "logits"),
)
def f4_predict_class(spark, folder):
    return predict_class(V.logits(spark, folder)).select("id", "pred")


@query(
    "f5_score_table",
    with_views(f"SELECT id, score, {_digit(_FIXED)} AS predicted_score, 'marked' AS parse_path FROM labeled", "labeled"),
)
def f5_score_table(spark, folder):
    out = score_table(V.labeled(spark, folder), HASH, E.fixed_prompt, retry=NO_WAIT)
    return out.select("id", "score", "predicted_score", "parse_path")


@query(
    "f5_score_table_first_digit",
    with_views(f"SELECT id, CAST({_digit(_FIXED)} AS VARCHAR) AS model_score FROM labeled", "labeled"),
)
def f5_score_table_first_digit(spark, folder):
    out = score_table(V.labeled(spark, folder), HASH, E.fixed_prompt, parse_first_digit, NO_WAIT)
    return out.select("id", "model_score")


_REQUEST = _filled(E.PLAIN_BASIC, "target", _GOAL, "60", "input_text", "target")


@query(
    "f6_convert_and_score",
    with_views(
        _EXAMPLES
        + _JUDGE
        + f""", conv AS (SELECT event_id, target, '【最終分數：' || {_digit(_REQUEST)} || '】' AS output_text FROM activity)
, scored AS (SELECT event_id, target, output_text, {_digit(_judged("output_text"))} AS predicted_score FROM conv, pre)
SELECT event_id, output_text, predicted_score, predicted_score = target AS success FROM scored""",
        "tasks", "activity",
    ),
)
def f6_convert_and_score(spark, folder):
    requests = V.activity(spark, folder).select("event_id", "timestamp", "input_text", F.concat("target_level", F.lit("-x")).alias("target_level"))
    prefix = E.judge_prefix(_few(spark, folder), ["id"], 30)
    out = convert_and_score(requests, HASH, HASH, prefix, parallelism=spark.sparkContext.defaultParallelism)
    return out.select("event_id", "output_text", "predicted_score", "success")


@query(
    "f7_paraphrase",
    with_views(
        _EXAMPLES + _OWN + f"SELECT id, '【最終分數：' || {_digit(_SAME)} || '】' AS paraphrase FROM own", "tasks"
    ),
)
def f7_paraphrase(spark, folder):
    rows = V.labeled(spark, folder)
    table = E.examples_by_level(_few(spark, folder), ["id"])
    return paraphrase(rows, table, HASH, level="score").select("id", "paraphrase")


_P1 = f""", r AS ({seeded_rank_sql("labeled", "score", 42)})
, c AS (SELECT score AS k, count(*) AS n, sum(count(*)) OVER () AS total FROM labeled GROUP BY 1)
, q AS (SELECT k, n, total, CAST(total - ceil(total * 0.2) AS BIGINT) AS train FROM c)
, b AS (SELECT *, (n * train) // total AS base, (n * train) % total AS rest FROM q)
, f AS (SELECT k, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, k) <= train - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM b)
, m AS (SELECT r.*, r.rk <= f.quota AS is_train FROM r JOIN f ON f.k = r.score)
, few AS (SELECT *, row_number() OVER (PARTITION BY score ORDER BY md5('42:' || id), id) AS rn,
  count(*) OVER (PARTITION BY score) AS n, count(*) OVER () AS total FROM m WHERE is_train)
, drawn AS (SELECT *, row_number() OVER (ORDER BY md5('42:recut:' || id), id) AS again FROM few
  WHERE rn <= greatest(1, CAST(round_even(8 * n / total, 0) AS BIGINT)))
, pre AS (SELECT {quoted(E.SCALES[1] + chr(10) * 2 + E.EXAMPLES_HEADER)} || {_LINES} AS prefix FROM drawn WHERE again <= 8)
, s AS (SELECT id, score, {_digit(f"prefix || {quoted(E.SCORING_SUFFIX[0])} || text || {quoted(E.SCORING_SUFFIX[1])}")} AS predicted_score FROM m, pre WHERE NOT is_train)"""


@query(
    "p1_scoring_run",
    with_views(
        _P1
        + """SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE score = predicted_score) AS BIGINT) AS correct,
 round(100 * avg(CAST(score = predicted_score AS INTEGER)), 6) AS accuracy_percent FROM s""",
        "labeled",
    ),
)
def p1_scoring_run(spark, folder):
    rows = V.labeled(spark, folder)
    result = scoring_run(rows, HASH, scratch_path(spark, "scoring"), 8, retry=NO_WAIT)
    return result.accuracy.select("rows", "correct", six("accuracy_percent").alias("accuracy_percent"))


@query(
    "p1_stored_results",
    with_views(_P1 + "SELECT score, predicted_score, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1, 2", "labeled"),
)
def p1_stored_results(spark, folder):
    """The CSV that a run leaves behind, named after its input and the time."""
    result = scoring_run(V.labeled(spark, folder), HASH, scratch_path(spark, "scoring"), 8, retry=NO_WAIT, stem="labeled")
    stored = read_scoring_csv(spark, result.csv_path, "text string, score int, predicted_score int")
    return stored.groupBy("score", "predicted_score").agg(F.count("*").alias("n"))


_ORIGINAL = ", originals AS (SELECT t.*, " + _digit(_judged("t.text")) + " AS original_score FROM blocks t, pre)"


@query(
    "p2_experiment",
    with_views(
        _EXAMPLES
        + _JUDGE
        + _ORIGINAL
        + f""", generated AS (SELECT id, target, 'Basic' AS prompt_type, '【最終分數：' || {_digit(_BASIC)} || '】' AS generated_text FROM originals
UNION ALL SELECT id, target, 'Data', '【最終分數：' || {_digit(_DATA)} || '】' FROM originals)
, judged2 AS (SELECT target, 'hash_' || prompt_type AS model_mode, {_digit(_judged("generated_text"))} = target AS ok FROM generated, pre)
SELECT model_mode, target AS target_level, CAST(count(*) AS BIGINT) AS rows, round(100 * avg(CAST(ok AS INTEGER)), 6) AS accuracy_percent
FROM judged2 GROUP BY GROUPING SETS ((model_mode), (target), ())""",
        "tasks",
    ),
)
def p2_experiment(spark, folder):
    tasks = V.tasks(spark, folder).withColumn("task_id", F.col("id") * 10 + F.col("target"))
    tasks = tasks.select("task_id", "text", "target")
    workers = spark.sparkContext.defaultParallelism
    out = cut_lineage(experiment(tasks, _few(spark, folder), {"hash": HASH}, HASH, parallelism=workers))
    by = accuracy_by(with_mode(out), "is_correct", [["model_mode"], ["target_level"], []])
    return by.select("model_mode", "target_level", "rows", six("accuracy_percent").alias("accuracy_percent"))
