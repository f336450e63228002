"""Prompts as columns. Templates, scale texts and examples are parameters with defaults of our own wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import non_empty
from ..schemas import PAIRED_EXAMPLE
from .sampling import first_n_per_class

# The names of the levels inside prompts.
LEVEL_NAMES = {1: "一級", 2: "二級", 3: "三級", 4: "四級"}
# Fixed value: what callers receive in place of a prompt when the target level is not 1..4.
INVALID_LEVEL = "Error: Level must be 1, 2, 3, or 4."

SCALES = {
    1: "任務：判斷句子的語氣等級。\n1＝客氣友善；2＝平鋪直敘；3＝直接發火；4＝話中帶刺。",
    2: "任務：判斷句子的語氣等級，等級之間互不重疊。\n1＝一定有緩和用語；2＝只有事實；3＝明講不滿；4＝表面稱讚、實為嘲笑。",
    3: "任務：判斷句子的語氣等級。\n1＝多半有緩和用語或善意；2＝只有事實；3＝明講不滿；4＝表面稱讚、實為嘲笑。\n單純有禮貌的句子不算 4。",
    4: "任務：判斷句子的語氣等級。\n1＝主動關心、道歉或致謝；2＝日常往來與告知；3＝明講不滿；4＝表面稱讚、實為嘲笑。",
}
HARD_NEGATIVES = (
    "容易弄混的例子：\n「會議改到三點。」→ 2\n「會議改到三點，辛苦你配合了。」→ 1\n"
    "「三點開會，別再遲到！」→ 3\n「三點開會，你這次打算幾點到呢？」→ 4"
)
# Ten originals with a rewrite per level, for prompts without a data set of their own.
PAIRED_EXAMPLES = (
    ("鑰匙還我", "方便的話，鑰匙可以還我嗎？謝謝你。", "請把鑰匙還給我。", "鑰匙拿來，講幾次了！", "這把鑰匙看來是你家的了。"),
    ("音樂關小聲", "不好意思，音樂可以小聲一點嗎？", "音樂請調小聲。", "音樂吵死了，關掉！", "謝謝你請全棟樓聽演唱會。"),
    ("垃圾沒倒", "今天垃圾還沒倒，我們一起處理好嗎？", "垃圾還沒有倒。", "垃圾又沒倒，你是住旅館嗎！", "你在培養垃圾的年份吧。"),
    ("借我充電線", "可以跟你借一下充電線嗎？麻煩了。", "我要借充電線。", "充電線拿來，快點。", "你的充電線是傳家寶，看一眼都不行。"),
    ("車停歪了", "車子好像停得有點斜，要不要我幫你看？", "車子沒有停在格線內。", "車停這樣別人怎麼過！", "停車格畫得太保守，配不上你。"),
    ("湯太鹹", "湯很香，下次鹽少一點會更棒喔。", "湯偏鹹。", "湯鹹成這樣誰喝得下！", "這碗湯讓我懂了海的心情。"),
    ("排隊不要插隊", "不好意思，隊伍的尾端在後面喔。", "請到後面排隊。", "別插隊，滾到後面去！", "原來隊伍是從你開始算的。"),
    ("字太小看不清", "字可以幫忙放大一點嗎？謝謝。", "字太小，看不清楚。", "字這麼小是給誰看的！", "字這麼小，是怕我們看懂嗎。"),
    ("電話沒接", "剛剛打給你沒接到，一切都好吧？", "你沒有接電話。", "打了五通都不接，搞什麼！", "你的手機大概只是裝飾品。"),
    ("下雨忘了帶傘", "下雨了，沒帶傘的話跟我一起撐吧。", "外面下雨，你沒有帶傘。", "說了會下雨還不帶傘！", "你是想免費洗個澡吧。"),
)
EXAMPLES_HEADER = "參考例句：\n"
SCORING_SUFFIX = ("\n請為這個句子評分：\n「", "」\n只回答 1、2、3、4 其中一個數字。")
JUDGE_SCALE = SCALES[1]
JUDGE_LEVELS = {1: "客氣", 2: "平實", 3: "發火", 4: "帶刺"}
JUDGE_SUFFIX = ("\n請為這個句子評分：\n「", "」 →")
TARGETS = {
    1: "等級 1：體貼、柔和",
    2: "等級 2：冷靜、只講事實",
    3: "等級 3：不耐煩、有壓力",
    4: "等級 4：反話、假稱讚",
}
NO_EXAMPLES = "（這個等級沒有例句，請依說明發揮）\n"
ANSWER_ONLY = "請只寫出改寫後的句子。"
CONVERT_BASIC = (
    "你擅長改寫中文語氣。\n這句話目前是第 %d 級（%s），請改成第 %d 級（%s）。\n目標：%s\n"
    "要求：意思不變、人稱不變、不照抄例句、不超過 %d 字。\n原句（第 %d 級）：\"%s\"\n第 %d 級：\n" + ANSWER_ONLY + "\n"
)
PLAIN_BASIC = (
    "你擅長改寫中文語氣。\n請把這句話改成第 %d 級。\n目標：%s\n"
    "要求：問句仍是問句、人稱不變、不照抄例句、不超過 %d 字。\n原句：\"%s\"\n第 %d 級："
)
CONVERT_DATA = (
    "你擅長改寫中文語氣。\n這句話目前是第 %d 級（%s），請改成第 %d 級（%s）。\n目標：%s\n%s"
    "要求：意思不變、人稱不變、不照抄例句。\n原句（第 %d 級）：\"%s\"\n第 %d 級："
)
PLAIN_DATA = "你擅長改寫中文語氣。\n請把原句改成「%s」。\n目標：%s\n%s原句：\"%s\"\n%s：\n" + ANSWER_ONLY + "\n"
EXAMPLE_COUNT = "這個語氣的 %d 個例句：\n"
FIXED = (
    "你是評分器，只能輸出 1、2、3 或 4。\n1＝客氣友善；2＝平鋪直敘；3＝直接發火；4＝話中帶刺。\n\n"
    "句子：謝謝你特地跑一趟。\n分數：1\n\n句子：包裹已經寄出。\n分數：2\n\n"
    "句子：你到底要拖到什麼時候！\n分數：3\n\n句子：你真準時，才晚了兩小時。\n分數：4\n\n句子：",
    "\n分數：",
)
INSTRUCTION = (
    "The task is stated first, then the material for it. Answer the task.\n\n"
    "### Instruction:\n%s\n\n### Input:\n%s\n\n### Response:\n%s"
)


def _choose(level: Column, texts: dict[int, str], default: Column | None = None) -> Column:
    chain = F
    for value, text in texts.items():
        chain = chain.when(level == value, text)
    return chain.otherwise(default) if default is not None else chain


def _one_block(examples: DataFrame, order: list[str], line: Column, n: int) -> DataFrame:
    """The lines of the first ``n`` examples in ``order`` as one text. How many a prompt shows is the caller's choice; having none
    at all stops the job."""
    kept = examples.select(F.struct(*order).alias("_o"), line.alias("_line")).orderBy("_o").limit(n)
    lines = kept.agg(F.array_sort(F.collect_list(F.struct("_o", "_line"))).alias("_l"))
    text = F.array_join(F.transform("_l", lambda e: e["_line"]), "")
    checked = F.when(
        F.size("_l") == 0, F.raise_error(F.lit("the examples must hold at least one row")).cast("string")
    ).otherwise(text)
    return lines.select(checked.alias("block"))


def example_line(df: DataFrame) -> Column:
    """``「text」 → score`` (a fixed value, as callers expect it); the text is the first non-empty of ``text``, ``original``, ``sentence``."""
    names = [c for c in ("text", "original", "sentence") if c in df.columns]
    text = F.coalesce(*[non_empty(c) for c in names], F.lit(""))
    score = F.coalesce(F.col("score").cast("string"), F.lit("")) if "score" in df.columns else F.lit("")
    return F.concat(F.lit("「"), text, F.lit("」 → "), score, F.lit("\n"))


def paired_line() -> Column:
    """One original with its four level texts, a missing level left empty. Fixed value: the form of these lines."""
    level = lambda n: F.concat(F.lit(f"{n}: "), F.coalesce(F.element_at("by_level", F.lit(n)), F.lit("")), F.lit("\n"))
    head = F.concat(F.lit("原句："), F.coalesce("original", F.lit("")), F.lit("\n"))
    return F.concat(head, *[level(n) for n in (1, 2, 3, 4)], F.lit("\n"))


def default_pairs(spark: SparkSession) -> DataFrame:
    """The built-in paired examples: ``position, original, by_level``."""
    rows = [(i, p[0], dict(enumerate(p[1:], 1))) for i, p in enumerate(PAIRED_EXAMPLES)]
    return spark.createDataFrame(rows, f"position int, {PAIRED_EXAMPLE}")


def scale_text(version: int = 1, override: str | None = None) -> str:
    if override is not None:
        return override
    if version not in SCALES:
        raise ValueError(f"unknown scale version {version}; use one of {sorted(SCALES)}")
    return SCALES[version]


def scoring_prefix(
    examples: DataFrame,
    order: list[str],
    n: int,
    version: int = 1,
    hard_negatives: bool = False,
    scale: str | None = None,
) -> DataFrame:
    """One row with the part of the scoring prompt that all rows share; it shows the first ``n`` examples."""
    head = scale_text(version, scale).strip() + "\n\n"
    if hard_negatives:
        head += HARD_NEGATIVES.strip() + "\n\n"
    line = paired_line() if "by_level" in examples.columns else example_line(examples)
    return _one_block(examples, order, line, n).select(
        F.concat(F.lit(head + EXAMPLES_HEADER), F.col("block")).alias("prefix")
    )


def scoring_prompt(
    df: DataFrame, prefix: DataFrame, text: str = "text", suffix: tuple[str, str] = SCORING_SUFFIX, out: str = "prompt"
) -> DataFrame:
    """Prefix, sentence and instruction. The prefix is a scalar subquery: computed once, no join."""
    return df.withColumn(out, F.concat(prefix.scalar(), F.lit(suffix[0]), F.col(text), F.lit(suffix[1])))


def judge_prefix(
    examples: DataFrame,
    order: list[str],
    per_level: int = 5,
    scale: str = JUDGE_SCALE,
    names: dict[int, str] = JUDGE_LEVELS,
) -> DataFrame:
    """Scale, then the first ``per_level`` examples of each level under a header, levels ascending."""
    few = first_n_per_class(examples.select("score", "text", *order), "score", per_level, order, tuple(names))
    bullets = few.groupBy("score").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct(*order, F.col("text").alias("_text")))), lambda e: e["_text"]
            ),
            "」\n  • 「",
        ).alias("_b")
    )
    name = _choose(F.col("score"), names, F.format_string("Level %d", F.col("score")))
    # The header and the bullet of a level.
    section = F.concat(
        F.lit("\n【Level "), F.col("score").cast("string"), F.lit("："), name, F.lit("】\n  • 「"), F.col("_b"), F.lit("」\n")
    )
    return _one_block(bullets.withColumn("_s", section), ["score"], F.col("_s"), len(names)).select(
        F.concat(F.lit(scale + "\n\n" + EXAMPLES_HEADER), F.col("block")).alias("prefix")
    )


def judge_prompt(df: DataFrame, prefix: DataFrame, text: str = "text", out: str = "prompt") -> DataFrame:
    return scoring_prompt(df, prefix, text, JUDGE_SUFFIX, out)


def _converts(df: DataFrame, original: str | None, target: Column) -> Column:
    if original is None or original not in df.columns:
        return F.lit(False)
    return F.coalesce(F.col(original) != target, F.lit(False))


def _level_name(level: Column) -> Column:
    return _choose(level, LEVEL_NAMES, F.format_string("第%d級", level))


def rewrite_prompt_basic(
    df: DataFrame,
    text: str = "text",
    target: str = "target",
    original: str | None = "original_score",
    max_chars: int = 60,
    out: str = "prompt",
) -> DataFrame:
    """Rewrite prompt without examples: conversion form when the original level is known and differs."""
    t, s = F.col(target), F.col(text)
    goal = _choose(t, TARGETS, F.lit(TARGETS[2]))
    plain = F.format_string(PLAIN_BASIC, t, goal, F.lit(max_chars), s, t)
    if original is None or original not in df.columns:
        return df.withColumn(out, plain)
    o = F.col(original)
    convert = F.format_string(
        CONVERT_BASIC, o, _level_name(o), t, _level_name(t), goal, F.lit(max_chars), o, s, t
    )
    return df.withColumn(out, F.when(_converts(df, original, t), convert).otherwise(plain))


def examples_by_level(
    examples: DataFrame,
    order: list[str],
    n: int = 30,
    level: str = "score",
    text: str = "text",
    levels: tuple[int, ...] = (1, 2, 3, 4),
) -> DataFrame:
    """``(level, n_examples, example_lines)`` from the first ``n`` examples of each level."""
    slim = examples.select(F.col(level).cast("int").alias("level"), F.col(text).alias("_text"), *order)
    few = first_n_per_class(slim, "level", n, order, levels)
    listed = F.array_sort(F.collect_list(F.struct(*order, "_text")))
    lines = F.array_join(F.transform(listed, lambda e: F.concat(F.lit("- "), e["_text"], F.lit("\n"))), "")
    return few.groupBy("level").agg(F.count("*").alias("n_examples"), lines.alias("example_lines"))


def attach_examples(
    df: DataFrame, by_level: DataFrame, target: str = "target", levels: tuple[int, ...] = (1, 2, 3, 4)
) -> DataFrame:
    """Add the example block of the target level, or the placeholder line.

    The blocks of the given levels are looked up through one scalar map, so the task rows are not shuffled.
    """
    entries = F.collect_list(F.struct("level", F.struct("n_examples", "example_lines")))
    table = by_level.where(F.col("level").isin(*levels)).agg(F.map_from_entries(entries))
    block = F.concat(F.format_string(EXAMPLE_COUNT, F.col("_x.n_examples")), F.col("_x.example_lines"))
    return (
        df.withColumn("_x", F.element_at(table.scalar(), F.col(target).cast("int")))
        .withColumn("examples", F.when(F.col("_x").isNull(), F.lit(NO_EXAMPLES)).otherwise(block))
        .drop("_x")
    )


def rewrite_prompt_data(
    df: DataFrame,
    text: str = "text",
    target: str = "target",
    original: str | None = "original_score",
    examples: str = "examples",
    out: str = "prompt",
) -> DataFrame:
    """Rewrite prompt with the target level's examples (as :func:`attach_examples` adds them)."""
    t, s, e = F.col(target), F.col(text), F.col(examples)
    goal = _choose(t, TARGETS)
    prompt = F.format_string(PLAIN_DATA, _level_name(t), goal, e, s, _level_name(t))
    if original is not None and original in df.columns:
        o = F.col(original)
        convert = F.format_string(CONVERT_DATA, o, _level_name(o), t, _level_name(t), goal, e, o, s, t)
        prompt = F.when(_converts(df, original, t), convert).otherwise(prompt)
    return df.withColumn(out, F.when(t.isin(*TARGETS), prompt).otherwise(INVALID_LEVEL))


def paraphrase_prompt(
    df: DataFrame, text: str = "text", level: str = "level", examples: str = "examples", out: str = "prompt"
) -> DataFrame:
    """Same-level rewrite: the example prompt in its plain form plus a closing line."""
    return rewrite_prompt_data(df, text, level, None, examples, out).withColumn(
        out, F.concat(out, F.lit("\n\n" + ANSWER_ONLY))
    )


def fixed_prompt(df: DataFrame, text: str = "text", out: str = "prompt") -> DataFrame:
    return df.withColumn(out, F.concat(F.lit(FIXED[0]), F.col(text), F.lit(FIXED[1])))


def instruction_text(df: DataFrame, template: str = INSTRUCTION, out: str = "prompt") -> DataFrame:
    """Instruction, input and response in one text; null counts as empty."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("instruction", "input", "output")]
    return df.withColumn(out, F.format_string(template, *parts))
