r"""Sanitisation of personal data by what terms disclose: base patterns find entities, the corpus tells which terms give them away.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Each distinct value is an entity to protect. Over the whole corpus it is
counted in how many documents an entity occurs, in how many a term occurs, and in how many the term stands within ``WINDOW`` code points
of the entity. From these follow the information content of the entity, ``IC = log2(N / n(c))``, and the pointwise mutual information
``PMI = log2(n(c, t) * N / (n(c) * n(t)))``, which reaches IC where the term determines the entity. A term discloses an entity where ``PMI >= ALPHA *
IC``, seen in ``SUPPORT`` different contexts at least (copies of one context count once). A disclosing term is generalised to the class of words that begin
with its first half if that class itself discloses no entity, else removed, wherever it stands, also in texts without the entity.

Everything is DataFrame functions. Positions come from regular expressions tied to the end of the previous match, whose lengths are
summed up in runs, so a text with very many findings costs little more than its length. Counts combine map-side; an entity or a term of a third of
all documents is spread by document first. Which terms disclose is a table that Spark joins as its size allows; texts are
shuffled at most once, and only those of documents that hold a disclosing term are needed there.

Defined cases: a null text is an empty text; texts without findings get an empty list; spans are code points, end exclusive, by start and then by kind in the order
of ``KINDS``; spans may overlap; an entity in more than half of all documents (IC below one bit) identifies nobody and is disclosed by no
term; rows with equal ids or texts each count and get their own result, also with null ids; an empty table gives an empty result. Only the
id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fresh, let, named, running, whole_text

ALPHA = 0.95
SUPPORT = 3
LEAST_BITS = 1.0
WINDOW = 64
CHUNK = 1024
TERM = 3  # letters and digits of a term at least


@dataclass(frozen=True)
class Kind:
    """Leftmost matches of ``pattern`` that do not overlap; ``hint`` is in every text with one.

    Lookbehinds and possessive quantifiers change no match: a match can start inside a run of its first class only where the last one ended.
    They keep runs from being tried again from each of their characters, and the matcher from recursion.
    """

    name: str
    pattern: str
    hint: str


# Kinds in the order in which findings at one place are listed.
KINDS = [
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]++\.[A-Za-z0-9-]",
    ),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    Kind("card", r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){11}"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]"),
]
ADDED = "term"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
WORD = r"""(?<![^\s("'\[{<])[\p{L}\p{N}](?:[\p{L}\p{N}_'’-]*[\p{L}\p{N}])?(?=[.,;:!?)"'\]}>]*+(?:\s|$))"""
REMOVED = "[removed]"
SPAN = "struct<start:int,order:int,kind:string,stop:int,put:string>"


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _entity(kind: str, value: Column) -> Column:
    plain = F.lower(value) if kind == "email" else value if kind == "ip" else F.regexp_replace(value, "[^0-9]", "")
    return F.concat(F.lit(f"{kind}:"), plain)


def _steps(text: Column, pattern: str, group: int) -> Column:
    """Group of every match; group 0 is the text since the previous match with the match itself."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)\G.*?({pattern})"), F.lit(group))


def terms(text: Column) -> Column:
    """Lower-cased words between blanks or punctuation that hold a letter: no address, number or path is one."""
    found = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)
    return F.filter(found, lambda t: (F.length(t) >= TERM) & t.rlike(r"\p{L}"))


def wider(term: Column) -> Column:
    """The class of words that begin with the term's first half."""
    return F.concat(F.substring(term, F.lit(1), F.shiftright(F.length(term) + 1, 1)), F.lit("*"))


def _with_classes(found: Column) -> Column:
    return let(found, lambda t: F.array_distinct(F.concat(t, F.transform(t, wider))))


def _findings(text: Column, kind: Kind, order: int) -> Column:
    """Array of ``(span, entity, words)`` of one kind; ``words`` are the terms around it, up to the neighbours of its kind."""

    def built(steps: Column, values: Column, stops: Column) -> Column:
        gap = lambda i: let(F.get(steps, i), lambda s: F.left(s, F.length(s) - F.length(F.get(values, i))))
        last = F.size(steps) - 1
        tail = F.substring(text, F.get(stops, last) + 1, F.lit(WINDOW + 1))
        # A word that the window cuts is left out.
        left = lambda i: let(gap(i), lambda g: F.when(F.length(g) > WINDOW, F.regexp_replace(F.right(g, F.lit(WINDOW)), r"^\S++", "")).otherwise(g))
        right = lambda i: let(
            F.when(i < last, F.left(gap(i + 1), F.lit(WINDOW + 1))).otherwise(tail),
            lambda g: F.when(F.length(g) > WINDOW, F.regexp_replace(g, r"\S++$", "")).otherwise(g),
        )

        def one(value: Column, i: Column) -> Column:
            span = F.struct(
                (F.get(stops, i) - F.length(value)).alias("start"),
                F.lit(order).alias("order"),
                F.lit(kind.name).alias("kind"),
                F.get(stops, i).alias("stop"),
                F.lit(f"[{kind.name}]").alias("put"),
            )
            words = F.when(_valid(kind.name, value), F.array_sort(_with_classes(F.concat(terms(left(i)), terms(right(i))))))
            return F.struct(span.alias("span"), _entity(kind.name, value).alias("entity"), words.alias("words"))

        return F.filter(F.transform(values, one), lambda x: x["words"].isNotNull())

    found = let(
        _steps(text, kind.pattern, 0),
        lambda steps: let(
            _steps(text, kind.pattern, 1),
            lambda values: let(running(F.transform(steps, F.length)), lambda stops: built(steps, values, stops)),
        ),
    )
    empty = F.array().cast(f"array<struct<span:{SPAN},entity:string,words:array<string>>>")
    return F.when(text.rlike(kind.hint), found).otherwise(empty)


def text_mark(text: Column) -> Column:
    return F.xxhash64(text)


def _slim(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole_text(named(df, text_col))
    return df.select(named(df, id_col).alias("id"), text.alias("text")).withColumn("mark", text_mark(F.col("text")))


def base_findings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: list[Kind] = KINDS) -> DataFrame:
    """``(id, mark, found)`` of every row, written once; ``mark`` is a hash of the text."""
    parts = [_findings(F.col("text"), kind, order) for order, kind in enumerate(kinds)]
    found = _slim(df, id_col, text_col).select("id", "mark", F.concat(*parts).alias("found"))
    return cut_lineage(found, "personal")


def corpus_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``(key, n)``: documents that hold each term, and each class of terms."""
    text = whole_text(named(df, text_col))
    return df.select(F.explode(_with_classes(terms(text))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def joint_counts(base: DataFrame) -> DataFrame:
    """``(entity, key, n, contexts)``: documents in which key and entity are neighbours; with a null key, those with the entity."""
    rows = base.where(F.size("found") > 0).withColumn("row", F.monotonically_increasing_id())
    each = rows.select("row", F.explode("found").alias("f")).select("row", "f.entity", "f.words", F.xxhash64("f.words").alias("context"))
    keys = F.concat(F.col("words"), F.array(F.lit(None).cast("string")))
    pairs = each.select("row", "entity", "context", F.explode(keys).alias("key"))
    by_row = pairs.groupBy("entity", "key", "row").agg(F.min("context").alias("context"))
    by_context = by_row.groupBy("entity", "key", "context").agg(F.count("*").alias("n"))
    return by_context.groupBy("entity", "key").agg(F.sum("n").alias("n"), F.count("*").alias("contexts"))


def disclosing_terms(
    df: DataFrame, base: DataFrame, text_col: str = "text", alpha: float = ALPHA, support: int = SUPPORT
) -> DataFrame:
    """``(term, bits, put)``: terms that disclose an entity, the largest mutual information, and what they are replaced by."""
    n = base.count()
    joint = cut_lineage(joint_counts(base), "joint-counts")
    entities = joint.where("key IS NULL").select(F.col("entity").alias("_entity"), F.col("n").alias("n_entity"))
    pairs = joint.where(F.col("key").isNotNull() & (F.col("contexts") >= support))
    pairs = pairs.join(entities, F.col("entity") == F.col("_entity")).where(F.log2(F.lit(float(n)) / F.col("n_entity")) >= LEAST_BITS)
    counts = corpus_counts(df, text_col).withColumnRenamed("n", "n_key")
    known = pairs.select("key", F.col("n").alias("n_both"), "n_entity").join(counts, "key")
    content = F.log2(F.lit(float(n)) / F.col("n_entity"))
    mutual = F.log2(F.col("n_both") * F.lit(float(n)) / (F.col("n_entity").cast("double") * F.col("n_key")))
    told = known.where(mutual >= alpha * content).groupBy("key").agg(F.max(mutual).alias("bits"))
    told = cut_lineage(told, "disclosing")
    classes = told.where(F.col("key").endswith("*")).select(F.col("key").alias("class"))
    found = told.where(~F.col("key").endswith("*")).withColumn("class", wider(F.col("key")))
    taken = classes.withColumn("told", F.lit(True))
    put = F.when(F.col("told"), F.lit(REMOVED)).otherwise(F.col("class"))
    return cut_lineage(found.join(taken, "class", "left").select(F.col("key").alias("term"), "bits", put.alias("put")), "terms")


def term_spans(df: DataFrame, told: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, mark, added)``: places of disclosing terms in the texts that hold any."""
    slim = _slim(df, id_col, text_col)
    told = told.select("term", "put")
    words = slim.select("id", "mark", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    hits = cut_lineage(words.join(told, "term").select("id", "mark").distinct(), "hits")
    hits = hits.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"))
    held = slim.join(hits, slim["id"].eqNullSafe(hits["_id"]) & (slim["mark"] == hits["_mark"]), "left_semi")

    def places(steps: Column, values: Column, stops: Column) -> Column:
        return F.transform(
            values,
            lambda v, i: F.struct((F.get(stops, i) - F.length(v)).alias("start"), F.get(stops, i).alias("stop"), F.lower(v).alias("term")),
        )

    text = F.col("text")
    found = let(
        _steps(text, WORD, 0),
        lambda steps: let(
            _steps(text, WORD, 1), lambda values: let(running(F.transform(steps, F.length)), lambda stops: places(steps, values, stops))
        ),
    )
    each = held.select("id", "mark", F.explode(found).alias("w")).select("id", "mark", "w.*").join(told, "term")
    span = F.struct("start", F.lit(len(KINDS)).alias("order"), F.lit(ADDED).alias("kind"), "stop", "put")
    return each.groupBy("id", "mark").agg(F.collect_set(span.cast(SPAN)).alias("added"))


def find_personal(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, support: int = SUPPORT
) -> DataFrame:
    """``(id, mark, spans)`` of every row of ``df``: base spans and those of disclosing terms, sorted, each with its replacement."""
    base = base_findings(df, id_col, text_col)
    told = disclosing_terms(df, base, text_col, alpha, support)
    added = term_spans(df, told, id_col, text_col).withColumnsRenamed({"id": "_id", "mark": "_mark"})
    both = base.join(added, base["id"].eqNullSafe(added["_id"]) & (base["mark"] == added["_mark"]), "left")
    spans = F.concat(F.col("found.span").cast(f"array<{SPAN}>"), F.coalesce("added", F.array().cast(f"array<{SPAN}>")))
    return both.select(F.col("id").alias(id_col), "mark", F.array_sort(spans).alias("spans"))


def replaced(text: Column, spans: Column) -> Column:
    """The text with each span (sorted) replaced by its ``put``; of overlapping ones the first counts, a later one for what it covers beyond."""

    def whole(chunks: Column, ends: Column) -> Column:
        # ends[i] is the furthest end of the spans up to the i-th; a piece is cut from few chunks, however long the text.
        def piece(a: Column, b: Column) -> Column:
            i, j = F.shiftright(a, 10), F.shiftright(b, 10)
            at = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
            inside = F.substring(at(i), a % CHUNK + 1, b - a)
            across = F.concat(
                F.substring(at(i), a % CHUNK + 1, F.lit(CHUNK)),
                F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""),
                F.substring(at(j), F.lit(1), b % CHUNK),
            )
            return F.when(b <= a, "").when(i == j, inside).otherwise(across)

        def one(s: Column, i: Column) -> Column:
            done = F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
            return F.concat(piece(done, s["start"]), F.when(s["stop"] > done, s["put"]).otherwise(""))

        tail = piece(F.get(ends, F.size(ends) - 1), F.length(text))
        return F.concat(F.array_join(F.transform(spans, one), ""), tail)

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    ends = running(F.transform(spans, lambda s: s["stop"]), F.greatest)
    return F.when(F.size(spans) == 0, text).otherwise(let(cut, lambda chunks: let(ends, lambda e: whole(chunks, e))))


def sanitize(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> tuple[DataFrame, list[str]]:
    """``df`` with two new columns, whose names are returned: the spans, and the text with all of them replaced."""
    spans, clean, mark = fresh(df, "spans", "sanitized", "_text_mark")
    found = find_personal(df, id_col, text_col, **options).dropDuplicates([id_col, "mark"])
    found = found.select(F.col(id_col).alias("_own_id"), F.col("mark").alias("_own_mark"), F.col("spans").alias("_own_spans"))
    text = whole_text(named(df, text_col))
    marked = df.withColumn(mark, text_mark(text))
    own = named(marked, id_col).eqNullSafe(found["_own_id"]) & (marked[mark] == found["_own_mark"])
    joined = marked.join(found, own).select(*[named(marked, c) for c in df.columns], found["_own_spans"].alias(spans))
    return joined.withColumn(clean, replaced(whole_text(F.col(f"`{text_col}`")), F.col(spans))), [spans, clean]


def listed(spans: Column, kinds: list[str] | None = None) -> Column:
    """``kind:start:stop`` of each span, comma-joined; only of some kinds if they are given."""
    chosen = F.filter(spans, lambda x: x["kind"].isin(kinds)) if kinds else spans
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))
    return F.array_join(F.transform(chosen, one), ",")
