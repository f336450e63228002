"""The registered queries of this folder, each next to its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import byte_bpe, decision_lists, decontaminate, disclosure, lexical_search, line_dedup, secret_ledger, simhash, substring_trees, suffix_array, url_filters, warc_archive, whitening
from .common import documents, pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def sha256(c) -> F.Column:
    return F.sha2(c.cast("binary"), 256)


@query(
    "op1_warc_archive",
    """
WITH sized AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
owners AS (SELECT html, max(page_id) AS owner FROM sized WHERE payload_bytes >= 1000 GROUP BY html)
SELECT s.page_id, s.payload_bytes, sha1(s.html) AS payload_digest,
       CASE WHEN o.owner <> s.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN o.owner <> s.page_id THEN o.owner END AS refers_to
FROM sized s LEFT JOIN owners o ON o.html = s.html
""",
)
def warc_query(spark: SparkSession, folder: str) -> DataFrame:
    at = scratch_path(spark, "warc")
    warc_archive.write_archive(pages(spark, folder), at)
    return warc_archive.read_records(spark, at).select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


@query(
    "op2_url_filters",
    r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                          ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
judged AS (
  SELECT page_id, host, path,
    (SELECT max(struct_pack(size := length(h || p), rule := h || p, verdict := v)) FROM rules
     WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best FROM parts)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged
""",
)
def url_filter_query(spark: SparkSession, folder: str) -> DataFrame:
    return url_filters.judge_urls(pages(spark, folder), url_filters.rules_frame(spark, URL_RULES))


@query("op3_decontamination")
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


@query(
    "op4_substring_trees",
    r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS s FROM w WHERE len(words) >= 35),
windows AS (SELECT doc_id, s, md5(array_to_string(words[s:s + 34], ' ')) AS k FROM starts),
many AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
cut AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM windows WHERE k IN (SELECT k FROM many)),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
kept AS (SELECT e.doc_id, count(*) AS n, string_agg(e.word, ' ' ORDER BY e.p) AS t
         FROM each e ANTI JOIN cut c ON c.doc_id = e.doc_id AND c.p = e.p GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id
""",
)
def substring_trees_query(spark: SparkSession, folder: str) -> DataFrame:
    return substring_trees.cut_repeats(documents(spark, folder), with_text=False)


@query("op5_quality_rules")
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    learned = decision_lists.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return decision_lists.judge(docs, learned)


@query(
    "op7_line_dedup",
    r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
firsts AS (SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (
  SELECT x.*, coalesce(f.first_doc < x.doc_id, false) AS dropped FROM keyed x LEFT JOIN firsts f ON f.k = x.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
)
def line_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    found, (n_lines, n_dropped, kept) = line_dedup.dedup_lines(documents(spark, folder))
    return found.select(
        "doc_id",
        F.col(n_lines).alias("n_lines"),
        F.col(n_dropped).alias("n_dropped"),
        sha256(F.col(kept)).alias("kept_sha256"),
    )


def tokenizer() -> tuple[bytes, str]:
    import public_tokenizers

    return byte_bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


@query("op6_byte_bpe")
def byte_bpe_query(spark: SparkSession, folder: str) -> DataFrame:
    ranks, pattern = tokenizer()
    return byte_bpe.encode_table(documents(spark, folder), ranks, pattern, with_ids=False)


@query("op8_secret_scan")
def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_ledger.find_secrets(documents(spark, folder))
    spans = F.col("spans")
    base = ["assign", "access", "hex"]
    of = lambda kind: F.filter(spans, lambda x: x["kind"] == kind)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in base]
    return found.select(
        "doc_id",
        *counts,
        sha256(secret_ledger.listed(spans, base)).alias("base_sha256"),
        secret_ledger.listed(spans).alias("spans"),
    )


@query("op9_simhash")
def simhash_query(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_groups(documents(spark, folder))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query(
    "op10_suffix_array",
    """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, unnest(range(1, CAST(length(h) / 2 AS BIGINT) - 48)) AS s, h FROM d WHERE length(h) >= 100),
windows AS (SELECT doc_id, s, hash(substr(h, 2 * s - 1, 100)) AS k FROM starts),
firsts AS (SELECT k, min(doc_id) AS first_doc FROM windows GROUP BY k),
cut AS (SELECT doc_id, s FROM windows JOIN firsts USING (k) WHERE first_doc < doc_id),
grouped AS (SELECT doc_id, s, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS gap FROM cut),
spans AS (SELECT doc_id, s, sum(CASE WHEN gap IS NULL OR gap > 50 THEN 1 ELSE 0 END)
                            OVER (PARTITION BY doc_id ORDER BY s) AS span FROM grouped),
ends AS (SELECT doc_id, span, min(s) AS a, max(s) + 50 AS b FROM spans GROUP BY 1, 2),
parts AS (SELECT doc_id, span, b AS from_byte,
                 coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY span), 2000000000) AS to_byte, a FROM ends),
kept AS (SELECT p.doc_id, count(*) AS n_spans,
                sum(from_byte - a) AS n_removed,
                substr(any_value(h), 1, 2 * (min(a) - 1))
                  || string_agg(substr(h, 2 * from_byte - 1, 2 * (to_byte - from_byte)), '' ORDER BY span) AS left_hex
         FROM parts p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(left_hex, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
)
def suffix_array_query(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_array.cut_later_copies(documents(spark, folder), with_bytes=False)


@query(
    "op11_ranked_search",
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
b AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS q FROM b GROUP BY ALL),
st AS (SELECT CAST(count(*) FILTER (len(terms) > 0) AS BIGINT) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM d),
m AS (SELECT doc_id, 75 + (25 * len(terms) * n) // l AS m FROM d, st),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d)
      WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, st GROUP BY term),
s AS (SELECT item_id, p.doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM asked JOIN p USING (term) JOIN w USING (term) JOIN m ON m.doc_id = p.doc_id GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
""",
)
def ranked_search_query(spark: SparkSession, folder: str) -> DataFrame:
    at = lexical_search.write_index(documents(spark, folder), scratch_path(spark, "search-index"))
    return lexical_search.search(spark, at, spark.read.parquet(f"{folder}/benchmark.parquet"))


@query("op12_disclosure")
def disclosure_query(spark: SparkSession, folder: str) -> DataFrame:
    found = disclosure.find_personal(documents(spark, folder))
    spans = F.col("spans")
    base = [kind.name for kind in disclosure.KINDS]
    of = lambda kind: F.filter(spans, lambda x: x["kind"] == kind)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in base]
    return found.select(
        "doc_id",
        *counts,
        sha256(disclosure.listed(spans, base)).alias("base_sha256"),
        disclosure.listed(spans).alias("spans"),
    )


@query("op13_whitening")
def whitening_query(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened_rows(spark.read.parquet(f"{folder}/embeddings.parquet"))
