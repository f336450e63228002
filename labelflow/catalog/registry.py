"""Register a query next to the plain SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The views of sources/views.py as common table expressions over the raw tables.
VIEWS = {
    "labeled": "SELECT d.doc_id AS id, d.text, CAST(1 + 2 * l.quality + l.toxic AS INTEGER) AS score "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "predicted": "SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER)) AS id, "
    "CAST(1 + l_linenumber % 4 AS INTEGER) AS gold, CAST(1 + l_partkey % 4 AS INTEGER) AS pred, "
    "l_returnflag AS model, l_linestatus AS prompt_type FROM lineitem",
    "replies": "SELECT *, '【最終分數：' || "
    "(1 + (instr('0123456789abcdef', substr(md5(text), 1, 1)) - 1) % 4) || '】' AS reply FROM labeled",
    "raw_replies": "SELECT doc_id AS id, text AS reply FROM documents",
    "tasks": "SELECT l.*, v.target FROM labeled l JOIN (VALUES (1), (2), (3), (4)) v(target) ON v.target <> l.score",
    "activity": "SELECT event_id, ts AS timestamp, user_id, CAST(1 + event_id % 4 AS INTEGER) AS target, "
    "CAST(1 + CAST(floor(value) AS BIGINT) % 4 AS INTEGER) AS predicted_score, "
    "(1 + event_id % 4) = (1 + CAST(floor(value) AS BIGINT) % 4) AS success, "
    "event_type AS input_text, props AS output_text FROM events",
    "instructions": "SELECT u.conv_id, u.turn, s.instruction, u.text AS input, a.text AS output "
    "FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' "
    "LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS instruction FROM conversations WHERE role = 'system' "
    "GROUP BY conv_id) s ON s.conv_id = u.conv_id WHERE u.role = 'user'",
    "logits": "SELECT vec_id AS id, embedding AS logits, label AS gold FROM embeddings",
}
_NEEDS = {"replies": ("labeled",), "tasks": ("labeled",)}


def with_views(body: str, *names: str) -> str:
    """``body`` (which may start with more CTEs after a leading comma) under the named views."""
    order: list[str] = []
    for name in names:
        for needed in (*_NEEDS.get(name, ()), name):
            if needed not in order:
                order.append(needed)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def text_md5(c: Column | str) -> Column:
    """Digest of a whole text: long texts are compared exactly without being sent to the driver."""
    return F.md5((F.col(c) if isinstance(c, str) else c).cast("binary"))


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def six(c: Column | str) -> Column:
    return F.round(c, 6)


def seeded_rank_sql(view: str, by: str | None, seed: int | str) -> str:
    """Plain SQL for the seeded rank: one window over whole classes."""
    part = f"PARTITION BY {by} " if by else ""
    return (
        f"SELECT *, row_number() OVER ({part}ORDER BY md5('{seed}:' || id), id) AS rk FROM {view}"
    )


def folded_sql(view: str, label: str, k: int, seed: int) -> str:
    """CTEs ending in ``folded``: places of all rows are counted one by one."""
    return f"""
, ranked AS ({seeded_rank_sql(view, label, seed)})
, totals AS (SELECT {label}, count(*) AS n, min(id) AS f FROM {view} GROUP BY {label})
, offs AS (SELECT {label}, n, coalesce(sum(n) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM totals)
, places AS (SELECT {label}, unnest(range(CAST(o AS BIGINT), CAST(o + n AS BIGINT))) AS p FROM offs)
, sizes AS (SELECT {label}, p % {k} AS fold, count(*) AS c FROM places GROUP BY 1, 2)
, runs AS (SELECT {label}, fold, c, sum(c) OVER (PARTITION BY {label} ORDER BY fold) AS hi FROM sizes)
, folded AS (SELECT r.* EXCLUDE (rk), CAST(s.fold AS INTEGER) AS fold FROM ranked r JOIN runs s
   ON r.{label} = s.{label} AND r.rk > s.hi - s.c AND r.rk <= s.hi)
"""
