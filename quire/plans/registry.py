"""Named queries over the input tables and their DuckDB oracle SQL.

A query is a function ``(spark, sf_dir) -> DataFrame``.  The optional
oracle is an ANSI/DuckDB SQL string over the same tables, with the same
column names, used by the correctness gate.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query (and its oracle SQL, when one exists)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return deco


# DuckDB spellings of the character classes used by the Spark code.
D_WS_CLASS = r"\x09-\x0d\x1c-\x1f\x{85}\p{Z}"
D_WS = f"[{D_WS_CLASS}]"
D_NW = rf"[^\p{{L}}\p{{N}}_{D_WS_CLASS}]"
D_NWORD = r"[^\p{L}\p{N}_]"


def d_clean(expr: str) -> str:
    """DuckDB twin of ``quire.functions.text.clean_text``."""
    out = f"lower(regexp_replace(regexp_replace({expr}, '{D_WS}+', ' ', 'g'), '{D_NW}', '', 'g'))"
    for src, dst in (("can''t", "cannot"), ("won''t", "will not")):
        out = f"regexp_replace({out}, '(^|{D_NWORD}){src}({D_NWORD}|$)', '\\1{dst}\\2', 'g')"
    return out


def d_tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{D_WS}+'), lambda t: t <> '')"


def d_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '\\A{D_WS}+|{D_WS}+\\z', '', 'g')"


def sql_lit(s: str) -> str:
    """A DuckDB string literal (newlines kept as they are)."""
    return "'" + s.replace("'", "''") + "'"


def d_template(template: str, **fields: str) -> str:
    """DuckDB twin of ``render_template``: literals and expressions concatenated."""
    from quire.functions.text import template_parts

    pieces = []
    for literal, field in template_parts(template):
        if literal:
            pieces.append(sql_lit(literal))
        if field is not None:
            pieces.append(f"({fields[field]})")
    return "(" + " || ".join(pieces) + ")" if pieces else "''"
