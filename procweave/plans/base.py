"""Query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it on whole tables, its oracle."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# SQL fragments shared by the oracles.
def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sql_squeeze(x: str) -> str:
    return f"regexp_replace({sql_strip(x)}, '\\s+', ' ', 'g')"


def sql_norm(x: str) -> str:
    return f"lower({sql_squeeze(x)})"


def sql_compact(x: str) -> str:
    return f"lower(regexp_replace({x}, '\\s+', '', 'g'))"


def sql_tokens(x: str) -> str:
    words = f"list_filter(regexp_split_to_array({sql_norm(x)}, '[^0-9a-zA-Z가-힣]+'), lambda t: length(t) >= 2)"
    return (
        f"list_distinct(CASE WHEN length({sql_compact(x)}) >= 3 "
        f"THEN list_append({words}, {sql_compact(x)}) ELSE {words} END)"
    )


def sql_grams(x: str) -> str:
    """Distinct trigrams; characters are split once, since substring walks a long text from its start."""
    c = sql_compact(x)
    ch = f"string_split({c}, '')"
    return (
        f"CASE WHEN {c} = '' THEN []::VARCHAR[] WHEN length({c}) < 3 THEN [{c}] "
        f"ELSE list_distinct(list_transform(list_zip({ch}, {ch}[2:], {ch}[3:]), lambda z: z[1] || z[2] || z[3])) END"
    )


def sql_heading_level(x: str) -> str:
    from procweave.functions import fixed

    whens = " ".join(f"WHEN regexp_matches({x}, '{p}') THEN {lv}" for lv, p in fixed.HEADING_PATTERNS)
    return f"CASE {whens} END"
