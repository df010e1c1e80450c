"""Query registry and small SQL text helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cleanloom.functions.text import NUMERIC_BODY, NUMERIC_LOOK, PLAIN_NUMBER

# White space as a regular-expression class for the SQL side.
SPACE_CHARS = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
TRIM_PATTERN = f"^[{SPACE_CHARS}]+|[{SPACE_CHARS}]+$"
CURRENCY_PATTERN = f"[$,€£%{SPACE_CHARS}]"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = " ".join(sql.split("\n")) if "--" not in sql else sql
        return fn

    return register


def half_up(x: str, digits: int) -> str:
    scale = f"{10 ** digits}.0::DOUBLE"
    return f"(floor(({x})::DOUBLE * {scale} + 0.5) / {scale})"


def percent(part: str, whole: str) -> str:
    return f"coalesce(floor(({part})::DOUBLE / nullif(({whole})::DOUBLE, 0) * 1000.0::DOUBLE + 0.5) / 10.0::DOUBLE, 0.0::DOUBLE)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '{TRIM_PATTERN}', '', 'g')"


def to_numeric(x: str) -> str:
    bare = f"regexp_replace({x}, '{CURRENCY_PATTERN}', '', 'g')"
    return f"(CASE WHEN regexp_matches({bare}, '{PLAIN_NUMBER}') THEN try_cast({bare} AS DOUBLE) END)"


def numeric_like(x: str) -> str:
    t = strip(x)
    body = f"regexp_replace({t}, ',', '', 'g')"
    return (f"coalesce(regexp_matches({t}, '{NUMERIC_LOOK}') AND regexp_matches({body}, '{NUMERIC_BODY}') AND NOT {null_token(x)}, false)")


def null_token(x: str) -> str:
    return f"(lower({strip(x)}) IN ('', 'na', 'n/a', 'null', 'none', 'nan', '-'))"


def number_text(x: str) -> str:
    return f"regexp_replace(CAST(CAST({x} AS DECIMAL(38,6)) AS VARCHAR), '\\.?0+$', '')"


def plain(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"
