"""Registered queries and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with DuckDB SQL for its rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def literal(v) -> str:
    """A value as SQL."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"{v!r}::double"
    return "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" if isinstance(v, str) else str(v)


def stated(rows: list[tuple], columns: str) -> str:
    """SQL: each document's stated case, all documents dealt over the cases."""
    values = ", ".join("(" + ", ".join(literal(v) for v in (k, *r)) + ")" for k, r in enumerate(rows))
    return f"select doc_id, {', '.join('t.' + c.strip() for c in columns.split(','))} from documents join (values {values}) t(k, {columns}) on k = doc_id % {len(rows)}"


def cases(spark: SparkSession, sf: str, rows: list[tuple], names: list[str]) -> DataFrame:
    """doc_id and the first columns, called ``names``, of each document's case."""
    nth = (F.col("doc_id") % len(rows) + 1).cast("int")
    return table(spark, sf, "documents").select("doc_id", *[F.element_at(F.array(*[F.lit(r[k]) for r in rows]), nth).alias(n) for k, n in enumerate(names)])
