"""Registry of queries and their SQL, and the SQL building blocks they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, sql: str, *deps: str) -> None:
    CTES[name] = (list(deps), sql)


def with_ctes(body: str, deps: list[str]) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for d in CTES[name][0]:
            visit(d)
        order.append(name)

    for d in deps:
        visit(d)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + body


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles, so that both engines agree on the last digits; -0.0 becomes 0.0."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def rounded(body: str, cols: list[str], digits: int = 6) -> str:
    if not cols:
        return body
    items = ", ".join(f'round("{c}", {digits}) + 0e0 AS "{c}"' for c in cols)
    return f"SELECT * REPLACE ({items}) FROM ({body}) AS body"


def query(name: str, sql: str | None = None, deps: list[str] = (), round_cols: list[str] = ()):
    """Register `fn(tables) -> DataFrame` under `name`, with its SQL if there is one."""

    def wrap(fn):
        from workload.standins import Tables

        QUERIES[name] = lambda spark, sf_dir: tidy(fn(Tables(spark, sf_dir)))
        QUERIES[name].__name__ = name
        if sql is not None:
            ORACLE[name] = with_ctes(rounded(sql, list(round_cols)), list(deps))
        return fn

    return wrap
