"""Query catalog: one Spark callable (spark, sf_dir) -> DataFrame per operator,
plus, where the operator is SQL-expressible, an independent DuckDB SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.functions.exprs import round_doubles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def register(name: str, sql: str | None = None, rounded: bool = True):
    """Decorator: add ``fn(spark, sf_dir)`` under ``name`` (and its SQL)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from ledgerlens.session import checkpoint_dir, ship_package
            ship_package(spark)
            checkpoint_dir(spark)
            df = fn(spark, sf_dir)
            return round_doubles(df, DIGITS) if rounded else df
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco
