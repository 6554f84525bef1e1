"""Registered queries and their SQL.

query() rounds the columns named in `doubles` to six places in Spark and in
SQL alike, so that results can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def to_places(x: Column, places: int = 6) -> Column:
    return F.round(x, places) + F.lit(0.0)


def query(name: str, sql: str | None = None, doubles: str = "", places: int = 6, early: bool = False) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under a name, with its SQL if there is one; early: it has its doubles to_places() already, before it makes many rows of one."""
    names = doubles.split()

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out if early else out.withColumns({c: to_places(F.col(c), places) for c in names})

        QUERIES[name] = run
        if sql:
            rounded = ", ".join(f"round({c}::DOUBLE, {places}) + 0.0::DOUBLE AS {c}" for c in names)
            ORACLE_SQL[name] = f"SELECT * REPLACE ({rounded}) FROM ({sql})" if names else sql
        return f

    return add


for _part in ("sources", "panel", "indicators", "cross_section", "signals", "portfolio", "performance", "ledger", "studies", "extras", "chains"):
    import_module(f"panelforge.plans.{_part}_queries")
