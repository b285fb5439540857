"""The registry of queries and of their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import ship
from .sources import adapters as views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
Build = Callable[[SparkSession, str], DataFrame]


def query(tables: str | None = None, sql: str | None = None, rounds: str = "", rounded: bool = False) -> Callable[[Build], Build]:
    """Registers a query under its function's name. tables: SQL views that sql needs; rounds: doubles compared to 6 places (rounded: it does so itself)."""

    def register(build: Build) -> Build:
        @wraps(build)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            df = build(spark, sf_dir)
            return df.withColumns({c: F.round(c, 6) for c in rounds.split()}) if rounds and not rounded else df

        QUERIES[build.__name__] = run
        if sql is not None:
            body = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in rounds.split())}) FROM ({sql})" if rounds else sql
            SQL[build.__name__] = views.with_views(tables, body) if tables else body
        return run

    return register
