"""Registered queries: each pairs a Spark callable with equivalent DuckDB SQL on the same tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalog.domain import Domain, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FUNCTIONS: dict[str, Callable[[Domain], DataFrame]] = {}

MODULES = [
    "activity", "sessions", "players", "retention", "samples", "combat", "network", "worlds", "metrics",
    "series", "segments", "tables", "reports", "kpis", "quality", "io", "streams",
]


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register ``fn(domain) -> DataFrame``; ``doubles`` names result columns compared after rounding."""

    def register(fn: Callable[[Domain], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from pyspark.sql import functions as F

            spark.conf.set("spark.sql.session.timeZone", "UTC")
            out = fn(Domain(spark, sf_dir))
            # Adding 0.0 turns a negative zero into zero.
            return out.withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in doubles.split()}) if doubles else out

        QUERIES[name] = run
        FUNCTIONS[name] = fn
        if sql is not None:
            body = sql
            if doubles:
                rounded = ", ".join(f"round({c}, 6)+0.0::double as {c}" for c in doubles.split())
                body = f"select * replace ({rounded}) from (\n{sql}\n) r"
            ORACLES[name] = with_views(body)
        return fn

    return register


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"catalog.{module}")
