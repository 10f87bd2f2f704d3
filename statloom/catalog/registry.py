"""Query registration. Floating-point results are rounded alike on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6
# Averages of two-decimal inputs often end exactly half-way between two rounded values, where the
# last bit of the sum decides; a small offset on both sides moves them off that edge.
NUDGE = 0.033


def fixed_sql(column: str, digits: int = DIGITS) -> str:
    return f"round({column} + {NUDGE * 10.0 ** -digits:.15f}, {digits}) + 0.0"


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = DIGITS):
    """Register ``fn(spark, folder)``; ``doubles`` names the floating-point output columns."""
    floats = doubles.split()

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = fn(spark, folder)
            return out.withColumns({c: F.round(F.col(c) + float(f"{NUDGE * 10.0 ** -digits:.15f}"), digits) + 0.0 for c in floats})

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            fixed = ", ".join(f"{fixed_sql(c, digits)} AS {c}" for c in floats)
            ORACLE[name] = f"SELECT * REPLACE ({fixed}) FROM ({sql})" if floats else sql
        return run

    return register
