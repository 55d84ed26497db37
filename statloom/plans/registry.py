"""Query registry and the small helpers queries share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions.numeric import round_half_even
from statloom.plans import bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; @table in its SQL stands for a binding's SELECT."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = expand(sql)
        return fn

    return add


def expand(sql: str) -> str:
    done = re.sub(r"@(\w+)", lambda m: f"({bindings.select_sql(m.group(1))})", sql)
    return expand(done) if "@" in done else done


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return bindings.frame(spark, folder, name)


def r6(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Rounded outputs, so that the order of additions does not show; adding 0.0 turns -0.0 into 0.0."""
    return df.withColumns({c: round_half_even(F.col(c).cast("double"), digits) + F.lit(0.0) for c in columns})


def r6_sql(expr: str, digits: int = 6) -> str:
    return f"(round_even(CAST({expr} AS DOUBLE) * 1e{digits}, 0) / 1e{digits} + 0.0)"


def pct_rank_sql(v: str, part: str) -> str:
    return (
        f"(CASE WHEN count({v}) OVER (PARTITION BY {part}) <= 1 THEN 0e0 WHEN {v} IS NULL THEN NULL ELSE "
        f"(rank() OVER (PARTITION BY {part} ORDER BY {v} NULLS LAST) + (count(*) OVER (PARTITION BY {part}, {v}) - 1) / 2e0 - 1)"
        f" / (count({v}) OVER (PARTITION BY {part}) - 1) END)"
    )


def strict_sql(v: str, part: str, lower_better: bool = False) -> str:
    p = f"(rank() OVER (PARTITION BY {part} ORDER BY {v} NULLS LAST) - 1) / count({v}) OVER (PARTITION BY {part}) * 100e0"
    if lower_better:
        p = f"(100e0 - {p})"
    return f"(CASE WHEN {v} IS NULL THEN NULL ELSE round_even(({p}) * 10, 0) / 10 END)"


def half_up_sql(expr: str, digits: int) -> str:
    return f"(floor(round_even(({expr}) * 1e{digits} * 1e6, 0) / 1e6 + 0.5) / 1e{digits})"


def half_even_sql(expr: str, digits: int) -> str:
    return f"(round_even(CAST(({expr}) AS DOUBLE) * 1e{digits}, 0) / 1e{digits})"
