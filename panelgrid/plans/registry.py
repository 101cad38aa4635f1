"""Query registry: a name, a builder over the bound tables, and the equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelgrid.plans.binding import Bound, with_bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a builder taking `Bound`; `sql` may use any binding name as a table."""

    def wrap(build: Callable[[Bound], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Bound(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_bindings(sql)
        return build

    return wrap


def rd(expr: str, digits: int = 9) -> str:
    """SQL text that rounds half up on the decimal value, as Spark's round does."""
    return f"CAST(round(CAST({expr} AS DECIMAL(30,{min(digits + 6, 16)})),{digits}) AS DOUBLE)"
