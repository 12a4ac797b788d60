"""Every registered query: a function of (spark, sf_dir) and, where SQL can express it, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, run: Query, sql: str | None = None) -> None:
    """Add one query; a name can be taken once."""
    if name in _QUERIES:
        raise ValueError(f"query {name} is registered twice")
    _QUERIES[name] = lambda spark, sf_dir: _dates_as_text(run(spark, sf_dir))
    if sql is not None:
        _SQL[name] = sql


def _dates_as_text(df: DataFrame) -> DataFrame:
    """Dates go out as yyyy-MM-dd, so that engines that return them in different types agree."""
    return df.withColumns({c: df[c].cast("string") for c, kind in df.dtypes if kind == "date"})


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
