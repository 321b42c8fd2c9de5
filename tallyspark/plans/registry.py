"""Registry of the reconciliation queries: each has its Spark form and, where SQL can express it, a DuckDB oracle."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, dates: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query. Columns named in ``dates`` are compared as text."""

    def put(f: Query) -> Query:
        _QUERIES[name] = (lambda spark, sf_dir: _dates_as_text(f(spark, sf_dir), dates)) if dates else f
        if sql is not None:
            _ORACLES[name] = f"SELECT * REPLACE ({', '.join(f'{d}::DATE::VARCHAR AS {d}' for d in dates)}) FROM ({sql})" if dates else sql
        return f

    return put


def _dates_as_text(df: DataFrame, dates: tuple[str, ...]) -> DataFrame:
    return df.withColumns({d: df[d].cast("date").cast("string") for d in dates})


def _load() -> None:
    from . import cycle_queries, function_queries, report_queries, rule_queries, rule_table_queries, store_queries, stream_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sync cycle: landed pages normalised, known references dropped, rules matched; counters by account."""
    _load()
    return _QUERIES["sync_cycle"](spark, sf_dir)
