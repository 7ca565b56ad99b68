"""All queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import analytics_queries, code_queries, graph_queries, search_queries, stream_queries, text_queries  # noqa: F401 - they register themselves
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities within the budget of one order, nearest first, cut to 60."""
    return graph_queries.slice_cap(spark, sf_dir)
