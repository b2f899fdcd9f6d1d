"""The library's own queries, by name, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import queries as Q
from . import record_queries, source_queries, text_queries  # noqa: F401  they register their queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the price check by month of the order."""
    return Q.q09b_verdicts_by_month(spark, sf_dir)


def queries() -> dict:
    return dict(Q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(Q.SQL)
