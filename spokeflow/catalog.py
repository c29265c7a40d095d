"""All queries of the sensor engine, by name, with the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spokeflow.queries import QUERIES, SQL, Query
from spokeflow.queries import clusters, frames, live, models, tables, time  # noqa: F401  they register themselves


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["aligned_bins"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
