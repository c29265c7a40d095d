"""Registered queries: each operator on the tables at hand, beside SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sensor samples: user_id is the run, event_type the channel, t the time in seconds."""
    e = table(spark, sf_dir, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return e.select("event_id", "user_id", "event_type", "value", t.alias("t"), "ts", "props")


def r6(x: Column | str) -> Column:
    """Rounded for comparison; adding zero makes a negative zero positive."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


#: The same rows in SQL.
EV = "(SELECT event_id, user_id, event_type, value, epoch_us(ts)::DOUBLE / 1e6 AS t, ts, props FROM events)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames of 4 rows and 16 columns: t is vec_id, p the value times 1000, the hub moves with t."""
    e = table(spark, sf_dir, "embeddings")
    cells = e.select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return cells.select(
        (F.col("vec_id") % 7).alias("run"), F.col("vec_id").alias("t"), F.expr("i div 16").cast("int").alias("row"), (F.col("i") % 16).alias("col"),
        (F.col("v").cast("double") * 1000).alias("p"), (F.col("vec_id") % 16).cast("int").alias("hub"),
    )


PX = """(SELECT vec_id % 7 AS run, vec_id AS t, (i // 16)::INT AS "row", (i % 16)::INT AS col, embedding[i + 1]::DOUBLE * 1000 AS p, (vec_id % 16)::INT AS hub
  FROM embeddings, range(64) r(i))"""
