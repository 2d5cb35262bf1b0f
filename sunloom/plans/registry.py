"""Registration of named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as sensor rows: ts, loc, ghi (some null), clear (sky), bg and raw (indices)."""
    e = read(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts", F.col("event_type").alias("loc"), F.col("user_id"), "value",
        F.when(F.col("event_id") % 11 != 3, F.col("value") * 2.0).alias("ghi"),
        (20 + 10 * (F.col("event_id") % 97)).cast("double").alias("clear"),
        (F.col("user_id") % 13).cast("double").alias("k13"), (F.col("value") * F.lit(0.004)).alias("raw"), ((F.col("event_id") % 29) / F.lit(20.0)).alias("bg"),
    )


OBS = """
obs AS (
  SELECT event_id, ts, event_type AS loc, user_id, value, CASE WHEN event_id % 11 <> 3 THEN value * 2e0 END AS ghi,
         CAST(20 + 10 * (event_id % 97) AS DOUBLE) AS clear, CAST(user_id % 13 AS DOUBLE) AS k13, value * 4e-3 AS raw, CAST(event_id % 29 AS DOUBLE) / 2e1 AS bg
  FROM events)
"""


def places(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """supplier or customer as places in the domain's box: id, lat, lon."""
    key = {"supplier": "s_suppkey", "customer": "c_custkey"}[name]
    k = F.col(key)
    return read(spark, sf_dir, name).select(k.alias("id"), (F.lit(46.56) + F.lit(0.26) * (k % 97) / F.lit(96.0)).alias("lat"), (F.lit(-119.29) + F.lit(0.24) * (k % 89) / F.lit(88.0)).alias("lon"))


PLACES = """
sources AS (SELECT s_suppkey AS id, 46.56e0 + 0.26e0 * (s_suppkey % 97) / 96e0 AS lat, -119.29e0 + 0.24e0 * (s_suppkey % 89) / 88e0 AS lon FROM supplier),
targets AS (SELECT c_custkey AS id, 46.56e0 + 0.26e0 * (c_custkey % 97) / 96e0 AS lat, -119.29e0 + 0.24e0 * (c_custkey % 89) / 88e0 AS lon FROM customer)
"""
KM = "sqrt(((t.lat - s.lat) * 111e0) * ((t.lat - s.lat) * 111e0) + ((t.lon - s.lon) * 75.8e0) * ((t.lon - s.lon) * 75.8e0))"
