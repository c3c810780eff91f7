"""Trajectories derived from the events table, for queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same derivation in SQL, as a common table expression.
SQL = """tracks AS (SELECT event_id, epoch_ns(ts)::BIGINT AS total_nanos, user_id AS idx,
  CASE WHEN user_id % 4 = 0 THEN 3 ELSE 2 END::BIGINT AS type,
  CASE WHEN user_id % 4 = 0 THEN -1 ELSE user_id % 5 END::BIGINT AS role,
  CASE WHEN user_id % 4 = 0 THEN -1 ELSE user_id % 7 END::BIGINT AS subtype,
  round(value - 100 * floor(value / 100), 2) AS x, (user_id % 10) * 3.0e0 + (event_id % 7) * 0.5e0 AS y, 0.0e0 AS z,
  (event_id % 5) * 1.0e0 AS vel_x, (event_id % 3) * 0.0e0 AS vel_y, 0.0e0 AS vel_z, (event_id % 4) * 0.5e0 AS acc_x, (event_id % 3) * 0.5e0 AS acc_y, 0.0e0 AS acc_z,
  4.0e0 + (user_id % 3) * 0.5e0 AS length, 1.8e0 + (user_id % 2) * 0.2e0 AS width, 1.5e0 AS height, 0.0e0 AS roll, 0.0e0 AS pitch, ((event_id % 628) / 100.0e0) - 3.14e0 AS yaw
  FROM events)"""


def tracks_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each user and event time: users are objects, the rest follows from the ids."""
    e, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    walker = u % 4 == 0
    zero = F.lit(0.0)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("total_nanos"), u.alias("idx"),
        F.when(walker, 3).otherwise(2).cast("long").alias("type"), F.when(walker, -1).otherwise(u % 5).cast("long").alias("role"), F.when(walker, -1).otherwise(u % 7).cast("long").alias("subtype"),
        F.round(v - 100 * F.floor(v / 100), 2).alias("x"), ((u % 10) * 3.0 + (e % 7) * 0.5).alias("y"), zero.alias("z"),
        ((e % 5) * 1.0).alias("vel_x"), ((e % 3) * 0.0).alias("vel_y"), zero.alias("vel_z"), ((e % 4) * 0.5).alias("acc_x"), ((e % 3) * 0.5).alias("acc_y"), zero.alias("acc_z"),
        (4.0 + (u % 3) * 0.5).alias("length"), (1.8 + (u % 2) * 0.2).alias("width"), F.lit(1.5).alias("height"), zero.alias("roll"), zero.alias("pitch"), ((e % 628) / 100.0 - 3.14).alias("yaw"),
    )
