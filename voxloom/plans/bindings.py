"""Columns of the provided tables in the roles of points, poses, votes and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as points: an integral cell (cx, cy, cz), integral values, the arrival day and order."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.floor(F.col("l_quantity") / 5).cast("int").alias("cx"),
        F.floor(F.col("l_extendedprice") / 5000).cast("int").alias("cy"),
        F.floor(cents("l_discount") / 2).cast("int").alias("cz"),
        F.col("l_quantity").cast("long").alias("q"),
        cents("l_extendedprice").alias("price"),
        cents("l_discount").alias("disc"),
        cents("l_tax").alias("tax"),
        F.unix_date(F.to_date("l_shipdate")).alias("day"),
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
    )


#: Order of arrival as one number: day, order, line.  It is not unique; rows that share it arrive together.
ARRIVAL_BITS = 44


def arrival() -> Column:
    return F.shiftleft(F.col("day").cast("long"), ARRIVAL_BITS) + F.col("ok") * 8 + F.col("ln").cast("long")


POINTS_SQL = """
pts AS (
  SELECT floor(l_quantity / 5)::INT AS cx, floor(l_extendedprice / 5000)::INT AS cy,
         floor(round(l_discount * 100)::BIGINT / 2)::INT AS cz, l_quantity::BIGINT AS q,
         round(l_extendedprice * 100)::BIGINT AS price, round(l_discount * 100)::BIGINT AS disc,
         round(l_tax * 100)::BIGINT AS tax, date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::INT AS day,
         l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk,
         l_returnflag AS flag, l_linestatus AS status
  FROM lineitem
)
"""

SEQ_SQL = "seq AS (SELECT *, day::BIGINT * 17592186044416 + ok * 8 + ln AS seq FROM pts)"


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with their time in microseconds and their value in whole cents."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"), "ts")


MOMENTS_SQL = """
ev AS (
  SELECT event_id, user_id, epoch_us(ts)::BIGINT AS us, event_type, round(value * 100)::BIGINT AS cents, ts FROM events
)
"""
