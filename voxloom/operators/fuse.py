"""Fusing observations into cells: running means, prefix states, tombstones and epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.operators.tables import dense_ids, settle


def fuse(points: DataFrame, cell: list[str], sums: list[str], arrival: Column, bucket_bits: int) -> DataFrame:
    """One row for each cell: n, the sum of each column of `sums`, and gidx in order of first arrival.

    `arrival` is a bigint that grows with the order of arrival; cells that arrive together are ordered by
    their keys.  The points are scanned and folded once, with hash aggregation; the cells, far fewer, are
    kept and then numbered inside buckets of arrival >> bucket_bits.  Means are sums over n.
    """
    cells = points.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"sum_{c}") for c in sums), F.min(arrival).alias("__first"))
    keyed = settle(cells.withColumn("__bucket", F.shiftright("__first", bucket_bits)))
    return dense_ids(keyed, "__bucket", [F.col("__first"), *(F.col(c) for c in cell)]).drop("__first", "__bucket")


def as_of_frame(points: DataFrame, cell: list[str], frame: str, sums: list[str]) -> DataFrame:
    """The state of each cell at each frame in which it was seen: counts and sums of all frames so far."""
    per = points.groupBy(*cell, frame).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"sum_{c}") for c in sums))
    w = W.partitionBy(*cell).orderBy(frame).rowsBetween(W.unboundedPreceding, 0)
    return per.select(*cell, frame, F.sum("n").over(w).alias("n"), *(F.sum(f"sum_{c}").over(w).alias(f"sum_{c}") for c in sums))


def epochs(events: DataFrame, key: list[str], order: list[Column], kill: Column) -> DataFrame:
    """events with `epoch`: the kills up to and with each row.  A cell's state restarts after a kill."""
    w = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn("epoch", F.sum(F.when(kill, 1).otherwise(0)).over(w))


def last_epoch(events: DataFrame, key: list[str], order: list[Column], kill: Column, sums: list[str]) -> DataFrame:
    """State after all events: kills so far, whether the cell is alive, and what was fused since the last
    kill (0 for a dead cell)."""
    kept = epochs(events, key, order, kill).withColumn("__kill", F.coalesce(kill, F.lit(False)))
    top = kept.withColumn("__top", F.max("epoch").over(W.partitionBy(*key)))
    live = (F.col("epoch") == F.col("__top")) & ~F.col("__kill")
    return top.groupBy(*key).agg(
        F.max("epoch").alias("kills"),
        F.sum(F.when(live, 1).otherwise(0)).alias("n"),
        *(F.sum(F.when(live, F.col(c)).otherwise(0)).alias(f"sum_{c}") for c in sums),
    ).withColumn("alive", F.col("n") > 0)
