"""Helpers on whole tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Only where that is unset, and driver and
    executors are one machine, a temporary folder of it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    have = sc.getCheckpointDir()
    if not named and not have and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not have:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="voxloom-checkpoint-"))
        have = sc.getCheckpointDir()
    return named or have


_made: list[list[str]] = []  # folders made inside each open cleared() block


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder, which goes when the session's JVM ends, or with cleared()."""
    path = f"{shared_dir(spark)}/voxloom-{uuid.uuid4().hex}"
    at, fs = _folder(spark, path)
    fs.mkdirs(at)  # only what exists can be marked
    fs.deleteOnExit(at)
    for block in _made:
        block.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _folder(spark, path)
    fs.delete(at, True)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """At the end, folders made inside are deleted: for work whose result is already written elsewhere."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            remove(spark, path)


def settle(df: DataFrame) -> DataFrame:
    """Compute once, write to a folder that all executors share, read back: cuts the lineage, survives lost
    executors, and keeps nothing on the driver."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dense_ids(df: DataFrame, bucket: str, order: list[Column], name: str = "gidx") -> DataFrame:
    """df with consecutive ids from 0 in the order of (bucket, *order), without a global sort.

    Rows are numbered inside their bucket; the buckets' offsets come from their counts, so `bucket`
    should have many values, few against the rows (a day, a range of a leading key).
    """
    counts = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy(F.col(bucket).asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col(bucket).alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = df.withColumn("__r", F.row_number().over(W.partitionBy(bucket).orderBy(*order)))
    return inside.join(offsets, inside[bucket].eqNullSafe(offsets["__b"])).withColumn(name, F.col("__off") + F.col("__r") - 1).drop("__b", "__off", "__r")


def top1(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("__rank = 1").drop("__rank")


HOT_ROWS = 50_000  # rows of one key that a task of a join may have
HOT_SHARE = 1000  # a key is hot from one row in so many, so there are at most so many hot keys


def hot_keys(df: DataFrame, key: str, least: int = HOT_ROWS) -> DataFrame | None:
    """The keys of a table with more than `least` rows and a thousandth of all, so at most HOT_SHARE; None if there are none."""
    n = df.count()
    if n <= least:
        return None
    often = settle(df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where((F.col("__n") * HOT_SHARE >= n) & (F.col("__n") > least)).select(key))
    return None if often.isEmpty() else often


def join_split(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """left joined (inner or left) with right, which has each key once.  Rows of left with a key of hot_keys(left)
    stay where they are, and the rows of right for those keys, one for each, are broadcast to them."""
    if hot is None:
        return left.join(right, key, how)
    hot = F.broadcast(hot)
    few = F.broadcast(right.join(hot, key, "left_semi"))
    return left.join(hot, key, "left_semi").join(few, key, how).unionByName(left.join(hot, key, "left_anti").join(right, key, how))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): connected components by least label with pointer jumping; kept in the shared folder.  The
    edges of a hub and the nodes of a large component are not brought together in one task."""
    both = settle(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).unionByName(edges.select(F.col(b).alias("a"), F.col(a).alias("b"))).distinct())
    hubs, many = hot_keys(both, "b"), both.count() > HOT_ROWS
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")))
    while True:
        near = join_split(both, labels.withColumnRenamed("node", "b"), "b", hubs).groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        large = None
        if many:
            step = settle(step)
            large = hot_keys(step, "comp")
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("jump"))
        new = settle(join_split(step, up, "comp", large, "left").select("node", "old", F.least("comp", F.coalesce("jump", "comp")).alias("comp")))
        labels = new.select("node", "comp")
        if not new.where("comp <> old").limit(1).count():
            return labels
