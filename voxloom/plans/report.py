"""What a run has made: tallies, timings, and its tables on disk."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.plans.pipeline import Result


class Profile:
    """Total and mean milliseconds and calls by step."""

    def __init__(self) -> None:
        self.steps: dict[str, list[float]] = {}

    @contextmanager
    def step(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.steps.setdefault(name, []).append((time.perf_counter() - began) * 1000)

    def table(self, spark, wall_ms: float | None = None) -> DataFrame:
        whole = wall_ms or sum(map(sum, self.steps.values())) or 1.0
        rows = [(k, sum(v), len(v), sum(v) / len(v), 100 * sum(v) / whole) for k, v in self.steps.items()]
        return spark.createDataFrame(rows, "step string, total_ms double, calls int, mean_ms double, percent double")


def tallies(result: Result, vocab: DataFrame) -> DataFrame:
    """(tier, kind, name, n): points, proposals and objects by class, with totals where name is null."""
    v = vocab
    points = result.points.where("alive").join(v, "class_id", "left").select(F.lit("points").alias("tier"), "kind", "name")
    props = result.proposals.select("run", "frame", "prop", F.col("cls").alias("class_id")).distinct().join(v, "class_id").select(F.lit("proposals").alias("tier"), "kind", "name")
    objs = result.components.where("promoted").select(F.col("cls").alias("class_id")).join(v, "class_id").select(F.lit("objects").alias("tier"), "kind", "name")
    rows = points.unionByName(props).unionByName(objs)
    return rows.groupBy("tier", "kind", "name").agg(F.count(F.lit(1)).alias("n")).unionByName(rows.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).select("tier", F.lit(None).cast("int").alias("kind"), F.lit(None).cast("string").alias("name"), "n"))


def capture_seconds(frames: DataFrame) -> DataFrame:
    """frames with the seconds since the first of their run, and the distance of image and scan."""
    from pyspark.sql import Window as W

    from voxloom.functions.timeconv import seconds_since

    return frames.select("*", seconds_since(F.col("t"), F.min("t").over(W.partitionBy("run"))).alias("capture_secs"), seconds_since(F.col("t"), F.col("scan_t")).alias("scan_dt"))


def save(result: Result, folder: str) -> None:
    """Every tier as Parquet under `folder`, and the labelled cloud's columns as points_labelled."""
    for name in ("frames", "points", "shell", "proposals", "components", "members", "objects"):
        getattr(result, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    labelled_cloud(result.points).write.mode("overwrite").parquet(f"{folder}/points_labelled")


def labelled_cloud(points: DataFrame) -> DataFrame:
    """(x, y, z, label) of the points that are alive; label is the class id plus one, 0 for none."""
    from voxloom.functions.ids import export_label

    return points.where("alive").select(*(F.col(c).cast("float").alias(c) for c in "xyz"), export_label(F.col("class_id")).cast("int").alias("label"))
