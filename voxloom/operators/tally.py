"""Totals by class and kind, and figures on over-segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators.project import neighbour_pixels
from voxloom.operators.tables import components, settle


def by_kind(rows: DataFrame, kind: str, cls: str) -> DataFrame:
    """Counts by kind and class with totals: level 0 a class, 1 a kind, 3 all."""
    return rows.rollup(kind, cls).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level")).select(kind, cls, "n", F.col("level").cast("int").alias("level"))


def segmentation(rows: DataFrame, frame: str, cls: str, instance: str) -> DataFrame:
    """(class, frames, mean_ids): in how many frames a class is seen, and with how many ids on average."""
    per = rows.groupBy(frame, cls).agg(F.countDistinct(instance).alias("ids"))
    return per.groupBy(cls).agg(F.count(F.lit(1)).alias("frames"), (F.sum("ids") / F.count(F.lit(1))).alias("mean_ids"))


def oversegmentation(pixels: DataFrame, frame: list[str], u: str, v: str, cls: str) -> DataFrame:
    """One row about ids that split what is one thing: frames, mean_ids (ids of a class in a frame that has it),
    touching (frames in which two ids of one class touch), touching_share, ids, groups (ids united where
    they touch, over all frames) and ids_per_group.

    pixels(frame..., u, v, id, class): the labelled pixels of things; touching is in four directions, an id keeps its class
    inside a frame.  Without pixels all figures are 0.
    """
    px = settle(pixels.select(*frame, u, v, "id", cls))
    near = neighbour_pixels(px, frame, u, v).where("id1 <> id2")
    kind = px.select(*frame, "id", cls).distinct()
    a, b = (kind.select(*frame, F.col("id").alias(f"id{k}"), F.col(cls).alias(f"c{k}")) for k in (1, 2))
    pairs = settle(near.select(*frame, "id1", "id2").distinct().join(a, [*frame, "id1"]).join(b, [*frame, "id2"]).where("c1 = c2"))
    labels = components(pairs.select(F.col("id1").alias("a"), F.col("id2").alias("b")))
    every = px.select("id").distinct().join(labels.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
    groups = every.agg(F.count(F.lit(1)).alias("ids"), F.countDistinct("comp").alias("groups"))
    means = kind.groupBy(*frame, cls).agg(F.count(F.lit(1)).alias("n")).agg((F.sum("n") / F.count(F.lit(1))).alias("mean_ids"))
    seen = kind.select(*frame).distinct().agg(F.count(F.lit(1)).alias("frames"))
    touching = pairs.select(*frame).distinct().agg(F.count(F.lit(1)).alias("touching"))
    one = seen.withColumn("__one", F.lit(1))
    for figures in (touching, means, groups):  # one row each
        one = one.join(figures.withColumn("__one", F.lit(1)), "__one")
    share = lambda n, d: F.when(F.col(d) > 0, F.col(n).cast("double") / F.col(d)).otherwise(F.lit(0.0))
    return one.select("frames", F.coalesce("mean_ids", F.lit(0.0)).alias("mean_ids"), "touching", share("touching", "frames").alias("touching_share"), "ids", "groups", share("ids", "groups").alias("ids_per_group"))


def segments(rows: DataFrame, segment: list[str], cls: str, least: float) -> DataFrame:
    """(segment..., n, class_id, best, confidence): the majority class (ties: the lower) of each segment,
    null if it has less than the share `least` of all members."""
    n = rows.groupBy(*segment, cls).agg(F.count(F.lit(1)).alias("n"))
    s = n.groupBy(*segment).agg(F.sum("n").alias("n"), F.max(F.struct(F.col("n").alias("k"), (-F.col(cls)).alias("neg"))).alias("m"))
    return s.select(*segment, "n", F.when(F.col("m.k") >= F.lit(least) * F.col("n"), -F.col("m.neg")).alias("class_id"), F.col("m.k").alias("best"), (F.col("m.k") / F.col("n")).alias("confidence"))
