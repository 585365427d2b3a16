"""Overlaps of sets: affinities, containment, contested members, set and mask operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators.contain import shared
from voxloom.operators.tables import top1


def sizes(members: DataFrame, set_id: str, on: list[str], name: str) -> DataFrame:
    return members.select(set_id, *on).distinct().groupBy(set_id).agg(F.count(F.lit(1)).alias(name))


def histograms(members: DataFrame, set_id: str, cls: str, name: str) -> DataFrame:
    """(set, name): the classes of each set's members with their counts, as a map as small as there are
    classes."""
    n = members.groupBy(set_id, cls).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(set_id).agg(F.map_from_entries(F.collect_list(F.struct(cls, "n"))).alias(name))


def map_dot(a: Column, b: Column) -> Column:
    """The sum of products of two maps' values at the keys they share."""
    return F.aggregate(F.map_entries(a), F.lit(0).cast("long"), lambda s, e: s + e["value"] * F.coalesce(F.element_at(b, e["key"]), F.lit(0)))


def affinity(shared_: Column, size: Column, ab: Column, aa: Column, bb: Column) -> Column:
    """Containment times cosine; 0 for an empty histogram."""
    norm = F.sqrt(aa.cast("double")) * F.sqrt(bb.cast("double"))
    return shared_.cast("double") / size.cast("double") * F.when(norm > 0, ab.cast("double") / norm).otherwise(F.lit(0.0))


def containment(shared_: Column, size_a: Column, size_b: Column) -> Column:
    """Shared elements over those of the smaller set."""
    return shared_.cast("double") / F.least(size_a, size_b).cast("double")


def level_bar(bars: list[float], level: Column) -> Column:
    """The threshold of a level, the last for all higher ones; 0.3 without thresholds."""
    if not bars:
        return F.lit(0.3)
    return F.element_at(F.lit(bars), F.least(F.greatest(level, F.lit(1)), F.lit(len(bars))).cast("int"))


def winners(claims: DataFrame, element: list[str], order: list[Column]) -> DataFrame:
    """The claim that keeps each contested element."""
    return top1(claims, element, order)


def unowned(members: DataFrame, owned: DataFrame, on: list[str]) -> DataFrame:
    return members.join(owned.select(*on).distinct(), on, "left_anti")


def attach(signs: DataFrame, objects: DataFrame, on: list[str]) -> DataFrame:
    """(object, text, overlap): each sign goes to the object that shares most of its elements (ties: the
    larger object, then the lower id); an object with several keeps the one with the largest overlap,
    the earliest of equals.  signs(sign, text, elements), objects(object, elements)."""
    pairs = shared(signs, objects, "sign", "object", on).join(sizes(objects, "object", on, "size"), "object")
    best = top1(pairs, ["sign"], [F.col("shared").desc(), F.col("size").desc(), F.col("object")])
    kept = top1(best, ["object"], [F.col("shared").desc(), F.col("sign")])
    return kept.join(signs.select("sign", "text").distinct(), "sign").select("object", "text", F.col("shared").alias("overlap"))


def same_raster(a: tuple[int, int], b: tuple[int, int]) -> None:
    """Masks of rasters of different sizes have no common pixels: an error."""
    if tuple(a) != tuple(b):
        raise ValueError(f"masks of {a[0]} x {a[1]} and {b[0]} x {b[1]} pixels")


def mask_and(a: DataFrame, b: DataFrame, size_a: tuple[int, int] = (0, 0), size_b: tuple[int, int] = (0, 0)) -> DataFrame:
    same_raster(size_a, size_b)
    return a.select("u", "v").intersect(b.select("u", "v"))


def mask_or(a: DataFrame, b: DataFrame, size_a: tuple[int, int] = (0, 0), size_b: tuple[int, int] = (0, 0)) -> DataFrame:
    same_raster(size_a, size_b)
    return a.select("u", "v").union(b.select("u", "v")).distinct()


def keep_left(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of both, one for each element: where both have it, that of a."""
    return a.unionByName(b.join(a.select(*on).distinct(), on, "left_anti"))


def mask_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("u", "v").subtract(b.select("u", "v"))


def dilate(a: DataFrame, radius: int, width: int, height: int, four: bool = False) -> DataFrame:
    """Pixels within `radius` of the mask (square; with `four` the diamond), inside the raster."""
    d = F.sequence(F.lit(-radius), F.lit(radius))
    near = a.select("u", "v").distinct().withColumn("du", F.explode(d)).withColumn("dv", F.explode(d))
    if four:
        near = near.where(F.abs("du") + F.abs("dv") <= radius)
    out = near.select((F.col("u") + F.col("du")).alias("u"), (F.col("v") + F.col("dv")).alias("v")).distinct()
    return out.where((F.col("u") >= 0) & (F.col("u") < width) & (F.col("v") >= 0) & (F.col("v") < height))


def erode(a: DataFrame, radius: int, four: bool = False) -> DataFrame:
    """Pixels all of whose neighbours within `radius` are in the mask; outside the raster is not."""
    mask = a.select("u", "v").distinct()
    d = F.sequence(F.lit(-radius), F.lit(radius))
    near = mask.withColumn("du", F.explode(d)).withColumn("dv", F.explode(d))
    if four:
        near = near.where(F.abs("du") + F.abs("dv") <= radius)
    want = sum(1 for x in range(-radius, radius + 1) for y in range(-radius, radius + 1) if not four or abs(x) + abs(y) <= radius)
    hit = near.select("u", "v", (F.col("u") + F.col("du")).alias("u2"), (F.col("v") + F.col("dv")).alias("v2")).join(mask.select(F.col("u").alias("u2"), F.col("v").alias("v2")), ["u2", "v2"])
    return hit.groupBy("u", "v").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == want).select("u", "v")


def downsample(a: DataFrame, factor: int) -> DataFrame:
    """The mask on a coarser raster: a pixel is set only if all of its `factor` squared pixels are."""
    return a.select("u", "v").distinct().groupBy(F.floor(F.col("u") / factor).cast("int").alias("u"), F.floor(F.col("v") / factor).cast("int").alias("v")).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == factor * factor).select("u", "v")
