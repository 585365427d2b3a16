"""Projection into views: z-buffer, visibility, front shell, labels of pixels, crops.

The depth buffer is a min-aggregate over splatted pixels: points are folded by (view, pixel, radius)
before they are splatted, so the explosion is bounded by the pixels and not by the points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.functions.vectors import dist2
from voxloom.functions.voxel import around, cell


def depth_buffer(points: DataFrame, view: list[str], u: str, v: str, depth: str, radius: Column, width: int, height: int) -> DataFrame:
    """(view..., u, v, z): the least depth of all points whose square of `radius` covers the pixel."""
    folded = points.where(F.col(u).isNotNull() & F.col(v).isNotNull()).groupBy(*view, F.col(u).alias("__u"), F.col(v).alias("__v"), radius.alias("__r")).agg(F.min(depth).alias("__z"))
    # Splats apart from the raster have no pixel; sequences below are clipped to it.
    near = folded.where((F.col("__u") + F.col("__r") >= 0) & (F.col("__u") - F.col("__r") < width) & (F.col("__v") + F.col("__r") >= 0) & (F.col("__v") - F.col("__r") < height))
    us = near.withColumn("u", F.explode(F.sequence(F.greatest(F.col("__u") - F.col("__r"), F.lit(0)), F.least(F.col("__u") + F.col("__r"), F.lit(width - 1)))))
    vs = us.withColumn("v", F.explode(F.sequence(F.greatest(F.col("__v") - F.col("__r"), F.lit(0)), F.least(F.col("__v") + F.col("__r"), F.lit(height - 1)))))
    return vs.groupBy(*view, "u", "v").agg(F.min("__z").alias("z"))


def visible(points: DataFrame, buffer: DataFrame, view: list[str], u: str, v: str, depth: str, tau: float) -> DataFrame:
    """points on the raster with `visible`: within tau of the buffer at their pixel."""
    b = buffer.select(*(F.col(c).alias(f"__b_{c}") for c in view), F.col("u").alias("__b_u"), F.col("v").alias("__b_v"), F.col("z").alias("__b_z"))
    on = (points[u] == b["__b_u"]) & (points[v] == b["__b_v"])
    for c in view:
        on = on & (points[c] == b[f"__b_{c}"])
    return points.join(b, on).withColumn("visible", F.abs(F.col(depth) - F.col("__b_z")) <= F.lit(tau)).drop(*(f"__b_{c}" for c in [*view, "u", "v", "z"]))


def front_shell(points: DataFrame, view: list[str], u: str, v: str, depth: str, band: float) -> DataFrame:
    """Visible points no deeper than the nearest of their pixel plus `band` (below 0: 0)."""
    least = points.groupBy(*view, u, v).agg(F.min(depth).alias("__min"))
    return points.join(least, [*view, u, v]).where(F.col(depth) <= F.col("__min") + F.lit(max(0.0, band))).drop("__min")


def pixel_points(points: DataFrame, view: list[str], u: str, v: str, depth: str, order: str, item: str) -> DataFrame:
    """(view..., u, v, n, z, item): of each pixel its points, the least depth, and the nearest point, the
    first in order of equals."""
    near = F.min(F.struct(F.col(depth).alias("d"), F.col(order).alias("o"), F.col(item).alias("i"))).alias("m")
    return points.groupBy(*view, u, v).agg(F.count(F.lit(1)).alias("n"), near).select(*view, u, v, "n", F.col("m.d").alias("z"), F.col("m.i").alias(item))


def non_empty(points: DataFrame, xyz: list[str]) -> DataFrame:
    """points without empty beams (all coordinates 0) and without missing or non-finite ones."""
    cols = [F.col(c) for c in xyz]
    ok, zero = F.lit(True), F.lit(True)
    for c in cols:
        ok, zero = ok & c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c.cast("double")), zero & (c == 0)
    return points.where(ok & ~zero)


def reject_dynamic(points: DataFrame, view: list[str], u: str, v: str, pixels: DataFrame, dynamic: list[str]) -> DataFrame:
    """points without those on a pixel whose class is dynamic; points off the raster stay."""
    bad = pixels.where(F.col("name").isin(dynamic)).select(*view, F.col("u").alias(u), F.col("v").alias(v)).distinct()
    return points.join(bad, [*view, u, v], "left_anti")


def stamp(points: DataFrame, view: list[str], u: str, v: str, pixels: DataFrame, vocab: DataFrame, dynamic: list[str], things_only: bool) -> DataFrame:
    """points with class_id, kind, instance (-1: none) and `kill`, by the label of their pixel.

    Points without a label or with a nameless one are left out; a dynamic class kills its point; with
    things_only stuff is left out.
    """
    lab = pixels.where(F.col("name").isNotNull() & (F.col("name") != "")).join(vocab, "name", "left")
    out = points.join(lab.select(*view, F.col("u").alias(u), F.col("v").alias(v), "name", "class_id", "kind", "instance"), [*view, u, v])
    out = out.withColumn("kill", F.col("name").isin(dynamic)).withColumn("instance", F.coalesce("instance", F.lit(-1)))
    return out.where(F.col("kill") | (F.col("kind") == 1)) if things_only else out


def sphere_crop(points: DataFrame, xyz: list[str], centre: list[Column], radius: float) -> DataFrame:
    """Points within `radius` of the centre, the border included; a radius of 0 or less keeps all."""
    return points if radius <= 0 else points.where(dist2([F.col(c) for c in xyz], centre) <= F.lit(radius * radius))


def within(frames: DataFrame, points: DataFrame, f_xyz: list[str], p_xyz: list[str], radius: float, keys: list[str] | None = None) -> DataFrame:
    """Pairs of a frame and a point within `radius` of it: an equi-join on cells of that edge, then the
    exact distance.  `keys` are further columns both sides must agree on."""
    keys = keys or []
    names = [f"__c{i}" for i in range(len(f_xyz))]
    f = frames.select(*(F.col(k).alias(f"__k_{k}") for k in keys), *[c for c in frames.columns if c not in keys])
    for n, c in zip(names, f_xyz, strict=True):
        f = f.withColumn(n, F.explode(around(cell(F.col(c), radius))))
    p = points
    for n, c in zip(names, p_xyz, strict=True):
        p = p.withColumn(f"{n}p", cell(F.col(c), radius))
    on = F.lit(True)
    for n in names:
        on = on & (F.col(n) == F.col(f"{n}p"))
    for k in keys:
        on = on & (F.col(f"__k_{k}") == F.col(k))
    near = f.join(p, on).where(dist2([F.col(c) for c in f_xyz], [F.col(c) for c in p_xyz]) <= F.lit(radius * radius))
    return near.drop(*names, *(f"{n}p" for n in names), *(f"__k_{k}" for k in keys))


def may_show(m: list[Column], centre: list[Column], radius: Column, width: int, height: int, margin: float) -> Column:
    """Whether a ball may hold points that a view shows on its raster or within `margin` pixels of it: its
    centre is on the inner side of all five planes of the view's frustum, or nearer to them than the radius."""

    def side(plane: list[Column]) -> Column:
        at = plane[0] * centre[0] + plane[1] * centre[1] + plane[2] * centre[2] + plane[3]
        steep = F.sqrt(plane[0] * plane[0] + plane[1] * plane[1] + plane[2] * plane[2])
        return at >= -(steep * radius) - F.abs(plane[3]) * 1e-9 - 1e-9

    rows = [m[0:4], m[4:8], m[8:12]]
    lo, ok = F.lit(-1.0 - margin), side(rows[2])
    for row, size in ((rows[0], width), (rows[1], height)):
        ok = ok & side([a - lo * d for a, d in zip(row, rows[2], strict=True)]) & side([F.lit(size + margin) * d - a for a, d in zip(row, rows[2], strict=True)])
    return ok


def in_frusta(frames: DataFrame, cells: DataFrame, run: str, cell_names: list[str], edge: float, width: int, height: int, margin: float, levels: tuple[int, int] = (64, 8), shares: int = 16) -> DataFrame:
    """Pairs of a frame (run, m0..m11, ...) and a row of cells (run, cell..., ...) that it may show: frames are tested
    against the occupied blocks of levels[0] cells' edge, those that pass against blocks of levels[1] in
    them, and what passes meets the cells of these by an equi-join.  Blocks of a run are dealt over shares, so
    that a long run is not one task.  Every cell on the raster is in the result, some others too."""
    wide, fine = ([f"__{x}{i}" for i in range(len(cell_names))] for x in "wf")
    keyed = cells.select("*", *(F.floor(F.col(c) / levels[0]).alias(n) for c, n in zip(cell_names, wide, strict=True)), *(F.floor(F.col(c) / levels[1]).alias(n) for c, n in zip(cell_names, fine, strict=True)))
    blocks = keyed.select(run, *wide, *fine).distinct()
    m = [F.col(f"m{i}") for i in range(12)]

    def shown(names: list[str], size: int) -> Column:
        centre = [(F.col(n) + 0.5) * (size * edge) for n in names]
        return may_show(m, centre, F.lit(size * edge * 3**0.5 / 2), width, height, margin)

    share = F.pmod(F.xxhash64(*wide), F.lit(shares)).alias("__share")
    dealt = frames.withColumn("__share", F.explode(F.array(*(F.lit(i).cast("long") for i in range(shares)))))
    first = dealt.join(blocks.select(run, *wide).distinct().withColumn("__share", share), [run, "__share"]).where(shown(wide, levels[0])).drop("__share")
    second = first.join(blocks, [run, *wide]).where(shown(fine, levels[1]))
    return second.join(keyed, [run, *wide, *fine]).drop(*wide, *fine)


def neighbour_pixels(rows: DataFrame, view: list[str], u: str, v: str) -> DataFrame:
    """Four-neighbour pairs of pixels of one view: each pixel with its right and lower neighbour."""
    a = rows.select(*view, F.col(u).alias("u1"), F.col(v).alias("v1"), F.col("id").alias("id1"), F.explode(F.array(F.struct(F.lit(1).alias("du"), F.lit(0).alias("dv")), F.struct(F.lit(0).alias("du"), F.lit(1).alias("dv")))).alias("d"))
    a = a.select(*view, "u1", "v1", "id1", (F.col("u1") + F.col("d.du")).alias("u2"), (F.col("v1") + F.col("d.dv")).alias("v2"))
    b = rows.select(*view, F.col(u).alias("u2"), F.col(v).alias("v2"), F.col("id").alias("id2"))
    return a.join(b, [*view, "u2", "v2"])


def ranked_by_depth(points: DataFrame, view: list[str], u: str, v: str, depth: str, order: str) -> DataFrame:
    """points with their place from the front at their pixel."""
    return points.withColumn("place", F.row_number().over(W.partitionBy(*view, u, v).orderBy(depth, order)))


def mature(points: DataFrame, xyz: list[str], edge: float = 1.26, least: int = 200) -> DataFrame:
    """Points in coarse cells that hold at least `least` of them."""
    names = [f"__m{i}" for i in range(len(xyz))]
    keyed = points.select("*", *(cell(F.col(c), edge).alias(n) for n, c in zip(names, xyz, strict=True)))
    full = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).drop("__n")
    return keyed.join(full, names, "left_semi").drop(*names)


def frustum(points: DataFrame, u: str, v: str, depth: str, width: int, height: int, near: float, far: float) -> DataFrame:
    """Points whose pixel is on the raster and whose depth is between near and far, both included."""
    return points.where((F.col(u) >= 0) & (F.col(u) < width) & (F.col(v) >= 0) & (F.col(v) < height) & (F.col(depth) >= near) & (F.col(depth) <= far))
