"""Supervoxels as rounds over tables.

Points fold to voxels; the voxel nearest to the middle of each occupied seed cell starts a patch; in each round a
patch offers itself to the voxels around its own, and a voxel goes to the offer that costs least.  A round is two
shuffles, by patch and by voxel, whatever the number of groups or the size of one: a voxel has at most 27 offers and a
patch no more voxels than its rounds can reach.

Positions are whole millionths of a voxel's edge, normals whole ten-thousandths, costs whole millionths, so sums are
exact in any order and ties are ties.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.functions.vectors import dist2
from voxloom.operators.tables import settle

UNIT, NORMAL_UNIT = 1_000_000, 10_000
LEAST_POINTS = 8  # a group of fewer has no patches
SEED_CELLS = 1 << 20  # seed cells on either side of the origin that a label can tell apart
REACH = 1.8  # seed edges that a patch may grow to, as the published method has it

AXES = "xyz"
CELL, AT, NORMAL, TO = ([f"__{p}{a}" for a in AXES] for p in "cpnw")


def mean(total: Column, n: Column) -> Column:
    """total / n to the nearest whole number, in whole numbers."""
    up = total * 2 + n
    return F.call_function("div", up - F.pmod(up, n * 2), n * 2)


def voxels(points: DataFrame, by: list[str], xyz: list[str], edge: float) -> DataFrame:
    """(by..., cell, position, points) of each occupied voxel: the mean of its points."""
    scaled = points.select(*by, *((F.col(c) / F.lit(edge)).alias(a) for c, a in zip(xyz, AXES, strict=True)))
    for a, c, p in zip(AXES, CELL, AT, strict=True):
        scaled = scaled.withColumn(c, F.floor(a)).withColumn(p, F.floor((F.col(a) - F.col(c)) * UNIT))
    n = F.count(F.lit(1))
    return scaled.groupBy(*by, *CELL).agg(*((F.col(c) * UNIT + mean(F.sum(p), n)).alias(p) for c, p in zip(CELL, AT, strict=True)), n.alias("__n"))


def spread(df: DataFrame, *keep: str) -> DataFrame:
    """Columns of df once for each of the 27 cells around its cell, which are the columns TO."""
    for c, t in zip(CELL, TO, strict=True):
        df = df.selectExpr("*", f"explode(sequence({c} - 1, {c} + 1)) AS {t}")
    return df.select(*keep, *TO) if keep else df


def with_normals(vox: DataFrame, by: list[str]) -> DataFrame:
    """vox with the unit normal of the voxels around each, on the side of the origin.

    The normal belongs to the least eigenvalue of their covariance, found in closed form.  It is 0, 0, 0 for fewer
    than three voxels, for a line, and where all directions are alike.
    """
    near = spread(vox.select(*by, *CELL, *AT))
    own = reduce(lambda a, b: a & b, (F.col(c) == F.col(t) for c, t in zip(CELL, TO, strict=True)))
    near = near.select(*by, *TO, F.when(own, F.struct(*AT)).alias("own"), *((F.col(p) - F.col(t) * UNIT).alias(a) for p, t, a in zip(AT, TO, AXES, strict=True)))
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    sums = near.groupBy(*by, *TO).agg(F.max("own").alias("own"), F.count(F.lit(1)).alias("n"), *(F.sum(a).alias(f"s{a}") for a in AXES), *(F.sum(F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in pairs)).where("own IS NOT NULL")
    cov = sums.select(*by, *(F.col(t).alias(c) for t, c in zip(TO, CELL, strict=True)), *(F.col(f"own.{p}").alias(p) for p in AT), "n", *((F.col("n") * F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}")).cast("double").alias(f"{a}{b}") for a, b in pairs))
    xx, xy, xz, yy, yz, zz = (F.col(a + b) for a, b in pairs)
    q, off = (xx + yy + zz) / 3, xy * xy + xz * xz + yz * yz
    cov = cov.withColumn("q", q).withColumn("p", F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + off * 2) / 6))
    u, v, w = ((d - F.col("q")) / F.col("p") for d in (xx, yy, zz))
    f, g, h = (d / F.col("p") for d in (xy, xz, yz))
    half = (u * (v * w - h * h) - f * (f * w - h * g) + g * (f * h - v * g)) / 2
    least = F.col("q") + F.col("p") * 2 * F.cos(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3 + F.lit(2.0) * F.pi() / 3)
    cov = cov.withColumn("e", F.when((F.col("n") >= 3) & (F.col("p") > 0), least))
    a, b, c = ([xx - F.col("e"), xy, xz], [xy, yy - F.col("e"), yz], [xz, yz, zz - F.col("e")])
    # The eigenvector stands on the rows of the shifted matrix: of their products the longest is the surest.
    for i, (r, s) in enumerate(((a, b), (a, c), (b, c))):
        prod = [r[1] * s[2] - r[2] * s[1], r[2] * s[0] - r[0] * s[2], r[0] * s[1] - r[1] * s[0]]
        cov = cov.withColumn(f"v{i}", F.struct(dist2(prod, [F.lit(0.0)] * 3).alias("l"), *(p.alias(x) for p, x in zip(prod, AXES, strict=True))))
    cov = cov.withColumn("best", F.when(F.col("v0.l") >= F.greatest("v1.l", "v2.l"), F.col("v0")).when(F.col("v1.l") >= F.col("v2.l"), F.col("v1")).otherwise(F.col("v2")))
    sure = F.col("best.l") > F.lit(1e-12) * F.col("q") * F.col("q") * F.col("q") * F.col("q")
    unit = [F.when(sure, F.floor(F.col(f"best.{x}") / F.sqrt("best.l") * NORMAL_UNIT + 0.5).cast("long")).otherwise(F.lit(0)).alias(m) for x, m in zip(AXES, NORMAL, strict=True)]
    out = cov.select(*by, *CELL, *AT, *unit)
    away = reduce(lambda s, t: s + t, (F.col(m) * F.floor(F.col(p) / UNIT) for m, p in zip(NORMAL, AT, strict=True))) > 0
    return out.withColumn("__away", away).select(*by, *CELL, *AT, *(F.when(F.col("__away"), -F.col(m)).otherwise(F.col(m)).alias(m) for m in NORMAL))


def label(seed_cell: list[Column]) -> Column:
    """A number above 0 for a seed cell."""
    fits = reduce(lambda a, b: a & b, (F.abs(s) < SEED_CELLS for s in seed_cell))
    x, y, z = (s + SEED_CELLS for s in seed_cell)
    packed = F.shiftleft(x, 42) + F.shiftleft(y, 21) + z
    return F.when(fits, packed).otherwise(F.raise_error(F.lit("supervoxels: points lie too many seed cells from the origin")).cast("long"))


def plant(vox: DataFrame, by: list[str], wide: float) -> DataFrame:
    """vox with (patch, cost, seed): in each occupied seed cell of edge `wide` the voxel nearest to its middle."""
    at = [F.floor(F.col(p) / F.lit(wide)) for p in AT]
    vox = vox.select("*", *(a.alias(f"__s{x}") for a, x in zip(at, AXES, strict=True)))
    seed = [F.col(f"__s{x}") for x in AXES]
    far = dist2([F.col(p).cast("double") for p in AT], [(s + 0.5) * wide for s in seed])
    first = F.row_number().over(W.partitionBy(*by, *seed).orderBy(far, *CELL)) == 1
    return vox.withColumn("__seed", first).select(*vox.columns[:-3], F.when(F.col("__seed"), label(seed)).otherwise(0).alias("__k"), F.lit(0).cast("long").alias("__cost"), "__seed")


def centred(state: DataFrame, by: list[str]) -> DataFrame:
    """The voxels of patches with their patch's mean position (mx...) and sum of normals (nx...)."""
    patch = f"OVER (PARTITION BY {', '.join([*by, '__k'])})"
    up = [f"2 * sum({p}) {patch} + count(*) {patch}" for p in AT]
    owned = state.where("__k > 0").selectExpr("*", f"2 * count(*) {patch} AS __twice", *(f"{u} AS u{a}" for u, a in zip(up, AXES, strict=True)), *(f"sum({m}) {patch} AS n{a}" for m, a in zip(NORMAL, AXES, strict=True)))
    return owned.selectExpr(*state.columns, *(f"(u{a} - pmod(u{a}, __twice)) div __twice AS m{a}" for a in AXES), *(f"n{a}" for a in AXES))


def cost_sql(wide: float, spatial: float, normal: float) -> str:
    """What the offer `o` of a patch costs the voxel `own`, in whole millionths."""
    added = lambda terms: " + ".join(terms)
    squares = lambda xs: added(f"{x} * {x}" for x in xs)
    far = squares(f"(double(own.{p}) - double(o.m{a}))" for p, a in zip(AT, AXES, strict=True))
    mine, theirs = [f"double(own.{m})" for m in NORMAL], [f"double(o.n{a})" for a in AXES]
    dot, long = added(f"{p} * {q}" for p, q in zip(mine, theirs, strict=True)), f"(sqrt({squares(mine)}) * sqrt({squares(theirs)}))"
    return f"floor(({float(spatial)!r}D * sqrt({far}) / {wide!r}D + {float(normal)!r}D * CASE WHEN {long} > 0 THEN 1 - abs({dot}) / {long} ELSE 1D END) * {UNIT})"


def expand(state: DataFrame, by: list[str], wide: float, spatial: float, normal: float) -> DataFrame:
    """One round: patches offer themselves to the voxels around theirs, all at once."""
    mids = [f"m{a}" for a in AXES] + [f"n{a}" for a in AXES]
    own = [*AT, *NORMAL, "__k", "__cost", "__seed"]
    kind = "struct<" + ",".join(f"{n}:{state.schema[n].dataType.simpleString()}" for n in own) + ">"
    offers = spread(centred(state, by), *by, "__k", *mids).dropDuplicates([*by, *TO, "__k"])  # as they lie: no shuffle
    theirs = offers.selectExpr(*by, *TO, f"CAST(NULL AS {kind}) AS own", f"struct(__k AS k, {', '.join(mids)}) AS offer")
    mine = state.selectExpr(*by, *(f"{c} AS {t}" for c, t in zip(CELL, TO, strict=True)), f"struct({', '.join(own)}) AS own", f"CAST(NULL AS struct<k:bigint,{','.join(f'{m}:bigint' for m in mids)}>) AS offer")
    met = mine.unionByName(theirs).groupBy(*by, *TO).agg(F.max("own").alias("own"), F.collect_list("offer").alias("offers")).where("own IS NOT NULL")
    met = met.selectExpr("*", f"array_min(transform(filter(offers, o -> o.k <> own.__k), o -> struct({cost_sql(wide, spatial, normal)} AS cost, o.k AS k))) AS best")
    met = met.selectExpr("*", "coalesce(own.__k = 0 AND best IS NOT NULL OR best.cost < own.__cost, false) AS __moved")
    kept = (f"own.{p} AS {p}" for p in [*AT, *NORMAL])
    return met.selectExpr(*by, *(f"{t} AS {c}" for t, c in zip(TO, CELL, strict=True)), *kept, "if(__moved, best.k, own.__k) AS __k", "if(__moved, best.cost, own.__cost) AS __cost", "own.__seed AS __seed", "__moved")


def replant(state: DataFrame, by: list[str]) -> DataFrame:
    """state with nothing but seeds: each patch's voxel nearest to its mean position."""
    keep = [c for c in state.columns if c not in ("__k", "__cost", "__seed")]
    owned = centred(state, by)
    far = dist2([F.col(p).cast("double") for p in AT], [F.col(f"m{a}").cast("double") for a in AXES])
    first = F.row_number().over(W.partitionBy(*by, "__k").orderBy(far, *CELL)) == 1
    zero = F.lit(0).cast("long")
    owned = owned.withColumn("__first", first).select(*keep, F.when(F.col("__first"), F.col("__k")).otherwise(zero).alias("__k"), zero.alias("__cost"), F.col("__first").alias("__seed"), (F.col("__first") != F.col("__seed")).alias("__moved"))
    return owned.unionByName(state.where("__k = 0").select(*keep, "__k", "__cost", F.lit(False).alias("__seed"), F.lit(False).alias("__moved")))


def supervoxels(points: DataFrame, group: list[str], item: str, xyz: list[str], voxel: float, seed: float, spatial: float = 0.9, normal: float = 0.5, refine: int = 0) -> DataFrame:
    """(group..., item, supervoxel): patches of each group's points around seeds on a grid of edge `seed`.

    A patch grows over touching voxels for at most 1.8 * seed / voxel - 1 rounds.  A voxel goes to the patch that
    costs least, by spatial * distance / seed + normal * (1 - |cosine of the normals|) to the patch's mean before the
    round, ties to the lower label, and leaves its patch only for a lower cost than the one it came at; a seed keeps
    its own.  Then `refine` times seeds move to their patches' middles and grow anew.  Labels are numbers of seed
    cells, the same in every run.

    0: a point that no seed reaches, one with a coordinate that is null or not finite, and all points of a group with
    fewer than eight others.  Null is a group like any other; every row of `points` comes back once.
    """
    if voxel <= 0 or seed < voxel:
        raise ValueError("supervoxels: 0 < voxel <= seed")
    by = [f"__g{i}" for i in range(len(group))]
    p = points.select(*(F.col(g).alias(b) for g, b in zip(group, by, strict=True)), F.col(item).alias("__item"), *(F.col(c).cast("double").alias(a) for c, a in zip(xyz, AXES, strict=True)))
    sound = reduce(lambda a, b: a & b, (F.coalesce(F.abs(F.col(a)) < float("inf"), F.lit(False)) for a in AXES))
    wide, same = float(seed) / float(voxel) * UNIT, lambda a, b, on: reduce(lambda x, y: x & y, (a[n].eqNullSafe(b[n]) for n in on), F.lit(True))
    vox = settle(voxels(p.where(sound), by, list(AXES), float(voxel)))
    large = vox.groupBy(*by).agg(F.sum("__n").alias("__n")).where(F.col("__n") >= LEAST_POINTS).drop("__n")
    state = settle(plant(with_normals(vox.join(large, same(vox, large, by), "left_semi"), by), by, wide))
    for again in range(1 + max(0, refine)):
        if again:
            state = settle(replant(state.drop("__moved"), by))
            if state.where("__moved").isEmpty():  # the same seeds would grow the same patches
                state = before
                break
        for _ in range(max(0, int(REACH * seed / voxel) - 1)):
            state = settle(expand(state.drop("__moved"), by, wide, spatial, normal))
            if state.where("__moved").isEmpty():
                break
        before = state
    cells = p.withColumn("__sound", sound).select("*", *(F.when(F.col("__sound"), F.floor(F.col(a) / F.lit(float(voxel)))).alias(f"__a{a}") for a in AXES))
    labels = state.select(*by, *CELL, "__k")
    on = same(cells, labels, by)
    for a, c in zip(AXES, CELL, strict=True):
        on = on & (cells[f"__a{a}"] == labels[c])
    out = cells.join(labels, on, "left")
    return out.select(*(cells[b].alias(g) for b, g in zip(by, group, strict=True)), F.col("__item").alias(item), F.coalesce("__k", F.lit(0)).cast("long").alias("supervoxel"))
