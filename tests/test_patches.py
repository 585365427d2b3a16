"""Supervoxels against a sequential form, and on odd rows."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import patches

STEPS = list(itertools.product((-1, 0, 1), repeat=3))


def sequential(points, voxel, seed, refine):
    """Labels of one group's points where normals do not count, with dictionaries."""
    cell = [tuple(math.floor(c / voxel) for c in p) for p in points]
    held = {}
    for p, c in zip(points, cell, strict=True):
        held.setdefault(c, []).append([math.floor((x / voxel - i) * 10**6) for x, i in zip(p, c, strict=True)])
    at = {c: tuple(i * 10**6 + (2 * sum(o[a] for o in off) + len(off)) // (2 * len(off)) for a, i in enumerate(c)) for c, off in held.items()}
    wide = seed / voxel * 10**6
    d2 = lambda p, q: sum((a - b) ** 2 for a, b in zip(p, q, strict=True))
    owner, cost = {}, {}
    by_seed = {}
    for c, p in at.items():
        by_seed.setdefault(tuple(math.floor(x / wide) for x in p), []).append(c)
    for s, cs in by_seed.items():
        first = min(cs, key=lambda c: (d2(at[c], [(i + 0.5) * wide for i in s]), c))
        owner[first], cost[first] = sum((i + 2**20) << b for i, b in zip(s, (42, 21, 0), strict=True)), 0

    def middles():
        own = {}
        for c, k in owner.items():
            own.setdefault(k, []).append(c)
        return own, {k: [(2 * sum(at[c][a] for c in cs) + len(cs)) // (2 * len(cs)) for a in range(3)] for k, cs in own.items()}

    for again in range(1 + refine):
        if again:
            own, mid = middles()
            owner = {min(cs, key=lambda c: (d2(at[c], mid[k]), c)): k for k, cs in own.items()}
            cost = dict.fromkeys(owner, 0)
        for _ in range(int(1.8 * seed / voxel) - 1):
            _, mid = middles()
            taken = {}
            for c in at:
                offers = {owner.get(tuple(i + s for i, s in zip(c, step, strict=True))) for step in STEPS} - {None, owner.get(c)}
                best = min(((math.floor(math.sqrt(d2(at[c], mid[k])) / wide * 10**6), k) for k in offers), default=None)
                if best and (c not in owner or best[0] < cost[c]):
                    taken[c] = best
            for c, (b, k) in taken.items():
                owner[c], cost[c] = k, b
    return [owner.get(c, 0) for c in cell]


def table(spark, rows):
    return spark.createDataFrame([(g, i, *map(float, p)) for g, i, p in rows], "g string, i int, x double, y double, z double")


def labels(df):
    return {(r["g"], r["i"]): r["supervoxel"] for r in df.collect()}


def test_against_sequential_growth(spark):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(0, 1, (250, 3)), "b": rng.uniform(-2, 2, (120, 3)) * [1, 1, 0], "c": np.repeat(rng.normal(0, 1, (9, 3)), 3, axis=0)}
    df = table(spark, [(g, i, p) for g, x in groups.items() for i, p in enumerate(x)])
    got = labels(patches.supervoxels(df, ["g"], "i", list("xyz"), 0.25, 0.8, 1.0, 0.0, 1))
    assert got == {(g, i): k for g, x in groups.items() for i, k in enumerate(sequential(x.tolist(), 0.25, 0.8, 1))}


def test_patches_of_a_plane(spark):
    plane = list(itertools.product(np.arange(0.025, 1, 0.05), np.arange(0.025, 1, 0.05), [0.01]))
    df = table(spark, [("p", i, p) for i, p in enumerate(plane)])
    coarse = labels(patches.supervoxels(df, ["g"], "i", list("xyz"), 0.05, 0.3))
    assert all(k > 0 for k in coarse.values()) and 4 <= len(set(coarse.values())) <= 16
    assert len(set(labels(patches.supervoxels(df, ["g"], "i", list("xyz"), 0.05, 0.2)).values())) > len(set(coarse.values()))


def test_normals(spark):
    """Against numpy where the least eigenvalue stands apart, on the side of the origin."""
    rng = np.random.default_rng(5)
    pts = np.vstack([rng.uniform(1, 3, (400, 2)) @ np.array([[1.0, 0.0, 0.3], [0.0, 1.0, -0.5]]) + [0, 0, 4], rng.uniform(1, 3, (60, 3))])
    vox = patches.voxels(table(spark, [("a", i, p) for i, p in enumerate(pts)]), ["g"], list("xyz"), 0.2)
    got = {tuple(r[c] for c in patches.CELL): (np.array([r[p] for p in patches.AT]), np.array([r[n] for n in patches.NORMAL])) for r in patches.with_normals(vox, ["g"]).collect()}
    seen = 0
    for c, (p, n) in got.items():
        near = np.array([got[q][0] for s in STEPS if (q := tuple(np.add(c, s).tolist())) in got]) / 1e6
        if len(near) < 3:
            assert not n.any()
            continue
        val, vec = np.linalg.eigh(np.cov(near.T))
        if val[1] - val[0] > 1e-2:
            seen += 1
            assert abs(n @ vec[:, 0]) / 1e4 == pytest.approx(1, abs=1e-3) and n @ np.floor(p / 1e6) <= 0
    assert seen > 100
    line = patches.voxels(table(spark, [("a", i, (i * 0.2 + 0.1, 0.1, 0.1)) for i in range(9)]), ["g"], list("xyz"), 0.2)
    assert all(not any(r[n] for n in patches.NORMAL) for r in patches.with_normals(line, ["g"]).collect())


def test_normals_part_patches(spark):
    """Where two walls meet, a heavy normal keeps patches on their wall."""
    grid = list(itertools.product(np.arange(0.05, 2, 0.1), np.arange(0.05, 2, 0.1)))
    walls = [(2 + a, 2 + b, 2.05) for a, b in grid] + [(2.05, 2 + a, 2.2 + b) for a, b in grid]
    got = labels(patches.supervoxels(table(spark, [("w", i, p) for i, p in enumerate(walls)]), ["g"], "i", list("xyz"), 0.1, 0.5, 0.2, 5.0))
    inner = lambda i: walls[i][0] > 2.3 if i < 400 else walls[i][2] > 2.5
    floor, wall = ({got["w", i] for i in r if inner(i)} - {0} for r in (range(400), range(400, 800)))
    assert floor and wall and not floor & wall


def test_odd_rows(spark):
    good = [(i * 0.1, 0.0, 0.0) for i in range(10)]
    rows = [(None, i, p) for i, p in enumerate(good)] + [("few", i, p) for i, p in enumerate(good[:7])]
    rows += [("odd", i, p) for i, p in enumerate(good * 2)] + [("odd", 90 + i, (float("nan"), 0, 0)) for i in range(2)] + [("odd", 92, (float("-inf"), 0, 0))]
    df = table(spark, rows).unionByName(spark.createDataFrame([("odd", 95, None, 0.0, 0.0)], "g string, i int, x double, y double, z double"))
    df = df.select("*", F.lit("x").alias("supervoxel"), F.lit("x").alias("__k"), F.lit("x").alias("k"))
    out = patches.supervoxels(df, ["g"], "i", list("xyz"), 0.1, 0.3)
    assert out.columns == ["g", "i", "supervoxel"] and out.count() == df.count()
    got = labels(out)
    assert all(got[None, i] > 0 and got["odd", i] == got[None, i] for i in range(10))
    assert all(got["odd", i] == got["odd", i + 10] for i in range(10))  # repeated points
    assert not any(got["few", i] for i in range(7)) and not any(got["odd", i] for i in (90, 91, 92, 95))
    assert patches.supervoxels(df.where("false"), ["g"], "i", list("xyz"), 0.1, 0.3).count() == 0
    assert patches.supervoxels(df, [], "i", list("xyz"), 0.1, 0.3).count() == df.count()
    with pytest.raises(ValueError):
        patches.supervoxels(df, ["g"], "i", list("xyz"), 0.1, 0.05)


def test_plan_of_a_round(spark):
    """Two shuffles, no Python, no group in one task."""
    df = table(spark, [("a", i, (i % 5, i % 7, i % 3)) for i in range(40)])
    vox = patches.voxels(df.withColumnRenamed("g", "__g0"), ["__g0"], list("xyz"), 1.0)
    state = patches.settle(patches.plant(patches.with_normals(vox, ["__g0"]), ["__g0"], 2e6))
    plan = patches.expand(state, ["__g0"], 2e6, 1.0, 1.0)._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("== Initial Plan ==")[-1]
    assert initial.count("Exchange hashpartitioning") == 2 and "Python" not in initial and "SinglePartition" not in initial
