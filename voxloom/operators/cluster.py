"""Neighbours, outliers and clusters.

Neighbour searches with a radius are equi-joins on grid cells.  Nearest neighbours and clustering run on
one group at a time (a class in a view, an object) in memory that grows with the group, not with its
square; the numpy routines need nothing but numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.functions.vectors import dist2
from voxloom.functions.voxel import around, cell
from voxloom.operators.tables import components

#: Smaller classes are never clustered; the distance of classes that share one scan.
LEAST_POINTS, CLASS_GAP = 16, 1.0e6


# --- relational forms -----------------------------------------------------------------------------


def knn(points: DataFrame, group: list[str], item: str, xyz: list[str], k: int) -> DataFrame:
    """(group..., a, b, d2, rank): the k nearest of each point inside its group, ties to the lower id.

    Points of a group are searched by boxes (nearest_rows), never all against all.
    """
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item, ignore_index=True)
        ids = pdf[item].to_numpy()
        at, near = nearest_rows(pdf[xyz].to_numpy(dtype=float), k)
        n, m = at.shape
        out = {g: np.repeat(pdf[g].iloc[0], n * m) for g in group}
        out |= {"a": np.repeat(ids, m), "b": ids[at].ravel(), "d2": near.ravel(), "rank": np.tile(np.arange(1, m + 1), n)}
        return pd.DataFrame(out)

    schema = ", ".join([*(f"{g} {kinds[g]}" for g in group), f"a {kinds[item]}", f"b {kinds[item]}", "d2 double", "rank int"])
    return points.select(*group, item, *xyz).groupBy(*group).applyInPandas(run, schema)


def remove_outliers(points: DataFrame, group: list[str], item: str, xyz: list[str], k: int, times: float, population: bool = True) -> DataFrame:
    """points whose mean distance to their k nearest is at most mean + times * sigma of their group.

    Groups of k + 1 points or fewer stay as they are, and so do all when k < 1.
    """
    if k < 1:
        return points
    near = knn(points, group, item, xyz, k).groupBy(*group, F.col("a").alias(item)).agg((F.sum(F.sqrt("d2")) / F.lit(k)).alias("__mean"))
    sigma = F.stddev_pop("__mean") if population else F.stddev_samp("__mean")
    bound = near.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"), (F.avg("__mean") + F.lit(times) * sigma).alias("__bound"))
    judged = points.join(near, [*group, item], "left").join(bound, group, "left")
    return judged.where(F.col("__n").isNull() | (F.col("__n") <= k + 1) | (F.col("__mean") <= F.col("__bound"))).drop("__mean", "__n", "__bound")


def radius_pairs(points: DataFrame, group: list[str], item: str, xyz: list[str], radius: float) -> DataFrame:
    """(group..., a, b) with a < b no further apart than `radius`."""
    names = [f"__c{i}" for i in range(len(xyz))]
    left = points.select(*group, F.col(item).alias("a"), *(F.col(c).alias(f"a_{c}") for c in xyz))
    right = points.select(*group, F.col(item).alias("b"), *(F.col(c).alias(f"b_{c}") for c in xyz), *(cell(F.col(c), radius).alias(n) for n, c in zip(names, xyz, strict=True)))
    for n, c in zip(names, xyz, strict=True):
        left = left.withColumn(n, F.explode(around(cell(F.col(f"a_{c}"), radius))))
    near = left.join(right, [*group, *names]).where("a < b")
    return near.where(dist2([F.col(f"a_{c}") for c in xyz], [F.col(f"b_{c}") for c in xyz]) <= F.lit(radius * radius)).select(*group, "a", "b")


def radius_components(points: DataFrame, group: list[str], item: str, xyz: list[str], radius: float) -> DataFrame:
    """(group..., item, comp): points linked through steps of at most `radius`; a point alone is its own
    component.  A radius of 0 or less makes one component of each group."""
    if radius <= 0:
        return points.select(*group, item, F.min(item).over(W.partitionBy(*group)).alias("comp"))
    labels = components(radius_pairs(points, group, item, xyz, radius).select("a", "b"))
    return points.select(*group, item).join(labels.withColumnRenamed("node", item), item, "left").withColumn("comp", F.coalesce("comp", F.col(item)))


# --- one group at a time --------------------------------------------------------------------------


def distances2(x: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
    y = x if y is None else y
    out = np.zeros((len(x), len(y)))
    for a, b in zip(x.T, y.T, strict=True):
        out += (a[:, None] - b[None, :]) ** 2
    return out


LEAF = 64  # points of a box


def boxes(x: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Row numbers in boxes of at most `leaf` points, cut in halves along the longest side."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        side = int(np.ptp(x[rows], axis=0).argmax())
        half = len(rows) // 2
        order = np.argpartition(x[rows, side], half)
        todo += [rows[order[:half]], rows[order[half:]]]
    return out


def smallest(at: np.ndarray, d: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The m smallest of each row of d with their numbers, in no order; of equals the lower numbers."""
    if d.shape[1] <= m:
        return at, d
    keep = np.argpartition(d, m - 1, axis=1)[:, :m]
    tied = (d <= np.take_along_axis(d, keep, 1).max(1)[:, None]).sum(1) > m
    if tied.any():
        keep[tied] = np.lexsort((at[tied], d[tied]), axis=1)[:, :m]
    return np.take_along_axis(at, keep, 1), np.take_along_axis(d, keep, 1)


def nearest_rows(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, squared distances), each (n, min(k, n - 1)): every row's nearest others, nearest first, ties to
    the lower row.

    Equal points are searched once, by their k + 1 lowest rows.  The points lie in boxes; a box looks at the
    others in order of their distance from it, until none that is left can hold a nearer point.
    """
    n = len(x)
    m = min(k, n - 1)
    if m < 1:
        return np.zeros((n, 0), dtype=np.int64), np.zeros((n, 0))
    spot, of = np.unique(x, axis=0, return_inverse=True)
    of = of.ravel()
    order = np.argsort(of, kind="stable")
    start = np.searchsorted(of[order], np.arange(len(spot) + 1))
    few = np.concatenate([order[a : min(b, a + m + 1)] for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)])
    leaves = [few[b] for b in boxes(x[few])]
    low, high = (np.array([f(x[b], axis=0) for b in leaves]) for f in (np.min, np.max))
    best_at, best = np.zeros((len(spot), m + 1), dtype=np.int64), np.zeros((len(spot), m + 1))
    heads = [np.unique(of[b]) for b in leaves]
    done = np.zeros(len(spot), dtype=bool)
    for i, head in enumerate(heads):
        head = head[~done[head]]
        if not len(head):
            continue
        done[head] = True
        q = spot[head]
        far = (np.maximum(0, np.maximum(low - q.max(0), q.min(0) - high)) ** 2).sum(1)
        at, d = np.zeros((len(head), 0), dtype=np.int64), np.zeros((len(head), 0))
        order = np.argsort(far, kind="stable")
        for lo in range(0, len(order), 8):  # so many boxes at a time
            if d.shape[1] > m and far[order[lo]] > d.max():
                break
            some = np.concatenate([leaves[j] for j in order[lo : lo + 8]])
            at = np.concatenate([at, np.broadcast_to(some, (len(head), len(some)))], axis=1)
            at, d = smallest(at, np.concatenate([d, distances2(q, x[some])], axis=1), m + 1)
        keep = np.lexsort((at, d), axis=1)
        best_at[head], best[head] = np.take_along_axis(at, keep, 1), np.take_along_axis(d, keep, 1)
    # Each row's own entry goes; a row beyond its point's lowest ones drops the last instead.
    at, d = best_at[of], best[of]
    own = at == np.arange(n)[:, None]
    own[~own.any(1), -1] = True
    return at[~own].reshape(n, m), d[~own].reshape(n, m)


def linkage(x: np.ndarray, min_pts: int) -> np.ndarray:
    """Rows (a, b, height, size) of the single-linkage tree of mutual reachability distances.

    The core distance of a point is that to its min_pts-th nearest, itself counted.  Prim's algorithm
    builds the spanning tree, with the distances of one point at a time; ties go to the lower index.
    """
    n = len(x)
    k = min(min_pts, n) - 1
    core = np.sqrt(nearest_rows(x, k)[1][:, k - 1]) if k > 0 else np.zeros(n)
    best, come, done = np.full(n, np.inf), np.zeros(n, dtype=int), np.zeros(n, dtype=bool)
    edges, at = [], 0
    done[0] = True
    for _ in range(n - 1):
        reach = np.maximum(np.sqrt(distances2(x[at : at + 1], x)[0]), np.maximum(core, core[at]))
        closer = (reach < best) & ~done
        best[closer], come[closer] = reach[closer], at
        nxt = int(np.argmin(np.where(done, np.inf, best)))
        edges.append((best[nxt], come[nxt], nxt))
        done[nxt], at = True, nxt
    parent, size = list(range(2 * n - 1)), [1] * n + [0] * (n - 1)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    rows = []
    for k, (h, a, b) in enumerate(sorted(edges, key=lambda e: e[0])):
        p, q, new = root(a), root(b), n + k
        parent[p] = parent[q] = new
        size[new] = size[p] + size[q]
        rows.append((p, q, h, size[new]))
    return np.array(rows, dtype=float).reshape(-1, 4)


def flat_clusters(tree: np.ndarray, n: int, least: int, allow_single: bool = False, leaf: bool = False) -> np.ndarray:
    """Labels from 0, -1 for noise, of the condensed tree.

    A split counts when both sides have at least `least` (2 or more) points; a side that is smaller
    falls off as noise.  Stability is the sum of (lambda - birth) * points with lambda = 1 / height.
    Excess of mass keeps a cluster unless its children are stabler together; `leaf` keeps the childless.
    The root counts only with allow_single.
    """
    labels = np.full(n, -1)
    if n < 2 or not len(tree):
        return labels
    least = max(2, least)
    kids = {n + i: (int(a), int(b)) for i, (a, b, _, _) in enumerate(tree)}
    height = {n + i: h for i, (_, _, h, _) in enumerate(tree)}
    size = lambda i: 1 if i < n else int(tree[i - n, 3])

    def below(i: int) -> list[int]:
        out, stack = [], [i]
        while stack:
            j = stack.pop()
            if j < n:
                out.append(j)
            else:
                stack.extend(kids[j])
        return out

    # Condensed clusters: 0 is the root; each has its birth, its points with their lambdas, children.
    birth, fall, child, top = [0.0], [[]], [[]], [2 * n - 2]
    queue = [(2 * n - 2, 0)]
    while queue:
        node, c = queue.pop(0)
        lam = np.inf if height[node] <= 0 else 1.0 / height[node]
        big = [k for k in kids[node] if size(k) >= least]
        if len(big) == 2:
            for k in kids[node]:
                birth.append(lam)
                fall.append([])
                child.append([])
                top.append(k)
                new = len(birth) - 1
                child[c].append(new)
                queue.append((k, new))
            fall[c] += [(lam, size(k)) for k in kids[node]]
            continue
        for k in kids[node]:
            if size(k) >= least:
                queue.append((k, c))
            else:
                fall[c].append((lam, size(k)))
    stab = [sum((min(lam, 1e300) - min(birth[c], 1e300)) * m for lam, m in fall[c]) for c in range(len(birth))]
    keep = [not child[c] for c in range(len(birth))]
    if not leaf:
        best = list(stab)
        for c in range(len(birth) - 1, -1, -1):
            if child[c]:
                inner = sum(best[k] for k in child[c])
                keep[c] = inner <= stab[c] and (c > 0 or allow_single)
                best[c] = stab[c] if keep[c] else inner
    if not allow_single:
        keep[0] = False
    # From the top: the first kept cluster of each branch takes all points that fall off below it.
    queue, chosen = [0], []
    while queue:
        c = queue.pop(0)
        if keep[c] and (c > 0 or allow_single) and not (leaf and child[c]):
            chosen.append(c)
        else:
            queue += child[c]
    for k, c in enumerate(sorted(chosen, key=lambda c: min(below(top[c])))):
        labels[below(top[c])] = k
    return labels


def cluster_classes(points: DataFrame, group: list[str], item: str, xyz: list[str], min_pts: int = 7, least: int = 10, min_class: int = 10, allow_single: bool = False, leaf: bool = True, split: float = 0.0, classes: str | None = None) -> DataFrame:
    """(group..., item, cluster): density clusters of each group; noise is left out.

    Groups smaller than min_class, min_pts + 1 or 16 have none.  With `split` > 0 each cluster is then cut
    into its components at that radius.  Clusters are numbered from 0 by their smallest item.  With a
    column `classes` a group holds several classes, which are clustered in one scan: classes smaller than
    min_class are left out and the others lie so far apart that no cluster has two of them.
    """
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    keep = [*group, item] + ([classes] if classes else [])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item, ignore_index=True)
        x = pdf[xyz].to_numpy(dtype=float)
        pdf, x = pdf[np.isfinite(x).all(1)].reset_index(drop=True), x[np.isfinite(x).all(1)]
        if classes:
            kind, slot, n = np.unique(pdf[classes].to_numpy(), return_inverse=True, return_counts=True)
            ok = n[slot] >= min_class
            pdf, x = pdf[ok].reset_index(drop=True), np.column_stack([x, slot * CLASS_GAP])[ok]
        if len(x) < max(min_class, min_pts + 1, LEAST_POINTS):
            return pdf.iloc[:0][keep].assign(cluster=pd.Series(dtype="int32"))
        lab = flat_clusters(linkage(x, min_pts), len(x), least, allow_single, leaf)
        if split > 0:
            lab = split_by_radius(x, lab, split)
        out = pdf[keep].assign(cluster=lab.astype("int32"))
        return out[out["cluster"] >= 0]

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), "cluster int"])
    return points.select(*keep, *xyz).groupBy(*group).applyInPandas(run, schema)


def split_by_radius(x: np.ndarray, labels: np.ndarray, radius: float) -> np.ndarray:
    """Labels of the components of each cluster under steps of at most `radius`."""
    out, nxt = np.full(len(x), -1), 0
    for c in range(labels.max() + 1 if len(labels) else 0):
        left = np.flatnonzero(labels == c)
        while len(left):
            todo, left = left[:1], left[1:]
            while len(todo):
                some, todo = todo[:512], todo[512:]  # so many rows of distances at a time
                out[some] = nxt
                near = (distances2(x[some], x[left]) <= radius * radius).any(0)
                todo, left = np.concatenate([todo, left[near]]), left[~near]
            nxt += 1
    return out


# --- hulls ----------------------------------------------------------------------------------------


def convex_hull(pts: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the hull, counter-clockwise from the least point; points on an edge are left out.  Fewer
    than three distinct points come back as they are, sorted."""
    p = sorted(set(pts))
    if len(p) < 3:
        return p

    def half(points: list) -> list:
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    lower, upper = half(p), half(p[::-1])
    return lower[:-1] + upper[:-1]


def hulls(points: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, polygon, cx, cy): the hull and centroid of each group's points; groups fold to their
    distinct points before they reach Python."""
    kind = points.schema[group].dataType.simpleString()
    pts = points.select(group, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    mid = pts.groupBy(group).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hull = convex_hull(list(zip(pdf["x"].tolist(), pdf["y"].tolist(), strict=True)))
        return pd.DataFrame({group: [pdf[group].iloc[0]], "polygon": [[{"x": a, "y": b} for a, b in hull]]})

    polygon = pts.distinct().groupBy(group).applyInPandas(run, f"{group} {kind}, polygon array<struct<x:double,y:double>>")
    return polygon.join(mid, group)
