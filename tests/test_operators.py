"""Operators against hand-made cases and brute force."""


import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxloom.functions import geometry as G
from voxloom.functions import ids, text, timeconv, vectors
from voxloom.operators import cluster, fuse, merge, objects, overlap, panoptic, project, tables, votes
from voxloom.operators.grow import Growth, grow
from voxloom.streaming import folds, keyed


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


# --- hulls, outliers, egress, deltas ---------------------------------------------------------------


def hull_corners(pts):
    """Points p with another q such that no point lies to the right of p -> q: the ends of hull edges."""
    p = np.array(sorted(set(pts)))
    if len(p) < 3:
        return set(map(tuple, p.tolist()))
    d = p[None, :] - p[:, None]  # d[i, j]: from i to j
    side = d[:, :, None, 0] * d[:, None, :, 1] - d[:, :, None, 1] * d[:, None, :, 0]  # of k, seen from i to j
    edge = (side >= 0).all(2) & (np.abs(d).sum(2) > 0)
    return {tuple(p[i]) for i in range(len(p)) if edge[i].any() and not _between(p, i)}


def _between(p, i):
    """On the straight line between two others: not a corner."""
    a, b = p[:, None] - p[i], p[None, :] - p[i]
    cross, dot = a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0], (a * b).sum(2)
    return bool(((cross == 0) & (dot < 0)).any())


@pytest.mark.parametrize("kind", ["uniform", "lattice", "line", "few"])
def test_hull_against_edges(kind):
    rng = np.random.default_rng(12)
    for _ in range(25):
        n = int(rng.integers(0, 4)) if kind == "few" else int(rng.integers(3, 40))
        x = rng.integers(-3, 4, (n, 2)).astype(float) if kind in ("lattice", "few") else rng.normal(0, 5, (n, 2))
        if kind == "line":
            x = np.stack([np.arange(n), 2.0 * np.arange(n) - 7], axis=1)
        pts = list(map(tuple, x.tolist()))
        hull = cluster.convex_hull(pts)
        assert set(hull) == hull_corners(pts) and len(hull) == len(set(hull))
        area = sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(hull, hull[1:] + hull[:1], strict=True))
        assert area >= -1e-9  # counter-clockwise


def test_outliers_against_brute_force(spark):
    rng = np.random.default_rng(21)
    rows, want = [], set()
    for g, n, k, times in ((0, 60, 5, 1.5), (1, 5, 5, 1.5), (2, 90, 5, 1.5)):
        x = rng.normal(0, 1, (n, 3)) + (rng.random((n, 1)) < 0.1) * rng.normal(0, 8, (n, 3))
        rows += [(g, i, *map(float, p)) for i, p in enumerate(x)]
        d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), axis=1)[:, 1 : k + 1]
        mean = d.sum(1) / k
        keep = np.ones(n, dtype=bool) if n <= k + 1 else mean <= mean.mean() + times * mean.std()
        want |= {(g, int(i)) for i in np.flatnonzero(keep)}
    df = spark.createDataFrame(rows, "g int, i int, x double, y double, z double")
    got = {(r["g"], r["i"]) for r in cluster.remove_outliers(df, ["g"], "i", list("xyz"), 5, 1.5).collect()}
    assert got == want and len(want) < len(rows)


def test_neighbours_against_brute_force(spark):
    """Lone points far away, repeated points and ties are where a search by cells could go wrong."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, (120, 3)), rng.normal(50, 0.01, (40, 3)), np.array([[1e4, 0, 0], [0, 0, 0], [0, 0, 0], [0, 0, 0]]), rng.integers(0, 3, (40, 3))])
    df = spark.createDataFrame([(i % 2, i, *map(float, p)) for i, p in enumerate(x)], "g int, i int, x double, y double, z double")
    for k in (1, 4, 150):
        got = {}
        for r in cluster.knn(df, ["g"], "i", list("xyz"), k).collect():
            got.setdefault(r["a"], []).append((r["rank"], r["b"], r["d2"]))
        for a in range(len(x)):
            d = sorted((float(((x[a] - x[b]) ** 2).sum()), b) for b in range(a % 2, len(x), 2) if b != a)[:k]
            assert [b for _, b, _ in sorted(got[a])] == [b for _, b in d]


def test_room_objects_of_a_generated_scene(spark):
    """Three clouds with a stray point each: the label, the centre and the outline of what is left."""
    rng = np.random.default_rng(6)
    names, rows, want = ["lamp", "sofa", "rack"], [], {}
    for k, name in enumerate(names):
        x = rng.uniform(-0.5, 0.5, (30, 3)) + [4 * k, -k, 0.5]
        rows += [(70 + k, name, *map(float, p)) for p in [*x, [4 * k, 25.0, 0.0]]]
        want[70 + k] = (name, x)
    df = spark.createDataFrame(rows, "object_id int, label string, x double, y double, z double")
    signs = spark.createDataFrame([(71, "way out: up")], "object_id int, text string")
    got = {r["ident"]: r for r in objects.room_objects(df, 9, signs).collect()}
    assert set(got) == set(want)
    for k, (name, x) in want.items():
        o = got[k]
        assert (o["vehicle_id"], o["label"], o["room_ident"], o["direction"]) == (9, name, None, "way out: up" if k == 71 else "")
        assert {(p["x"], p["y"]) for p in o["polygon"]} <= set(map(tuple, x[:, :2].tolist()))
        assert abs(o["centroid"]["x"] - x[:, 0].mean()) < 0.1 and abs(o["centroid"]["y"] - x[:, 1].mean()) < 0.1


def test_changes_against_a_dictionary(spark):
    """Random snapshots: what is new or differs from the last that was sent; what is gone is never told."""
    rng = np.random.default_rng(17)
    schema, sent, told, want, held = "id int, label string, size int", {}, [], [], {}
    step = folds.delta_step("id", ["label", "size"], ["id", "label", "size"])
    last = spark.createDataFrame([], schema)
    for _ in range(6):
        now = {int(i): (["p", "q"][int(rng.integers(0, 2))], int(rng.integers(0, 3))) for i in rng.choice(6, 4, replace=False)}
        df = spark.createDataFrame([(i, *v) for i, v in now.items()], schema)
        got = {r["id"] for r in objects.changed_since(df, last, ["id"], ["label", "size"]).collect()}
        assert got == {i for i, v in now.items() if sent.get(i) != v}
        want += [i for i in now if i in got]
        for i, v in now.items():
            state, out = step(held.get(i, {}), pd.DataFrame([(i, *v)], columns=["id", "label", "size"]))
            held[i] = state
            told += out["id"].tolist()
        sent.update(now)
        last = spark.createDataFrame([(i, *v) for i, v in sent.items()], schema)
    assert told == want


def test_single_flight(spark):
    df = spark.createDataFrame([("r", t, i) for i, t in enumerate([0, 3, 10, 11, 25])], "run string, t long, i long")
    assert [r["i"] for r in objects.single_flight(df, "run", "t", "i", 10).orderBy("t").collect()] == [0, 2, 4]


# --- clusters --------------------------------------------------------------------------------------


def blobs(seed=0, noise=5):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(0, 0.05, (40, 3)), rng.normal(0, 0.05, (40, 3)) + 2, rng.uniform(-4, 6, (noise, 3))])


def test_density_clusters_of_two_blobs():
    x = blobs()
    for leaf in (False, True):
        lab = cluster.flat_clusters(cluster.linkage(x, 5), len(x), 10, leaf=leaf)
        a, b = set(lab[:40]) - {-1}, set(lab[40:80]) - {-1}
        assert a and b and not a & b
    one = cluster.flat_clusters(cluster.linkage(x[:40], 5), 40, 10, allow_single=True)
    assert (one >= 0).sum() >= 30 and one.max() == 0
    assert cluster.flat_clusters(cluster.linkage(x[:5], 2), 5, 10).max() == -1
    same = cluster.flat_clusters(cluster.linkage(np.zeros((20, 3)), 3), 20, 5, allow_single=True)
    assert len(set(same)) == 1


def test_linkage_of_many_points_in_little_memory():
    """Two far blobs of 3,000 points: the last merge spans the gap, and no matrix of all pairs is made."""
    import tracemalloc

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (3000, 3)), rng.normal(0, 1, (3000, 3)) + 50])
    tracemalloc.start()
    tree = cluster.linkage(x, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(tree) == 5999 and tree[-1, 3] == 6000 and tree[-1, 2] > 40 > tree[-2, 2] and peak < 40e6


def test_split_by_radius_against_loops():
    rng = np.random.default_rng(2)
    x, labels = rng.uniform(0, 3, (150, 2)), rng.integers(-1, 2, 150)
    got = cluster.split_by_radius(x, labels, 0.3)
    assert ((got < 0) == (labels < 0)).all()
    near = (cluster.distances2(x) <= 0.09) & (labels[:, None] == labels[None, :])
    reach = np.linalg.matrix_power(near.astype(np.int64) > 0, 1)
    for _ in range(8):
        reach = (reach.astype(np.int64) @ reach.astype(np.int64)) > 0
    for i in np.flatnonzero(labels >= 0):
        assert (reach[i] == (got == got[i])).all()


def test_linkage_is_single_linkage_of_reachability():
    x = blobs(3)[:30]
    d = np.sqrt(cluster.distances2(x))
    core = np.sort(d, axis=1)[:, 3]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    heights = sorted(cluster.linkage(x, 4)[:, 2])
    left, total = set(range(1, 30)), []
    tree = {0}
    while left:
        w, j = min((reach[i, j], j) for i in tree for j in left)
        total.append(w)
        tree.add(j)
        left.remove(j)
    assert np.allclose(sorted(total), heights)


def test_small_classes_have_no_clusters(spark):
    df = spark.createDataFrame([(0, i, float(i % 3), 0.0, 0.0) for i in range(15)], "g int, i int, x double, y double, z double")
    assert cluster.cluster_classes(df, ["g"], "i", list("xyz"), 3, 3, 3).count() == 0


def test_a_hub_is_split(spark):
    edges = spark.range(1, 120_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    both = tables.settle(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).repartition(8))
    hubs = tables.hot_keys(both, "b")
    assert [r["b"] for r in hubs.collect()] == [0] and tables.hot_keys(both.limit(1000), "b") is None
    labels = both.select(F.col("a").alias("b"), F.col("a").alias("comp")).distinct()
    joined = tables.join_split(both, labels, "b", hubs).withColumn("p", F.spark_partition_id())
    sizes = [r["count"] for r in joined.where("b = 0").groupBy("p").count().collect()]
    assert joined.count() == 240_000 and sum(sizes) == 120_000 and max(sizes) < 60_000
    got = tables.components(edges)
    assert got.count() == 120_001 and got.where("comp <> 0").count() == 0


@pytest.mark.parametrize("least", [10, 50_000])
def test_components_against_union_find(spark, monkeypatch, least):
    monkeypatch.setattr(tables, "HOT_ROWS", least)
    monkeypatch.setattr(tables.hot_keys, "__defaults__", (least,))
    rng = np.random.default_rng(5)
    for edges in ([tuple(map(int, e)) for e in rng.integers(0, 300, (200, 2))], [(i, i + 1) for i in range(200)], [(7, i) for i in range(8, 60)]):
        p = {v: v for e in edges for v in e}

        def root(v):
            while p[v] != v:  # noqa: B023
                v = p[v]  # noqa: B023
            return v

        for a, b in edges:
            a, b = root(a), root(b)
            p[max(a, b)] = min(a, b)
        got = {r["node"]: r["comp"] for r in tables.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {v: root(v) for v in p}


def test_growth():
    def row(k, cls, item, x, kind):
        return {kind: k, f"{kind}_cls": cls, "item": item, "cls": cls, "x": x, "y": 0.0, "z": 0.0, "vx": int(x * 10), "vy": 0, "vz": 0}

    prop = pd.DataFrame([row(0, 1, i, i / 10 + 0.05, "prop") for i in range(4)])
    seg = pd.DataFrame([row(0, 1, i, i / 10 + 0.05, "seg") for i in range(2, 6)] + [row(1, 1, i, i / 10 + 0.05, "seg") for i in range(5, 8)] + [row(2, -1, i, i / 10 + 0.05, "seg") for i in range(0, 2)])
    out = grow(seg, prop, list("xyz"), ["vx", "vy", "vz"], Growth(margin=0.2, threshold=0.3))
    assert sorted(out["item"]) == list(range(8))  # the second segment only touches what the first added
    solo = grow(seg, prop, list("xyz"), ["vx", "vy", "vz"], Growth(margin=0.2, threshold=0.3, overlap=False))
    assert sorted(solo["item"]) == list(range(8)) and not solo["item"].duplicated().any()
    assert sorted(grow(seg, prop, list("xyz"), ["vx", "vy", "vz"], Growth(margin=0.2, threshold=0.99))["item"]) == [0, 1, 2, 3]


# --- merging ---------------------------------------------------------------------------------------


def cells(a, b):
    return [(i,) for i in range(a, b)]


def frame(state, n, *props, merge_now=True):
    touched = [state.add(n, k, cls, c, ids) for k, (cls, c, ids) in enumerate(props)]
    if merge_now:
        state.settle_frame(np.concatenate(touched))


def test_deferred_merge_needs_evidence():
    c = merge.Components(merge.Merging(bars=(0.3,), min_evidence=2.0))
    frame(c, 0, (1, cells(0, 10), {1}), (1, cells(20, 30), {2}), (2, cells(0, 10), {3}))
    assert len(c.live) == 3  # classes do not mix
    frame(c, 1, (1, cells(0, 30), {4}))
    assert len(c.live) == 3
    frame(c, 2, (1, cells(0, 30), {4}))
    frame(c, 3, (1, cells(0, 30), {-1}))
    t = c.table()
    assert len(t) == 2
    big = int(c.home[0])
    row = t.iloc[c.live.tolist().index(big)]
    assert (row["cls"], row["n_cells"], row["birth_frame"], row["birth_prop"], row["support"]) == (1, 30, 0, 0, 5) and c.ids[big] == {1, 2, 4}


def test_immediate_merge_bridges():
    c = merge.Components(merge.Merging(bars=(0.3,), deferred=False))
    frame(c, 0, (1, cells(0, 10), {}), (1, cells(20, 30), {}), (1, cells(5, 25), {}), merge_now=False)
    assert len(c.live) == 1 and c.table()["support"].tolist() == [3] and c.cells() == [[[i] for i in range(30)]]


def test_region_vetoes_a_merge():
    for sums, left in (([[2.0, 2.0], [0.02, 2.0]], 3), ([[2.0, 2.0], [2.0, 2.0]], 2)):
        c = merge.Components(merge.Merging(bars=(0.6,), min_evidence=1.0, decay=1.0))
        frame(c, 0, *((1, cells(100 * k, 100 * k + 10), {}) for k in range(4)), merge_now=False)
        c.pairs, c.sums = np.array([[0, 1], [1, 2]]), np.array(sums)
        if left == 2:  # 0 is like 1's other neighbour as well
            c.pairs, c.sums = np.array([[0, 1], [1, 2], [0, 2]]), np.array([[2.0, 2.0]] * 3)
        c.settle_frame(np.array([[0, 1], [1, 2]]) if left == 2 else np.array([[0, 1]]))
        assert len(c.live) == left + 1 - (left == 2)


def test_neighbourhood_score_against_loops():
    rng = np.random.default_rng(3)
    n = 7
    linked = np.triu(rng.random((n, n)) < 0.5, 1)
    linked = (linked | linked.T).astype(float)
    adj, w = rng.random((n, n)), rng.integers(1, 9, n).astype(float)
    adj = np.triu(adj, 1) + np.triu(adj, 1).T
    adj *= linked
    got = merge.neighbourhood(adj, linked, w, 0.4)
    for a in range(n):
        for b in range(n):
            if linked[a, b]:
                terms = [(w[b], adj[a, b])] + [(0.4 * w[k], adj[a, k]) for k in range(n) if linked[b, k] and k != a]
                assert got[a, b] == pytest.approx(sum(x * y for x, y in terms) / sum(x for x, _ in terms))


def test_small_components_are_absorbed():
    c = merge.Components(merge.Merging(small=2))
    frame(c, 0, *((1, cells(100 * k, 100 * k + 10), {}) for k in range(4)), merge_now=False)
    c.support[0] = 5
    c.pairs, c.sums = np.array([[0, 1], [1, 2], [0, 2]]), np.array([[1.0, 2.0], [0.2, 2.0], [1.8, 2.0]])
    c.absorb_small()
    assert len(c.live) == 2 and c.home[1] == c.home[0] == c.home[2] and c.home[3] == 3 and c.support[c.home[0]] == 7


def test_exclusive_elements_have_one_owner():
    c = merge.Components(merge.Merging(bars=(0.9,), overlap=False))
    frame(c, 0, (1, cells(0, 10), {}), (1, cells(8, 20), {}), (1, cells(5, 12), {}), merge_now=False)
    held = [tuple(x) for k in c.cells() for x in k]
    assert len(held) == len(set(held)) == 20


def test_many_cells_and_components_outgrow_the_arrays():
    c = merge.Components(merge.Merging(bars=(0.5,), min_evidence=1.0))
    for f in range(3):
        frame(c, f, *((k % 3, cells(200 * k, 200 * k + 150 + f), {k}) for k in range(40)))
    t = c.table()
    assert len(t) == 40 and (t["support"] == 3).all() and (t["n_cells"] == 152).all()


def brute_fold(rows, bars, overlap_only=False):
    """Union of proposals at once, by sets and loops: the immediate fold with overlapping sets and one class."""
    comps = []
    for cs in rows:
        hit = [k for k in comps if len(k["c"] & cs) / max(1, min(len(k["c"]), len(cs))) >= bars[min(max(k["s"], 1), len(bars)) - 1] and k["c"] & cs]
        new = {"c": set(cs).union(*(k["c"] for k in hit)), "s": 1 + sum(k["s"] for k in hit)}
        comps = [k for k in comps if k not in hit] + [new]
    return sorted((k["s"], len(k["c"])) for k in comps)


def test_immediate_fold_against_sets():
    rng = np.random.default_rng(10)
    for _ in range(20):
        rows = [set(map(int, rng.integers(0, 60, rng.integers(1, 25)))) for _ in range(25)]
        bars = (0.7, 0.5, 0.4)
        c = merge.Components(merge.Merging(bars=bars, deferred=False))
        for k, cs in enumerate(rows):
            c.add(0, k, 1, [(x,) for x in sorted(cs)])
        t = c.table()
        assert sorted(zip(t["support"], t["n_cells"], strict=True)) == brute_fold(rows, bars)


def test_components_by_stream_and_batch(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(0, 2)), f, p, 0, int(x)) for f in range(6) for p in range(3) for x in rng.integers(0, 12, 6)]
    df = spark.createDataFrame(rows, "cls int, frame long, prop long, inst long, vx int").dropDuplicates()
    p = merge.Merging(bars=(0.4,), min_merges=2)
    batch = {(r["cls"], r["birth_frame"], r["birth_prop"], r["support"], r["n_cells"]) for r in merge.consolidate(df, ["vx"], p).collect()}
    state = {}
    run = folds.components_step(["vx"], p)
    last = set()
    for cls, g in df.toPandas().groupby("cls"):
        held = merge.Components(p)
        for _, f in g.groupby("frame", sort=True):
            held, out = run(held, f)
        last |= {tuple(x) for x in out[["cls", "comp_birth_frame", "comp_birth_prop", "support", "n_cells"]].itertuples(index=False, name=None)}
        state[cls] = held
    assert last == batch


# --- maps, votes, views ----------------------------------------------------------------------------


def test_ids_follow_arrival(spark):
    df = spark.createDataFrame([(1, 5, 1.0), (2, 1, 2.0), (1, 9, 3.0), (3, 1, 4.0), (2, 0, 0.0)], "c int, at int, v double")
    m = fuse.fuse(df, ["c"], ["v"], F.col("at").cast("long"), 2)
    assert {r["c"]: (r["gidx"], r["n"]) for r in m.collect()} == {2: (0, 2), 3: (1, 1), 1: (2, 2)}  # 2 at 0, 3 at 1, 1 at 5


def test_votes(spark):
    v = spark.createDataFrame([(1, 0, 5), (1, 1, 5), (2, 0, 3), (2, 7, 2), (3, 0, 1)], "k int, c int, votes long")
    got = {r["k"]: r["class_id"] for r in votes.resolve(v, ["k"], "c", F.col("c") == 7, bias=2.0, min_votes=2).collect()}
    assert got == {1: 0, 2: 7, 3: None}
    strict = votes.resolve(v, ["k"], "c", F.lit(False), min_conf=0.55).collect()
    assert {r["k"]: r["class_id"] for r in strict} == {1: None, 2: 0, 3: 0}
    many = spark.range(70_000).select(F.lit(1).alias("k"), F.lit(2).alias("c"))
    assert votes.tally(many, ["k"], "c").first()["votes"] == votes.SATURATION


def test_vocabulary():
    assert votes.declare(["door", "box", "door"], ["wall", "box"]) == [(0, "door", 1), (1, "box", 1), (2, "wall", 2)]
    assert votes.model_labels(["b", "a", "b"], ["a"]) == ["a", "b", "b", "a"]


def test_depth_buffer_against_loops(spark):
    rng = np.random.default_rng(2)
    pts = [(int(rng.integers(-3, 13)), int(rng.integers(-3, 11)), float(rng.uniform(1, 5)), int(rng.integers(0, 3)), i) for i in range(120)]
    z = {}
    for u, v, d, r, _ in pts:
        for a in range(max(0, u - r), min(9, u + r) + 1):
            for b in range(max(0, v - r), min(7, v + r) + 1):
                z[a, b] = min(d, z.get((a, b), 9e9))
    df = spark.createDataFrame(pts, "u int, v int, d double, r int, i int").withColumn("view", F.lit(0))
    buf = project.depth_buffer(df, ["view"], "u", "v", "d", F.col("r"), 10, 8)
    assert {(r["u"], r["v"]): r["z"] for r in buf.collect()} == z
    seen = {r["i"]: r["visible"] for r in project.visible(df, buf, ["view"], "u", "v", "d", 0.5).collect()}
    assert seen == {i: abs(d - z[u, v]) <= 0.5 for u, v, d, _, i in pts if 0 <= u < 10 and 0 <= v < 8}


def test_range_join_against_loops(spark):
    rng = np.random.default_rng(4)
    f, p = rng.uniform(-2, 2, (5, 3)), rng.uniform(-2, 2, (80, 3))
    fr = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(f)], "f int, fx double, fy double, fz double")
    pt = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "i int, x double, y double, z double")
    got = {(r["f"], r["i"]) for r in project.within(fr, pt, ["fx", "fy", "fz"], list("xyz"), 0.9).collect()}
    assert got == {(a, b) for a in range(5) for b in range(80) if ((f[a] - p[b]) ** 2).sum() <= 0.81}


def test_panoptic(spark):
    m = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.8), (1, 0, 0.95), (1, 1, 0.4), (2, 2, 0.3)], "query long, pixel long, m double")
    q = spark.createDataFrame([(0, 0.9, "a", True), (1, 0.5, "b", False), (2, 1.0, "c", True)], "query long, score double, label string, thing boolean")
    assert [(r["pixel"], r["query"], r["segment"]) for r in panoptic.resolve_segments(m, q, 0.5).orderBy("pixel").collect()] == [(0, 0, 1), (1, 0, 1)]
    p = one(spark, panoptic.softmax(F.array(F.lit(1.0), F.lit(1.0))), panoptic.with_void(F.array(F.lit(0.5), F.lit(0.5)), F.lit(0.2)), panoptic.geometric_ensemble(F.array(F.lit(0.25)), F.array(F.lit(1.0)), 0.5))
    assert p["c0"] == [0.5, 0.5] and p["c1"] == [0.4, 0.4, 0.2] and p["c2"] == [0.5]


def test_masks(spark):
    a = spark.createDataFrame([(2, 2), (3, 2)], "u int, v int")
    d = overlap.dilate(a, 1, 10, 10)
    assert d.count() == 12 and overlap.dilate(a, 1, 10, 10, four=True).count() == 8
    assert {tuple(r) for r in overlap.erode(d, 1).collect()} == {(2, 2), (3, 2)}
    full = spark.createDataFrame([(u, v) for u in range(4) for v in range(2)], "u int, v int")
    assert overlap.downsample(full, 2).count() == 2


# --- scalars ---------------------------------------------------------------------------------------


def test_geometry(spark):
    r, p, y = 0.3, -0.4, 1.1
    L = [F.lit(x) for x in (r, p, y)]
    rot, quat = G.euler_to_rotation(*L), G.quaternion_to_rotation(G.euler_to_quaternion(*L))
    got = one(spark, *rot, *quat, *G.rotation_to_euler(rot))
    v = list(got)
    assert np.allclose(v[:9], v[9:18]) and np.allclose(v[18:], (r, p, y))
    m = np.array(v[:9]).reshape(3, 3)
    assert np.allclose(m @ m.T, np.eye(3))
    t = [F.lit(float(k)) for k in (1, 2, 3)]
    ri, ti = G.invert(rot, t)
    rr, tt = G.compose(rot, t, ri, ti)
    assert np.allclose(list(one(spark, *rr, *tt)), [1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0])
    q0, q1 = G.euler_to_quaternion(F.lit(0.0), F.lit(0.0), F.lit(0.0)), G.euler_to_quaternion(F.lit(0.0), F.lit(0.0), F.lit(1.0))
    half = G.quaternion_to_rotation(G.slerp(q0, [-c for c in q1], F.lit(0.5)))
    assert abs(one(spark, half[3])[0] - np.sin(0.5)) < 1e-9
    eye, zero = [F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)], [F.lit(0.0)] * 3
    px = G.pixel(G.projection(F.lit(100.0), F.lit(100.0), F.lit(2.0), F.lit(1.0), eye, zero), [F.lit(0.1), F.lit(0.0), F.lit(2.0)])
    assert list(one(spark, *px)) == [7, 1, 2.0]
    assert one(spark, *G.pixel(G.projection(*[F.lit(1.0)] * 4, eye, zero), [F.lit(0.0), F.lit(0.0), F.lit(-1.0)]))[0] is None


def test_small_functions(spark):
    a = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    got = one(spark, vectors.cosine(a(1, 0), a(1, 1)), vectors.cosine(a(0, 0), a(1, 1)), vectors.cosine(a(1), a(1, 1)), ids.node_key(F.lit(211), F.lit(5)), text.split_list(F.lit(" a, ,b ")), text.synonyms(F.lit("box"), F.lit("crate, box")), timeconv.ns_to(F.lit(-1500), "us"), ids.export_label(F.lit(None).cast("int")))
    assert abs(got[0] - 0.5**0.5) < 1e-12 and got[1] == got[2] == 0 and got[3] == (211 << 48) ^ 5
    assert got[4] == ["a", "b"] and got[5] == ["box", "crate"] and got[6] == -1 and got[7] == 0
    pairs = F.array(F.struct(F.lit("Exit").alias("content"), F.lit("left").alias("direction")), F.struct(F.lit("").alias("content"), F.lit("").alias("direction")))
    assert one(spark, text.join_instructions(pairs))[0] == "Exit: left"
    back = ids.rgb_of(ids.id_of_rgb(F.lit(1), F.lit(2), F.lit(3)))
    assert list(one(spark, *back)) == [1, 2, 3]


def test_keyed_fold(spark):
    df = spark.createDataFrame([("a", 1), ("b", 9), ("a", 0)], "k string, t long")
    run = folds.gate_step("k", "t", "t2", 5)
    out = keyed.fold_batch(df.withColumn("t2", F.col("t")), "k", ["t"], dict, run, "k string, t long, t2 long, done_t long")
    assert {(r["k"], r["t"]) for r in out.collect()} == {("a", 0), ("b", 9)}


@pytest.mark.parametrize("overlap", [True, False])
def test_growth_by_atoms(spark, monkeypatch, overlap):
    """Items that are alike come to a frame's task as one row, and grow as they do one by one."""
    from voxloom.operators.grow import atoms, grow_frames

    rng = np.random.default_rng(8)
    pos = rng.integers(0, 5, (3000, 2))
    item = pd.DataFrame({"frame": np.repeat([0, 1, 2], 1000), "item": np.arange(3000), "cls": pos.sum(1) % 2, "x": pos[:, 0] / 1.0, "y": pos[:, 1] / 1.0, "z": 0.0, "vx": pos[:, 0], "vy": pos[:, 1], "vz": 0})
    seg = item.assign(seg=pos[:, 0] + 10 * (pos[:, 1] // 3), seg_cls=1)
    seg = seg[seg["frame"] < 2]
    seg = pd.concat([seg, seg[seg["item"] % 1000 == 7]])  # a row twice
    prop = item[(pos == 2).all(1) | (pos == 0).all(1)].assign(prop=lambda d: d["x"].astype(int) % 4, prop_cls=1)
    rule, xyz, cell = Growth(margin=1.0, threshold=0.1, overlap=overlap), list("xyz"), ["vx", "vy", "vz"]
    want = set()
    for f, b in prop.groupby("frame"):
        a = seg[seg["frame"] == f]
        out = grow(a, b, xyz, cell, rule) if len(a) else b[["prop", "item"]].assign(added=False)
        want |= {(f, *r) for r in out[["prop", "item", "added"]].itertuples(index=False, name=None)}
    s, p = (spark.createDataFrame(d) for d in (seg, prop))
    got = [tuple(r) for r in grow_frames(s, p, "frame", xyz, cell, rule).collect()]
    assert len(got) == len(set(got)) and set(got) == want and any(r[3] for r in got)
    assert atoms(s, p, "frame", xyz, cell)[1].count() < 200
