"""A small scene from scans and labelled pixels to objects."""

import math

from voxloom.plans.pipeline import Camera, Pipeline
from voxloom.sources.config import from_dict


def scene(spark):
    """Two boxes before a wall, seen from the same place six times with a slow turn."""
    scans, images, pixels = [], [], []
    pts = [(4.0, y / 20, z / 20, "wall", -1) for y in range(-40, 41) for z in range(-10, 11)]
    pts += [(2.0, 0.6 + y / 20, z / 20, "box", 1) for y in range(-4, 5) for z in range(-4, 5)]
    pts += [(2.0, -0.6 + y / 20, z / 20, "chair", 2) for y in range(-4, 5) for z in range(-4, 5)]
    cam = Camera(60.0, 60.0, 64.0, 32.0, 128, 64, [0.0, 0, 1, -1, 0, 0, 0, -1, 0])
    for k in range(7):
        t = k * 100_000_000
        yaw = 0.002 * k
        c, s = math.cos(-yaw), math.sin(-yaw)
        scans += [("r", t, c * x - s * y, s * x + c * y, z, 1, 0.0, 0.0, 0.0, 0.0, 0.0, yaw) for x, y, z, _, _ in pts]
        scans.append(("r", t, 0.0, 0.0, 0.0, 1, 0.0, 0.0, 0.0, 0.0, 0.0, yaw))
    for k in range(6):
        t = k * 100_000_000 + 40_000_000
        images.append(("r", k, t))
        yaw = 0.002 * (k + 0.4)
        depth = {}
        for x, y, z, name, inst in pts:
            a, b = math.cos(yaw) * x + math.sin(yaw) * y, -math.sin(yaw) * x + math.cos(yaw) * y
            u, v = math.floor(60 * -b / a + 64.5), math.floor(60 * -z / a + 32.5)
            for du in (-1, 0, 1):
                for dv in (-1, 0, 1):
                    if 0 <= u + du < 128 and 0 <= v + dv < 64 and a < depth.get((u + du, v + dv), (9e9,))[0]:
                        depth[u + du, v + dv] = (a, name, inst)
        pixels += [("r", k, u, v, n, i) for (u, v), (_, n, i) in depth.items()]
    s = spark.createDataFrame(scans, "run string, t long, x float, y float, z float, intensity short, px double, py double, pz double, roll double, pitch double, yaw double")
    return cam, s, spark.createDataFrame(images, "run string, image_id long, t long"), spark.createDataFrame(pixels, "run string, image_id long, u int, v int, name string, instance int")


CONFIG = {
    "voxel": 0.05, "tau": 0.2, "splat": 3, "splat_mult": 1.2, "splat_min": 1, "surf_band": 0.1, "proj_radius": 7.5, "cam": 211,
    "voting": {"enabled": True, "min_votes": 2, "min_conf": 0.2},
    "superpoints": {"enabled": True, "seed": 0.35, "thing_frac": 0.1},
    "hdbscan": {"enabled": True, "min_pts": 5, "min_cluster_size": 10, "min_class_points": 10, "allow_single_cluster": True, "single_scan": False, "split_radius": 0.2},
    "grow": {"enabled": True, "affinity": 0.12, "sweeps": 2},
    "objects": {"enabled": True, "min_merges": 3, "global_context": True, "overlap_sets": True},
}


def test_scene(spark):
    cam, scans, images, pixels = scene(spark)
    r = Pipeline(spark, cam, from_dict(CONFIG)).batch(scans, images, pixels)
    assert r.frames.count() == 6
    objects = {o["label"]: o for o in r.objects.collect()}
    assert set(objects) == {"box", "chair"}
    assert abs(objects["box"]["centroid"]["y"] - 0.6) < 0.1 and abs(objects["chair"]["centroid"]["y"] + 0.6) < 0.1
    assert all(o["vehicle_id"] == 211 and o["direction"] == "" and o["room_ident"] is None for o in objects.values())
    named = {c["class_id"] for c in r.points.where("class_id IS NOT NULL").select("class_id").distinct().collect()}
    assert len(named) == 3
    g = [x["gidx"] for x in r.points.select("gidx").collect()]
    assert sorted(g) == list(range(len(g)))


def test_no_input(spark):
    cam, scans, _, pixels = scene(spark)
    assert Pipeline(spark, cam).run_on_input(scans, None, pixels).count() == 0


def with_settings(**sections):
    return from_dict({k: {**v, **sections.get(k, {})} if isinstance(v, dict) else v for k, v in CONFIG.items()} | {k: v for k, v in sections.items() if not isinstance(v, dict)})


def test_settings_act(spark):
    """Each switch that a run configuration has, on the same scene."""
    cam, scans, images, pixels = scene(spark)
    run = lambda **k: Pipeline(spark, cam, with_settings(**k)).batch(scans, images, pixels)
    names = lambda r: sorted(o["label"] for o in r.objects.collect())
    assert names(run(hdbscan={"single_scan": True, "allow_single_cluster": False})) == ["box", "chair"]
    off = run(hdbscan={"enabled": False})
    assert off.proposals.count() == 0 and off.objects.count() == 0 and off.points.count() > 0
    none = run(objects={"enabled": False})
    assert none.proposals.count() > 0 and none.components.count() == 0 and none.objects.count() == 0
    assert run(superpoints={"refine": 3}).proposals.count() > 0


def test_without_voting_a_label_lasts_for_its_frame(spark):
    cam, scans, images, pixels = scene(spark)
    last = pixels.selectExpr("run", "image_id", "u", "v", "IF(image_id = 5 AND name = 'box', 'table', name) AS name", "instance")
    run = lambda on: Pipeline(spark, cam, with_settings(voting={"enabled": on})).batch(scans, images, last)
    kinds = {r["class_id"]: r["name"] for r in Pipeline(spark, cam).vocabulary().collect()}
    seen = lambda r: {kinds[x["class_id"]] for x in r.points.where("class_id IS NOT NULL").select("class_id").distinct().collect()}
    assert seen(run(True)) == {"box", "chair", "wall"} and seen(run(False)) == {"table", "chair", "wall"}


def test_images_that_cannot_be_read_are_an_error(spark):
    import pytest
    from pyspark.sql import functions as F

    cam, scans, images, pixels = scene(spark)
    with pytest.raises(ValueError, match="cannot be read"):
        Pipeline(spark, cam).run_on_input(scans, images.withColumn("rgb", F.lit(None).cast("binary")), pixels)
    twice = images.unionByName(images.withColumn("image_id", F.col("image_id") + 100))
    with pytest.raises(ValueError, match="more than one"):
        Pipeline(spark, cam).run_on_input(scans, twice, pixels)
