"""Kills that act on later frames, runs in steps, frustum candidates, and the map as a stream."""

import math
import random

import pytest
from pyspark.sql import functions as F

from voxloom.functions import geometry as G
from voxloom.operators import feedback, project
from voxloom.plans.pipeline import Camera, Online, Pipeline
from voxloom.sources.config import from_dict
from voxloom.streaming import mapstate


def sequential(points, frames, dynamic):
    """Frame by frame: fuse, look at the nearest live cell of each column, kill it where the label says so."""
    cells, seen = {}, []
    for f in frames:
        for run, u, z, fr, x in points:
            if fr == f:
                c = cells.setdefault((run, u, z), {"alive": False})
                if not c["alive"]:
                    c |= {"alive": True, "n": 0, "x": 0}
                c["n"], c["x"] = c["n"] + 1, c["x"] + x
        front = {}
        for (run, u, z), c in cells.items():
            if c["alive"]:
                front[run, u] = min(front.get((run, u), 10**9), z)
        for (run, u), z in front.items():
            kill = (run, u, f) in dynamic
            seen.append((run, u, z, f, kill))
            if kill:
                cells[run, u, z]["alive"] = False
    return sorted((k, c["alive"], c["n"], c["x"]) for k, c in cells.items()), sorted(seen)


@pytest.mark.parametrize("seed", [0, 1])
def test_kills_act_on_later_frames(spark, seed):
    rng = random.Random(seed)
    frames = range(1, 13)
    points = [(r, rng.randrange(3), rng.randrange(4), rng.choice(frames), rng.randrange(9)) for r in "ab" for _ in range(60)]
    dynamic = {(r, u, f) for r in "ab" for u in range(3) for f in frames if rng.random() < 0.3}
    want, shown = sequential(points, frames, dynamic)
    df = spark.createDataFrame(points, "run string, u int, z int, frame int, x long")
    table = spark.createDataFrame([(r, f) for r in "ab" for f in frames], "run string, frame int")
    bad = spark.createDataFrame([(*d, True) for d in dynamic], "run string, u int, frame int, kill boolean")
    looked = []

    def look(now, state):
        looked.append(now.count())
        at = state.withColumn("now", F.explode(F.sequence("frame", F.least(F.col("until") - 1, F.lit(12))))).where(~feedback.dead(F.col("now")))
        at = at.select("run", "u", "z", F.col("now").alias("frame"), F.lit(0).alias("v")).join(now, ["run", "frame"], "left_semi")
        front = project.front_shell(at, ["run", "frame"], "u", "v", "z", 0.0)
        return front.join(bad, ["run", "u", "frame"], "left").select("run", "u", "z", "frame", F.coalesce("kill", F.lit(False)).alias("kill"))

    per = feedback.per_frame(df, ["run", "u", "z"], "frame", ["x"])
    state, shell = feedback.settle_kills(per, table, ["run"], ["run", "u", "z"], "frame", ["x"], look)
    assert sorted(map(tuple, shell.select("run", "u", "z", "frame", "kill").collect())) == shown
    last = feedback.latest(state, "frame").collect()
    assert sorted(((r.run, r.u, r.z), r.killed is None, r.n, r.sum_x) for r in last if r.killed is None) == [w for w in want if w[1]]
    assert {(r.run, r.u, r.z) for r in last if r.killed is not None} == {w[0] for w in want if not w[1]}
    assert looked[0] == 24 and all(a >= b for a, b in zip(looked, looked[1:], strict=False)) and len(looked) <= 14


CAM = Camera(40.0, 40.0, 32.0, 24.0, 64, 48, [0.0, 0, 1, -1, 0, 0, 0, -1, 0])


def street(spark):
    """A door that someone stands before: a person in front of it, labelled so from the third image on only."""
    wall = [(4.0, y / 10, z / 10) for y in range(-8, 9) for z in range(-6, 7)]
    person = [(3.95, y / 10, z / 10) for y in range(-2, 3) for z in range(-6, 7)]
    scans, images, pixels = [], [], []
    for k in range(7):
        pts = wall + (person if k < 3 else [])
        scans += [("r", k * 100, x, y, z, 1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) for x, y, z in pts]
    for k in range(6):
        images.append(("r", k, k * 100 + 10))
        for u in range(64):
            for v in range(48):
                y = -(u - 32) * 4.0 / 40
                pixels.append(("r", k, u, v, "person" if k >= 2 and k % 2 == 0 and abs(y) < 0.25 else "door" if abs(y) < 0.5 else "wall", -1))
    s = spark.createDataFrame(scans, "run string, t long, x float, y float, z float, intensity short, px double, py double, pz double, roll double, pitch double, yaw double")
    return s, spark.createDataFrame(images, "run string, image_id long, t long"), spark.createDataFrame(pixels, "run string, image_id long, u int, v int, name string, instance int")


STREET = {"voxel": 0.03, "tau": 0.02, "splat": 1, "surf_band": 0.01, "thing": ["door"], "stuff": ["wall"], "dynamic": ["person"], "hdbscan": {"enabled": False}}


def table(df, *cols):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("radius", [0.0, 20.0])
def test_steps_equal_the_batch(spark, radius):
    scans, images, pixels = street(spark)
    config = from_dict(STREET | {"proj_radius": radius})
    whole = Pipeline(spark, CAM, config).batch(scans, images, pixels)
    assert whole.shell.where("kill").count() > 0
    seen, lists = [], []
    pipeline = Pipeline(spark, CAM, config)
    online = Online(pipeline, on_frame=lambda f, shell: seen.append((f.count(), shell.count())), on_objects=lambda o: lists.append(o.count()))
    synced = pipeline.sync(scans, images)
    for lo, hi in ((1, 1), (2, 3), (4, 6)):
        online.step(synced.where(F.col("frame").between(lo, hi)), scans, pixels)
    got = online.finish()
    assert [n for n, _ in seen] == [1, 2, 3] and lists == [0, 0, 0, 0]
    cell = ["run", "frame", "vx", "vy", "vz"]
    assert table(got.shell, *cell, "kill", "name") == table(whole.shell, *cell, "kill", "name")
    facts = ["run", "vx", "vy", "vz", "n", "x", "alive", "first", "gidx"]
    assert table(got.points, *facts) == table(whole.points, *facts)
    # what was killed is not seen again before it is fused anew
    killed = whole.shell.where("kill").select("run", "vx", "vy", "vz", F.col("frame").alias("k"))
    state = whole.points.where("NOT alive").select("run", "vx", "vy", "vz").join(killed.groupBy("run", "vx", "vy", "vz").agg(F.max("k").alias("k")), ["run", "vx", "vy", "vz"])
    assert whole.shell.join(state, ["run", "vx", "vy", "vz"]).where("frame > k").count() == 0 and state.count() > 0
    online.begin()
    assert online.map is None and online.steps == 0


def test_frusta_hold_all_that_shows(spark):
    """Random cameras in a random map: every pixel on the raster or in its margin, and few pairs besides."""
    rng = random.Random(4)
    edge, width, height, margin = 0.1, 80, 60, 3
    cells = spark.createDataFrame([("r", i, *(rng.randrange(-600, 600) for _ in range(3))) for i in range(3000)], "run string, i int, vx int, vy int, vz int")
    cells = cells.select("*", *(((F.col(c) + 0.5) * edge).alias(a) for c, a in zip(("vx", "vy", "vz"), "xyz", strict=True)))
    frames = []
    for k in range(12):
        q = [rng.gauss(0, 1) for _ in range(4)]
        n = math.sqrt(sum(x * x for x in q))
        frames.append(("r", k, *(x / n for x in q), *(rng.uniform(-30, 30) for _ in range(3))))
    f = spark.createDataFrame(frames, "run string, now int, q0 double, q1 double, q2 double, q3 double, t0 double, t1 double, t2 double")
    r = G.quaternion_to_rotation([F.col(f"q{i}") for i in range(4)])
    f = f.select("run", "now", "t0", "t1", "t2", *(x.alias(f"r{i}") for i, x in enumerate(r)))
    m = G.projection(*(F.lit(x) for x in (60.0, 60.0, 40.0, 30.0)), [F.col(f"r{i}") for i in range(9)], [F.col(f"t{i}") for i in range(3)])
    f = f.select("run", "now", *(x.alias(f"m{i}") for i, x in enumerate(m))).cache()
    u, v, _ = G.pixel([F.col(f"m{i}") for i in range(12)], [F.col(a) for a in "xyz"])
    every = f.join(cells, "run").select("now", "i", u.alias("u"), v.alias("v"))
    want = {(x.now, x.i) for x in every.where(F.col("u").between(-margin, width - 1 + margin) & F.col("v").between(-margin, height - 1 + margin)).collect()}
    got = {(x.now, x.i) for x in project.in_frusta(f, cells, "run", ["vx", "vy", "vz"], edge, width, height, margin).select("now", "i").collect()}
    assert want and want <= got and len(got) < 1.5 * len(want) + 50 < every.count() / 3


def simulate(ops, cap):
    out = {}
    for cell, _, op, cls, x in ops:
        c = out.setdefault(cell, {"epoch": 0, "alive": False, "n": 0, "x": 0, "v": {}})
        if op == mapstate.FUSE:
            if not c["alive"]:
                c |= {"alive": True, "n": 0, "x": 0, "v": {}}
            c["n"], c["x"] = c["n"] + 1, c["x"] + (x or 0)
        elif c["alive"] and op == mapstate.VOTE:
            c["v"][cls] = min(cap, c["v"].get(cls, 0) + 1)
        elif c["alive"] and op == mapstate.KILL:
            c |= {"epoch": c["epoch"] + 1, "alive": False, "n": 0, "x": 0, "v": {}}
    return {k: (c["epoch"], c["alive"], c["n"], c["x"], c["v"]) for k, c in out.items()}


def test_map_stream_over_files_and_restarts(spark, tmp_path):
    rng = random.Random(2)
    ops = [(rng.randrange(6), t, rng.choices([0, 1, 2], [5, 4, 1])[0], rng.randrange(3), rng.choice([1, 2, None])) for t in range(240)]
    at = str(tmp_path)
    schema = "cell int, t int, op int, cls int, x long"

    def start(write=None):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/ops")
        cells = mapstate.map_stream(stream, ["cell"], ["t"], "op", "cls", ["x"])
        with mapstate.state_store(spark):
            if write is None:
                return mapstate.publish(cells, at, "map")
            return cells.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{at}/map-checkpoint").trigger(availableNow=True).start()

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for k in range(5):
        spark.createDataFrame(ops[48 * k : 48 * k + 48], schema).coalesce(1).write.mode("append").parquet(f"{at}/ops")
        if k == 1:
            start().awaitTermination()
        if k == 2:  # a batch that fails is taken again, with the state that it began with

            def broken(batch, number):
                batch.count()
                raise OSError("lost")

            with pytest.raises(Exception, match="lost"):
                start(broken).awaitTermination()
    start().awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    got = {r.cell: (r.epoch, r.alive, r.n, r.sum_x, {v.class_id: v.votes for v in r.votes}) for r in mapstate.snapshot(spark, at, "map", ["cell"]).collect()}
    assert got == simulate(ops, 65535)
    assert spark.read.parquet(f"{at}/map/*.parquet").select("batch").distinct().count() == 5


def test_votes_saturate_and_void_ones_do_not_count(monkeypatch):
    monkeypatch.setattr(mapstate, "SATURATION", 2)
    c = mapstate.CellState(sums=(0,))
    c.apply([1, 2, 0, 1, 1, 1, 2, 1, 0], [[0, 0, 5, 0, 0, 0, 0, 0, 7]], [3] * 9)
    assert (c.epoch, c.alive, c.n, c.sums, dict(c.votes)) == (1, True, 1, [7], {})
    c.apply([1, 1, 1], [[0, 0, 0]], [3, 3, 3])
    assert dict(c.votes) == {3: 2}
