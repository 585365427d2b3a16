"""Messages, rasters, reports, gates and the remaining helpers."""

import numpy as np
from pyspark.sql import functions as F

from voxloom.__main__ import parser
from voxloom.functions import geometry as G
from voxloom.operators import objects, project
from voxloom.plans.report import Profile
from voxloom.sources import labels, messages


def test_messages(spark):
    pose = spark.createDataFrame([("r", 10, 1.0, 2.0, 3.0, 0.1, 0.2, 0.3), ("r", None, 1.0, 2.0, 3.0, 0.0, 0.0, 0.0)], "run string, timestamp long, x double, y double, z float, roll float, pitch float, yaw float")
    cloud = spark.createDataFrame([("r", 10, [(1.0, 0.0, 0.0, 200, 0, 0, 0.0), (0.0, 0.0, 0.0, 1, 0, 0, 0.0)]), ("r", 11, [])], f"run string, {messages.CLOUD.replace('hw_timestamp long, source_segment int, ', '')}")
    got = messages.scans(pose, cloud).collect()
    assert [(r["t"], r["x"], r["intensity"], r["px"]) for r in got] == [(1000, 1.0, 200, 1.0)]
    img = spark.createDataFrame([("r", 1, 1, 1, 1, 3, bytes([1, 2, 3])), ("r", 2, 1, 1, 0, 3, bytes([1, 2, 3])), ("r", 3, None, 1, 1, 3, None)], "run string, timestamp long, width int, height int, encoding int, step int, data binary")
    out = messages.images(img)
    assert [bytes(r["rgb"]) for r in out.where("rgb IS NOT NULL").collect()] == [bytes([1, 2, 3])]
    assert messages.rejected(out).first()["n"] == 2


def test_rasters(spark):
    lab, ids = np.array([[-1, 0], [1, 5]], dtype="<i2"), np.array([[-1, 3], [-1, -1]], dtype="<i2")
    df = spark.createDataFrame([(7, 2, 2, lab.tobytes(), ids.tobytes()), (8, 2, 2, lab.tobytes(), None)], "frame int, h int, w int, label_map binary, id_map binary")
    px = labels.raster_pixels(df, ["door", "wall"], ["frame"])
    got = sorted(tuple(r) for r in px.collect())
    assert got == [(7, 0, 1, "wall", -1), (7, 1, 0, "door", 3), (7, 1, 1, "", -1), (8, 0, 1, "wall", -1), (8, 1, 0, "door", -1), (8, 1, 1, "", -1)]
    assert labels.segment_boxes(px, ["frame"], 1).count() == 6
    a = np.arange(6, dtype="int16").reshape(2, 3)
    e = labels.encode_array(a)
    assert (labels.decode_array(e["data"], e["dtype"], e["shape"]) == a).all()


def test_model_hook_keeps_order(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 9), ("a", 2)], "run string, t long")

    def step(state, row):
        state.append(int(row["t"]))
        return {"run": row["run"], "t": row["t"], "seen": list(state)}

    got = {(r["run"], r["t"]): r["seen"] for r in labels.infer(df, "run", "t", list, step, "run string, t long, seen array<long>").collect()}
    assert got == {("a", 1): [1], ("a", 2): [1, 2], ("a", 3): [1, 2, 3], ("b", 9): [9]}


def test_gates(spark):
    df = spark.createDataFrame([(float(k % 3) / 10, 0.0, 0.0) for k in range(30)] + [(5.0, 5.0, 5.0)], "x double, y double, z double")
    assert project.mature(df, list("xyz"), 1.26, 20).count() == 30
    px = spark.createDataFrame([(0, 0, 1.0), (9, 9, 2.0), (10, 0, 2.0), (3, 3, 9.0), (None, None, 1.0)], "u int, v int, d double")
    assert project.frustum(px, "u", "v", "d", 10, 10, 1.0, 5.0).count() == 2


def test_signs(spark):
    def read(x):
        if x == 2:
            raise RuntimeError("offline")
        return [("Exit", "left"), ("", "")] if x == 1 else []

    df = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id int, img int")
    got = {r["id"]: (r["ok"], r["text"]) for r in objects.read_signs(df, read, ["id"], "img").collect()}
    assert got == {1: (True, "Exit: left"), 2: (False, ""), 3: (False, "")}


def test_rotations(spark):
    r = G.euler_to_rotation(F.lit(0.2), F.lit(0.1), F.lit(-0.7))
    angle, axis = G.angle_axis(r)
    row = spark.range(1).select(*(c.alias(f"a{i}") for i, c in enumerate(r)), *(c.alias(f"b{i}") for i, c in enumerate(G.rotation_of(angle, axis))), *(c.alias(f"c{i}") for i, c in enumerate(G.adjoint(r, [F.lit(1.0), F.lit(2.0), F.lit(3.0)])))).first()
    v = list(row)
    assert np.allclose(v[:9], v[9:18])
    m, ad = np.array(v[:9]).reshape(3, 3), np.array(v[18:]).reshape(6, 6)
    t = np.array([[0, -3, 2], [3, 0, -1], [-2, 1, 0]])
    assert np.allclose(ad[:3, :3], m) and np.allclose(ad[:3, 3:], t @ m) and np.allclose(ad[3:, :3], 0)


def test_profile(spark):
    p = Profile()
    for _ in range(2):
        with p.step("a"):
            pass
    row = p.table(spark).first()
    assert row["step"] == "a" and row["calls"] == 2 and abs(row["percent"] - 100) < 1e-6


def test_arguments():
    a = parser().parse_args(["query", "voxel_fuse", "/data"])
    assert (a.command, a.name, a.tables) == ("query", "voxel_fuse", "/data")
