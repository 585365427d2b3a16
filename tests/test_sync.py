"""Image, pose and scan synchronisation: the recorded trajectory, rings and flushing."""

import math

from pyspark.sql import functions as F

from voxloom.operators import asof
from voxloom.streaming.keyed import fold_batch
from voxloom.streaming.sync import FRAMES, PENDING, Sync, step

POSES = [(k * 100_000_000, (k / 10, 0.05 * k, 0.2, 0.03 * k)) for k in range(12)]
IMAGES = [(k * 100_000_000 + 50_000_000, k) for k in range(11)]


def replay():
    s, out = Sync(), []
    for t, is_image, x in sorted([(t, 0, (p, i)) for i, (t, p) in enumerate(POSES)] + [(t, 1, k) for t, k in IMAGES], key=lambda e: e[:2]):
        out += s.push_image(t, x) if is_image else s.push_scan(t, x[0], x[1])
    return s, out + s.flush()


def test_every_image_once_in_order():
    s, out = replay()
    assert [f["image_id"] for f in out] == list(range(11))
    assert (s.emitted, s.too_old, s.overflow) == (11, 0, 0)


def test_pose_and_earlier_scan():
    _, out = replay()
    for f in out:
        t = f["image_t"] / 1e9
        assert all(abs(a - b) < 1e-4 for a, b in zip(f["pose"], (t, 0.5 * t, 0.2, 0.3 * t), strict=True))
        assert f["scan_t"] == f["image_t"] - 50_000_000  # two scans are equally near


def test_too_old_and_head_of_line():
    s = Sync()
    assert s.push_image(5, 0) == [] and s.push_image(1, 1) == []
    out = s.push_scan(2, (0.0, 0.0, 0.0, 0.0), 0)
    assert out == [] and s.too_old == 0  # the first waits and holds up the second
    out = s.push_scan(6, (4.0, 0.0, 0.0, 0.0), 1)
    assert [f["image_id"] for f in out] == [0] and s.too_old == 1
    s.push_image(9, 2)
    assert s.flush() == [] and s.too_old == 2


def test_overflow_drops_the_oldest():
    s = Sync()
    for k in range(PENDING + 3):
        s.push_image(k + 1, k)
    assert s.overflow == 3 and s.pending[0][1] == 3


def test_stale_pose_keeps_its_scan():
    s = Sync()
    s.push_scan(10, (0.0,) * 4, 0)
    s.push_scan(10, (9.0,) * 4, 1)
    assert len(s.poses) == 1 and len(s.scans) == 2


def test_angles_take_the_short_way():
    s = Sync()
    s.push_scan(0, (0.0, 0.0, 0.0, 3.1), 0)
    s.push_image(5, 0)
    f = s.push_scan(10, (0.0, 0.0, 0.0, -3.1), 1)[0]
    assert abs(math.cos(f["pose"][3]) + 1) < 1e-6


def test_fold_matches_relational(spark):
    poses = spark.createDataFrame([("r", t, i, p[0]) for i, (t, p) in enumerate(POSES)], "run string, t long, item long, x double")
    images = spark.createDataFrame([("r", t, k) for t, k in [*IMAGES, (-5, 90), (2 * 10**9, 91)]], "run string, t long, item long")
    rows = poses.select("run", "t", F.lit(0).alias("is_image"), "item", F.array("x", F.lit(0.0)).alias("pose")).unionByName(
        images.select("run", "t", F.lit(1).alias("is_image"), "item", F.array(F.lit(0.0), F.lit(0.0)).alias("pose")))
    fold = {r["image_id"]: r for r in fold_batch(rows, "run", ["t", "is_image", "item"], Sync, step("run"), f"run string, {FRAMES}").collect()}
    rel = {r["q_id"]: r for r in asof.interpolate(asof.bracket(images, poses, "run", "t", "item", ["x"]), ["x"]).collect()}
    near = {r["q_id"]: r["s_id"] for r in asof.nearest(images, poses, "run", "t", "item", "item").collect()}
    assert rel[90]["status"] == "TOO_OLD" and rel[91]["status"] == "NEED_NEWER"
    assert set(fold) == {k for k, r in rel.items() if r["status"] == "OK"}
    for k, f in fold.items():
        assert abs(f["pose"][0] - rel[k]["x"]) < 1e-9 and f["scan_id"] == near[k]


def test_fold_of_many_keys_in_few_groups(spark, tmp_path, monkeypatch):
    """Keys share buckets, a row of the state store each: as one fold a key, over two micro-batches of several files, with
    a null key and ids beyond 2^53."""
    from voxloom.streaming import folds, keyed

    schema, at, big = "k long, t long, v long", str(tmp_path), 1 << 60
    rows = [(None if k == 0 else big + k, t, (k * t * t // 7) % 3 + big) for k in range(600) for t in range(8)]
    monkeypatch.setattr(keyed, "BUCKETS", 16)
    got = None
    for half in (0, 1):
        spark.createDataFrame([r for r in rows if r[1] // 4 == half], schema).repartition(3).write.mode("append").parquet(f"{at}/rows")
        s = spark.readStream.schema(schema).parquet(f"{at}/rows")
        got = keyed.run_once(keyed.fold_stream(s, "k", ["t"], dict, folds.delta_step("k", ["v"], ["k", "t", "v"]), schema), at, "out")
    last, want = {}, []
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        if last.get(k) != v:
            want.append((k, t, v))
        last[k] = v
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert spark.read.format("statestore").load(f"{at}/out-checkpoint").count() == 17


def test_slices_are_written_by_many_tasks(spark, tmp_path):
    from voxloom.plans import q_stream

    seen = []
    rows = spark.range(4000).repartition(4).selectExpr("id AS t")
    q_stream.fed(rows, "t", f"{tmp_path}/rows", lambda: seen.append(len(spark.read.parquet(f"{tmp_path}/rows").inputFiles())))
    assert len(seen) == 4 and all(b - a > 1 for a, b in zip([0, *seen], seen, strict=False))
    assert spark.read.parquet(f"{tmp_path}/rows").distinct().count() == 4000
