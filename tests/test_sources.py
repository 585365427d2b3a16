"""Files written here and read back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.sources import calib, config, files, images, masks, scanbin

POINT = scanbin.POINT


def points(rows):
    return np.array(rows, dtype=POINT)


def test_scans(spark, tmp_path):
    scanbin.register(spark)
    raw = scanbin.encode(1000, (1, 2, 3, 0, 0, 0.5), points([(1, 2, 3, 200), (0, 0, 0, 9)])) + scanbin.encode(2000, (0,) * 6, points([])) + scanbin.encode(3000, (4, 0, 0, 0, 0, 0), points([(5, 6, 7, 255)]))
    p = tmp_path / "a.bin"
    p.write_bytes(raw + b"tail")
    got = [tuple(r) for r in spark.read.format("scanbin").load(str(p)).orderBy("t_ns").collect()]
    assert got == [(0, 1000, 1.0, 2.0, 3.0, 200), (2, 3000, 5.0, 6.0, 7.0, 255)]
    poses = spark.read.format("scanposes").load(str(p)).orderBy("scan").collect()
    assert [(r["t_ns"], r["px"], r["n"]) for r in poses] == [(1000, 1.0, 1), (2000, 0.0, 0), (3000, 4.0, 1)]
    late = spark.read.format("scanbin").option("fromNs", 2500).load(str(p))
    assert late.count() == 1
    p.write_bytes(raw[:-3])
    with pytest.raises(ValueError, match="cut off"):
        scanbin.index(str(p))


def log_file(path, times, n=3):
    path.write_bytes(b"".join(scanbin.encode(t, (t / 1000, 0, 0, 0, 0, 0), points([(t, k + 1, 0, k) for k in range(n)])) for t in times))


def test_filters_on_time_reach_the_reader(spark, tmp_path):
    scanbin.register(spark)
    log_file(tmp_path / "a.bin", [100, 200, 300])
    raw = (tmp_path / "a.bin").read_bytes()
    (tmp_path / "b.bin").write_bytes(raw[:60] + b"\xff" * 39 + raw[99:])  # a body that would show if it were read
    times = files.Times({})
    pushed = [files.GreaterThan(("t_ns",), 100), files.LessThanOrEqual(("t_ns",), 200), files.EqualTo(("scan",), 1)]
    reader = scanbin._Reader({"path": str(tmp_path)}, True)
    assert list(reader.pushFilters(pushed)) == pushed[2:] and (reader.times.lo, reader.times.hi) == (101, 200)
    assert [p.path for p in reader.partitions()] == [str(tmp_path / n) for n in ("a.bin", "b.bin")]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 6
    assert times.take(files.EqualTo(("t_ns",), 5)) and (times.lo, times.hi) == (5, 5)
    df = spark.read.format("scanbin").load(str(tmp_path)).where("t_ns > 100 AND t_ns <= 200 AND intensity > 0")
    assert sorted((r.t_ns, r.y) for r in df.collect()) == [(200, 2.0), (200, 2.0), (200, 3.0), (200, 3.0)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "intensity" in plan and "> 100" not in plan and "<= 200" not in plan  # Spark leaves the bounds to the reader


def test_scans_of_a_large_file_are_read_by_many_tasks(spark, tmp_path):
    scanbin.register(spark)
    log_file(tmp_path / "a.bin", range(0, 100_000, 100))
    log_file(tmp_path / "b.bin", [7_000_000])
    df = scanbin.scans(spark, str(tmp_path), 4).withColumn("p", F.spark_partition_id())
    assert df.count() == 3003 and df.select("p").distinct().count() > 2
    plain = spark.read.format("scanbin").load(str(tmp_path))
    assert sorted(map(tuple, df.drop("p").collect())) == sorted(map(tuple, plain.collect()))
    poses = scanbin.scans(spark, str(tmp_path), 2, points=False, lo=99_900)
    assert sorted((r.t_ns, r.n) for r in poses.collect()) == [(99_900, 3), (7_000_000, 3)]
    assert scanbin.scans(spark, str(tmp_path / "none"), 2).count() == 0


def test_a_stream_takes_files_that_appear_and_grow(spark, tmp_path):
    scanbin.register(spark)
    logs, out = tmp_path / "logs", tmp_path / "out"
    logs.mkdir()

    def run():
        stream = spark.readStream.format("scanbin").load(str(logs))
        stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.t_ns, r.intensity) for r in spark.read.schema(scanbin.POINTS).parquet(str(out)).collect())

    want = lambda *times: [(t, k) for t in times for k in range(3)]
    log_file(logs / "b.bin", [100, 200])
    assert run() == want(100, 200)
    assert run() == want(100, 200)  # nothing new
    log_file(logs / "a.bin", [700])
    raw = (logs / "b.bin").read_bytes() + scanbin.encode(300, (0,) * 6, points([(1, 1, 1, k) for k in range(3)]))
    (logs / "b.bin").write_bytes(raw[:-5])  # the last scan is still being written
    assert run() == want(100, 200, 700)
    (logs / "b.bin").write_bytes(raw)
    assert run() == want(100, 200, 300, 700)


def test_a_task_that_fails_once_leaves_each_file_once(spark, tmp_path):
    """Attempts of the writer as Spark would make them: one is lost half way, its retry and another succeed."""
    from pyspark.sql import Row

    writer = scanbin._PcdWriter({"path": str(tmp_path / "out")}, overwrite=False)
    rows = [Row(x=float(i), y=0.0, z=0.0, label=i) for i in range(20_000)]

    def lost():
        yield from rows[:9000]
        raise OSError("lost")

    import pyspark

    class Task:
        def __init__(self, part, attempt):
            self.partitionId, self.taskAttemptId = (lambda: part), (lambda: attempt)

    real = pyspark.TaskContext.get
    try:
        pyspark.TaskContext.get = lambda: Task(0, 1)
        with pytest.raises(OSError):
            writer.write(lost())
        pyspark.TaskContext.get = lambda: Task(0, 2)
        done = [writer.write(iter(rows)), None]
        pyspark.TaskContext.get = lambda: Task(1, 3)
        done[1] = writer.write(iter([]))
    finally:
        pyspark.TaskContext.get = real
    assert not list((tmp_path / "out").glob("*.pcd"))  # nothing is there before the commit
    writer.commit(done)
    (file,) = (tmp_path / "out").iterdir()
    head, body = file.read_bytes().split(b"DATA binary\n")
    assert b"POINTS 20000\n" in head and len(body) == 16 * 20_000
    other = scanbin._PcdWriter({"path": str(tmp_path / "out")}, overwrite=True)
    pyspark.TaskContext.get = lambda: Task(0, 4)
    try:
        part = other.write(iter(rows[:2]))
    finally:
        pyspark.TaskContext.get = real
    other.abort([part])
    assert list((tmp_path / "out").iterdir()) == [file]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    scanbin.register(spark)
    good = spark.range(100).selectExpr("CAST(id AS FLOAT) AS x", "CAST(0 AS FLOAT) AS y", "CAST(0 AS FLOAT) AS z", "CAST(id AS INT) AS label").repartition(3)
    good.write.format("pcd").mode("append").save(str(tmp_path / "out"))
    had = sorted((tmp_path / "out").iterdir())
    assert len(had) == 3
    bad = good.withColumn("x", F.expr("IF(label = 7, CAST(raise_error('lost') AS FLOAT), x)"))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("pcd").mode("append").save(str(tmp_path / "out"))
    assert sorted((tmp_path / "out").iterdir()) == had
    good.coalesce(1).write.format("pcd").mode("overwrite").save(str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == 1


def test_labelled_cloud(spark, tmp_path):
    scanbin.register(spark)
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4), (5.0, 6.0, 7.0, 0)], "x float, y float, z float, label int").coalesce(1)
    df.write.format("pcd").mode("append").save(str(tmp_path / "out"))
    raw = next((tmp_path / "out").glob("*.pcd")).read_bytes()
    head, body = raw.split(b"DATA binary\n")
    assert b"POINTS 2" in head and len(body) == 32
    assert np.frombuffer(body, dtype="<f4")[:3].tolist() == [1.0, 2.0, 3.0] and np.frombuffer(body, dtype="<u4")[3] == 4


def test_images(spark, tmp_path):
    images.register(spark)
    rows = [
        {"t_ns": 10, "sensor": 7, "width": 2, "height": 1, "encoding": images.RGB8, "data": bytes([1, 2, 3, 4, 5, 6])},
        {"t_ns": 20, "width": 2, "height": 1, "encoding": images.MONO8, "data": bytes([9, 8])},
        {"t_ns": 30, "width": 1, "height": 1, "encoding": images.MONO16, "data": bytes([1, 77])},
    ]
    p = tmp_path / "cam.gclf"
    p.write_bytes(images.encode(rows))
    got = spark.read.format("gclf").load(str(p)).orderBy("t_ns").collect()
    assert [(r["t_ns"], bytes(r["rgb"])) for r in got] == [(10, bytes([1, 2, 3, 4, 5, 6])), (20, bytes([9] * 3 + [8] * 3)), (30, bytes([77] * 3))]
    p.write_bytes(b"XXXX" + images.encode(rows)[4:])
    with pytest.raises(ValueError, match="not a camera"):
        images.index(str(p))
    with pytest.raises(ValueError, match="bytes for"):
        images.to_rgb(b"123", 2, 1, images.RGB8)
    more = spark.read.format("gclf").load(str(tmp_path)).where("t_ns >= 20")
    p.write_bytes(images.encode(rows))
    (tmp_path / "cam2.gclf").write_bytes(images.encode([rows[0] | {"t_ns": 25}]))
    assert sorted((r["t_ns"], r["idx"]) for r in more.collect()) == [(20, 1), (25, 0), (30, 2)]
    p.write_bytes(images.encode([]))
    with pytest.raises(ValueError, match="no images"):
        images.index(str(p))


def test_messages():
    step = 4 * 3 + 5
    row = bytes([10, 20, 30] + [0] * (step - 3))
    assert images.message_to_rgb(row * 2, 4, 2, images.MESSAGE_RGB8, step)[:3] == bytes([10, 20, 30])
    assert images.message_to_rgb(bytes([30, 20, 10] + [0] * (step - 3)) * 2, 4, 2, images.MESSAGE_BGR8, step)[:3] == bytes([10, 20, 30])
    assert images.message_to_rgb(bytes([42] * 9) * 2, 4, 2, images.MESSAGE_MONO8, 9)[:3] == bytes([42] * 3)
    assert images.message_to_rgb(row, 4, 2, 0, step) is None and images.message_to_rgb(b"", 4, 2, 1, step) is None
    assert images.luma(np.array([255, 255, 255])).item() in (254, 255)


def test_calibration(spark, tmp_path):
    block = "<cameraCalibration><sensorId>{}</sensorId><fu>100</fu><fv>100</fv><cu>2</cu><cv>1</cv><xi>{}</xi><imageWidth>4</imageWidth><imageHeight>2</imageHeight><imuToCameraQw>2</imuToCameraQw><imuToCameraQx>0</imuToCameraQx><imuToCameraQy>0</imuToCameraQy><imuToCameraQz>0</imuToCameraQz><imuToCameraOffsetX>1</imuToCameraOffsetX></cameraCalibration>"
    p = tmp_path / "c.xml"
    p.write_text("<all>" + block.format(211, 0) + block.format(5, 0.5) + "</all>")
    c = calib.load(spark, str(p))
    r = calib.for_sensor(c, 211).first()
    assert r["rotation"] == [1, 0, 0, 0, 1, 0, 0, 0, 1] and r["offset"] == [1.0, 0.0, 0.0] and r["width"] == 4 and not r["distorted"]
    assert calib.for_sensor(c, 5).first()["distorted"]
    with pytest.raises(ValueError, match="no calibration"):
        calib.for_sensor(c, 9)


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", "/home/x")
    c = config.from_dict({"log": "~/l", "stride": 0, "voting": {"enabled": True}, "objects": {"overlap_sets": True}, "viz": {"endpoint": "e"}, "unknown": 1})
    assert (c.log, c.stride, c.voting["enabled"], c.voting["stuff_bias"], c.viz_endpoint) == ("/home/x/l", 1, True, 2.0, "e")
    assert c.grow["overlap_sets"] and c.hdbscan["overlap_sets"] and config.from_dict({}).count == 50
    pytest.importorskip("yaml")
    p = tmp_path / "r.yaml"
    p.write_text("voxel: 0.1\nthing: [a, b]\nhdbscan: {min_pts: 7}\n")
    c = config.load(str(p))
    assert c.voxel == 0.1 and c.thing == ["a", "b"] and c.hdbscan["min_pts"] == 7 and c.hdbscan["min_cluster_size"] == 50


def test_mask_files(spark, tmp_path):
    (tmp_path / "m").write_bytes(bytes([0, 1, 1, 0, 0, 0]))
    m = masks.load(spark, str(tmp_path / "m"), 3, 2)
    assert sorted((r["u"], r["v"]) for r in m.collect()) == [(1, 0), (2, 0)]
    assert [r["line"] for r in masks.raster(m, 3, 2).orderBy("v").collect()] == ["011", "000"]
