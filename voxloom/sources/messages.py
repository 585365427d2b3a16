"""Live messages (poses, clouds, images) as the tables that the pipeline takes.

The same expressions serve batch tables and streams.  What cannot be used goes to a second table with the
reason, so that it can be counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.timeconv import ticks_to_ns
from voxloom.sources.images import message_to_rgb

#: The messages' fields.
POSE = "timestamp long, hw_timestamp long, source_segment int, dest_segment int, frame_id short, trajectory_id long, x double, y double, z float, xVel float, yVel float, zVel float, roll float, pitch float, yaw float, rollRate float, pitchRate float, yawRate float"
CLOUD = "timestamp long, hw_timestamp long, source_segment int, points array<struct<x:float,y:float,z:float,intensity:short,sensorId:short,semanticLabel:int,semanticLikelihood:float>>"
IMAGE = "timestamp long, hw_timestamp long, source_segment int, sensorId int, height int, width int, encoding int, step int, seq long, exposureTime int, gain int, data binary"


def poses(messages: DataFrame, run: str = "run") -> DataFrame:
    """(run, t, px, py, pz, roll, pitch, yaw); messages without a time or a place are left out."""
    m = messages.where("timestamp IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    return m.select(run, ticks_to_ns(F.col("timestamp")).alias("t"), F.col("x").alias("px"), F.col("y").alias("py"), *(F.coalesce(F.col(a).cast("double"), F.lit(0.0)).alias(b) for a, b in (("z", "pz"), ("roll", "roll"), ("pitch", "pitch"), ("yaw", "yaw"))))


def clouds(messages: DataFrame, run: str = "run") -> DataFrame:
    """(run, t, x, y, z, intensity) of all points but empty beams."""
    p = messages.where("timestamp IS NOT NULL").select(run, ticks_to_ns(F.col("timestamp")).alias("t"), F.explode("points").alias("p"))
    p = p.select(run, "t", "p.x", "p.y", "p.z", F.coalesce("p.intensity", F.lit(0).cast("short")).alias("intensity"))
    return p.where(~((F.col("x") == 0) & (F.col("y") == 0) & (F.col("z") == 0)))


def scans(pose_messages: DataFrame, cloud_messages: DataFrame, run: str = "run") -> DataFrame:
    """Points with the pose of the same time, as Pipeline.batch() takes them."""
    return clouds(cloud_messages, run).join(poses(pose_messages, run), [run, "t"])


def images(messages: DataFrame, run: str = "run") -> DataFrame:
    """(run, t, width, height, rgb); rgb is null for an image that cannot be read: an unknown encoding, no
    size, rows shorter than their pixels, missing bytes."""

    def convert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["rgb"] = [message_to_rgb(bytes(d) if d is not None else b"", int(w), int(h), int(e), int(s)) for d, w, h, e, s in zip(f["data"], f["width"].fillna(0), f["height"].fillna(0), f["encoding"].fillna(0), f["step"].fillna(0), strict=True)]
            yield f[[run, "t", "width", "height", "rgb"]]

    kind = messages.schema[run].dataType.simpleString()
    m = messages.select(run, ticks_to_ns(F.col("timestamp")).alias("t"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("width", "height", "encoding", "step")), "data")
    return m.mapInPandas(convert, f"{run} {kind}, t long, width int, height int, rgb binary")


def rejected(converted: DataFrame, run: str = "run") -> DataFrame:
    """(run, n): images that could not be read."""
    return converted.where("rgb IS NULL").groupBy(run).agg(F.count(F.lit(1)).alias("n"))
