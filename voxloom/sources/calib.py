"""Camera calibrations from XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.geometry import normalise_quaternion, quaternion_to_rotation

#: The tags of a calibration block.
NUMBERS = ("fu", "fv", "cu", "cv", "xi", "imageWidth", "imageHeight", "imuToCameraQw", "imuToCameraQx", "imuToCameraQy", "imuToCameraQz", "imuToCameraOffsetX", "imuToCameraOffsetY", "imuToCameraOffsetZ")


def load(spark: SparkSession, path: str) -> DataFrame:
    """All calibrations of a file: sensor_id, fu, fv, cu, cv, xi, width, height, rotation (9 entries, of
    the normalised quaternion) and offset.  A missing number is 0."""
    schema = "sensorId long, " + ", ".join(f"{n} double" for n in NUMBERS)
    raw = spark.read.format("xml").option("rowTag", "cameraCalibration").schema(schema).load(path)
    c = {n: F.coalesce(F.col(n), F.lit(0.0)) for n in NUMBERS}
    q = normalise_quaternion([c[f"imuToCameraQ{a}"] for a in "wxyz"])
    return raw.select(
        F.col("sensorId").alias("sensor_id"), *(c[n].alias(n) for n in ("fu", "fv", "cu", "cv", "xi")),
        c["imageWidth"].cast("int").alias("width"), c["imageHeight"].cast("int").alias("height"),
        F.array(*quaternion_to_rotation(q)).alias("rotation"), F.array(*(c[f"imuToCameraOffset{a}"] for a in "XYZ")).alias("offset"),
        (F.abs(c["xi"]) > 1e-9).alias("distorted"), F.monotonically_increasing_id().alias("__at"),
    )


def for_sensor(calibrations: DataFrame, sensor_id: int) -> DataFrame:
    """The first calibration of a sensor; an error if there is none."""
    found = calibrations.where(F.col("sensor_id") == sensor_id).orderBy("__at").limit(1).drop("__at")
    if not found.count():
        raise ValueError(f"no calibration for sensor {sensor_id}")
    return found
