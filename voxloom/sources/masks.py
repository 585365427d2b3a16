"""Pixel masks in binary and text files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """(path, u, v) of the pixels that are set in binary masks of one byte a pixel."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                m = np.frombuffer(raw, dtype=np.uint8)
                if len(m) != width * height:
                    raise ValueError(f"{p}: {len(m)} bytes for {width} x {height} pixels")
                v, u = np.nonzero(m.reshape(height, width))
                yield pd.DataFrame({"path": p, "u": u.astype("int32"), "v": v.astype("int32")})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, u int, v int")


def raster(mask: DataFrame, width: int, height: int) -> DataFrame:
    """One row a line of the mask: v and its pixels as a text of 0 and 1."""
    rows = mask.select("u", "v").distinct().groupBy("v").agg(F.collect_set("u").alias("us"))
    every = mask.sparkSession.range(height).select(F.col("id").cast("int").alias("v"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.when(F.array_contains(F.coalesce("us", F.array().cast("array<int>")), x), "1").otherwise("0")), "")
    return every.join(rows, "v", "left").select("v", line.alias("line"))
