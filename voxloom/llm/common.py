"""What the training-data operators share: row keys and joins."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators.tables import scratch, settle  # noqa: F401 for the other modules

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most so many rows for the jobs that run inside; other queries of the session that
    start meanwhile have them too.  Batches are bounded in bytes anyway; this is for functions whose results
    are larger than their input (44 bands and a digest for a short text)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def trim_memory() -> None:
    """Give what numpy and Arrow have freed back to the system, where the C library can."""
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_hash(text: str = "text") -> Column:
    """64-bit hash of a text (null: that of a marker); tells rows that repeat an id apart."""
    return F.xxhash64(F.col(text).isNull(), F.col(text))


def semi_rows(df: DataFrame, keys: DataFrame, id_col: str, text_col: str, how: str = "left_semi") -> DataFrame:
    """Rows of df whose (id, text hash) is among keys(id, th); all columns stay.  Nulls match nulls."""
    mark = f"__th_{uuid.uuid4().hex[:8]}"
    left = df.withColumn(mark, text_hash(text_col))
    right = keys.select(F.col("id").alias(f"{mark}_i"), F.col("th").alias(f"{mark}_t"))
    on = left[id_col].eqNullSafe(right[f"{mark}_i"]) & (left[mark] == right[f"{mark}_t"])
    return left.join(right, on, how).drop(mark)


HOT_SHARE = 1000  # a key is hot from one row in so many, so there are at most so many hot keys


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined (inner or left) with right on `key`, of which right has each value once, as many rows of
    left as may share one.  The hot keys' rows of right, at most HOT_SHARE of them, are broadcast, so that no
    key's rows of left meet in one task.  left is read several times; it should be a table."""
    n = left.count()
    often = settle(left.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where((F.col("__n") * HOT_SHARE >= n) & (F.col("__n") > 64)).select(key))
    if often.isEmpty():
        return left.join(right, key, how)
    hot = F.broadcast(often)
    few = F.broadcast(right.join(hot, key, "left_semi"))
    return left.join(hot, key, "left_semi").join(few, key, how).unionByName(left.join(hot, key, "left_anti").join(right, key, how))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_sums(parts: DataFrame) -> dict[int, np.ndarray]:
    """By part the sum of the vectors x of parts(part int, x binary): packed 64-bit whole numbers, as long as each
    other in a part.  Added up by tasks, in which a part's vectors pass by; the driver gets one for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(x, dtype=np.int64)
                have[part] = have[part] + x if part in have else x
        yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array([x.tobytes() for x in have.values()], pa.binary())], names=["part", "x"])

    got = parts.repartition("part").mapInArrow(run, "part int, x binary").toArrow()
    return {part: np.frombuffer(x, dtype=np.int64) for part, x in zip(got.column("part").to_pylist(), got.column("x").to_pylist(), strict=True)}
