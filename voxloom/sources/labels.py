"""Label rasters of frames as sparse pixel tables, and the place where a model is plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the code of pixels without label or instance.
BACKGROUND = -1


def raster_pixels(frames: DataFrame, names: list[str], key: list[str]) -> DataFrame:
    """(key..., u, v, name, instance) of frames(key..., h, w, label_map, id_map): little-endian int16
    rasters, row by row.  Background goes; an absent id map means no instances; a label without a name
    has an empty one."""
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                lab = np.frombuffer(row.label_map, dtype="<i2")
                if len(lab) != row.h * row.w:
                    raise ValueError(f"{len(lab)} labels for {row.w} x {row.h} pixels")
                at = np.flatnonzero(lab != BACKGROUND)
                inst = np.frombuffer(row.id_map, dtype="<i2")[at] if row.id_map is not None and len(row.id_map) else np.full(len(at), BACKGROUND)
                out = {k: [getattr(row, k)] * len(at) for k in key}
                out |= {"u": (at % row.w).astype("int32"), "v": (at // row.w).astype("int32"), "name": [names[c] if 0 <= c < len(names) else "" for c in lab[at]], "instance": inst.astype("int32")}
                yield pd.DataFrame(out)

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in key), "u int, v int, name string, instance int"])
    return frames.select(*key, "h", "w", "label_map", "id_map").mapInPandas(run, schema)


def infer(images: DataFrame, run: str, t: str, start: Callable[[], object], step: Callable[[object, pd.Series], dict], schema: str) -> DataFrame:
    """Rows of a model that remembers: for each run, step(state, image) in order of time.

    `start` makes a fresh state for each run; an exception of the model ends the job.
    """

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        state = start()
        rows = [step(state, r) for _, r in pdf.sort_values(t, ignore_index=True).iterrows()]
        return pd.DataFrame(rows)

    return images.groupBy(run).applyInPandas(go, schema)


def segment_boxes(pixels: DataFrame, key: list[str], least: int = 0) -> DataFrame:
    """(key..., name, instance, n, u0, u1, v0, v1) of each instance of at least `least` pixels."""
    n = pixels.groupBy(*key, "name", "instance").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"))
    return n.where(F.col("n") >= least)


def decode_array(buffer: bytes, dtype: str, shape: list[int]) -> np.ndarray:
    """An array envelope: its bytes, type and shape; a size that does not fit is an error."""
    a = np.frombuffer(buffer, dtype=np.dtype(dtype).newbyteorder("<"))
    if a.size != int(np.prod(shape)):
        raise ValueError(f"{a.size} values for shape {shape}")
    return a.reshape(shape)


def encode_array(a: np.ndarray) -> dict:
    return {"data": np.ascontiguousarray(a, dtype=a.dtype.newbyteorder("<")).tobytes(), "dtype": a.dtype.name, "shape": list(a.shape)}
