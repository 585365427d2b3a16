"""What leaves the engine: room objects, deltas, sign requests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.functions.ids import fingerprint
from voxloom.operators.cluster import hulls, remove_outliers


def room_objects(members: DataFrame, vehicle: int, texts: DataFrame | None = None, k: int = 8, times: float = 1.0) -> DataFrame:
    """One row for each object of members(object_id, label, x, y, z): vehicle_id, ident, no room (null),
    label, direction (its text or empty), polygon and centroid of its points in the plane.

    Points further than mean + times * sigma from their k nearest are left out of polygon and centroid.
    """
    flat = members.select("object_id", "x", "y").withColumn("__i", F.monotonically_increasing_id())
    kept = remove_outliers(flat, ["object_id"], "__i", ["x", "y"], k, times)
    shape = hulls(kept, "object_id", "x", "y")
    named = members.groupBy("object_id").agg(F.min("label").alias("label"))
    out = shape.join(named, "object_id")
    out = out.join(texts.select("object_id", "text"), "object_id", "left") if texts is not None else out.withColumn("text", F.lit(None).cast("string"))
    return out.select(
        F.lit(vehicle).alias("vehicle_id"), F.col("object_id").cast("long").alias("ident"),
        F.lit(None).cast("int").alias("room_vehicle_id"), F.lit(None).cast("long").alias("room_ident"),
        "label", F.coalesce("text", F.lit("")).alias("direction"), "polygon", F.struct(F.col("cx").alias("x"), F.col("cy").alias("y")).alias("centroid"),
    )


def changed_since(current: DataFrame, sent: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Rows of `current` that are new or whose values differ from those last sent; what has vanished is
    not reported."""
    last = sent.select(*key, fingerprint(*(F.col(v) for v in values)).alias("__sent"))
    now = current.withColumn("__now", fingerprint(*(F.col(v) for v in values)))
    return now.join(last, key, "left").where(~F.col("__now").eqNullSafe(F.col("__sent"))).drop("__now", "__sent")


def changes(snapshots: DataFrame, key: list[str], frame: str, values: list[str]) -> DataFrame:
    """Rows of a series of snapshots that differ from the same key's row before."""
    w = W.partitionBy(*key).orderBy(frame)
    now = F.struct(*values)
    return snapshots.withColumn("__was", F.lag(now).over(w)).where(~now.eqNullSafe(F.col("__was"))).drop("__was")


def single_flight(requests: DataFrame, run: str, t: str, item: str, service: int) -> DataFrame:
    """(run, t, item, done_t): requests that find no other under way; the gate reopens when one is done.

    A request at the very time another is done goes through.  One pass over each run in order of time:
    which request is next depends on the one before, so there is no relational form without recursion.
    """
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}

    def gate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([t, item], ignore_index=True)
        free, keep = None, []
        for at in pdf[t].tolist():
            go = free is None or at >= free
            keep.append(go)
            free = at + service if go else free
        out = pdf[keep][[run, t, item]].copy()
        out["done_t"] = out[t] + service
        return out

    return requests.select(run, t, item).groupBy(run).applyInPandas(gate, f"{run} {kinds[run]}, {t} {kinds[t]}, {item} {kinds[item]}, done_t long")


def largest_instance(pixels: DataFrame, frame: list[str], least: int) -> DataFrame:
    """The instance with most pixels of each frame, its box and count, if it has `least` of them.

    pixels(frame..., instance, u, v); instances below 0 are none; ties go to the lower id.
    """
    n = pixels.where("instance >= 0").groupBy(*frame, "instance").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"))
    rank = F.row_number().over(W.partitionBy(*frame).orderBy(F.desc("n"), "instance"))
    return n.where(F.col("n") >= least).withColumn("__r", rank).where("__r = 1").drop("__r")


def read_signs(requests: DataFrame, detector, key: list[str], image: str) -> DataFrame:
    """(key..., ok, text): what a detector reads in each image.

    detector(image) returns [(content, direction), ...] or raises; a failure or an empty answer has
    ok = false.  Pairs are joined as 'content: direction; ...'.
    """
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}

    def run(batches):
        for pdf in batches:
            rows = []
            for x in pdf[image]:
                try:
                    text = "; ".join(f"{c}: {d}" for c, d in detector(x) if c or d)
                except Exception:  # noqa: BLE001 the detector is foreign code; its failure is a result
                    text = ""
                rows.append((bool(text), text))
            yield pdf[key].assign(ok=[a for a, _ in rows], text=[b for _, b in rows])

    return requests.select(*key, image).mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in key), "ok boolean", "text string"]))
