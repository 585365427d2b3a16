"""Joins on time: bracket and interpolate, nearest, rings, monotonic filters and replay merges.

Runs are cut into segments of time (2 ** bits units of t), so that a long run is not one task.  Both inputs are
united and each query row looks at its neighbours of the other kind inside its segment through running
windows, backwards in order of time and forwards in the reverse order.  (A frame that ends at the last
row would be computed anew for each row, in quadratic time.)  What a segment does not hold is carried over
from its neighbours: one row of first and last samples a segment, the only thing that is gathered by run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.functions.geometry import alpha, lerp

#: Segments of 2 ** 36 ns are about a minute, of as many microseconds most of a day.
BITS = 36
SEGMENT = "__segment"


def _united(queries: DataFrame, samples: DataFrame, run: str, t: str, q_id: str, values: list[str], bits: int) -> DataFrame:
    q = queries.select(F.col(run), F.col(t).alias("t"), F.col(q_id).alias("q_id"), F.lit(None).cast("struct<t:bigint>").alias("s"), *(F.lit(None).cast(samples.schema[v].dataType).alias(v) for v in values))
    s = samples.select(F.col(run), F.col(t).alias("t"), F.lit(None).cast(queries.schema[q_id].dataType).alias("q_id"), F.struct(F.col(t).alias("t")).alias("s"), *values)
    return q.unionByName(s).withColumn(SEGMENT, F.shiftright("t", bits))


def _around(rows: DataFrame, run: str, back: Column, ahead: Column, strict: bool) -> DataFrame:
    """rows with `prev`, the greatest `back` at or before t (strict: before), and `next`, the least `ahead` at or after
    t, of all rows of the run."""
    cuts = rows.groupBy(run, SEGMENT).agg(F.max(back).alias("__last"), F.min(ahead).alias("__first"))
    w = W.partitionBy(run)
    carried = cuts.select(
        F.col(run).alias("__run"), F.col(SEGMENT).alias("__at"),
        F.last("__last", True).over(w.orderBy(SEGMENT).rowsBetween(W.unboundedPreceding, -1)).alias("__before"),
        F.last("__first", True).over(w.orderBy(F.desc(SEGMENT)).rowsBetween(W.unboundedPreceding, -1)).alias("__after"),
    )
    inside = W.partitionBy(run, SEGMENT)
    before, after = inside.orderBy("t").rangeBetween(W.unboundedPreceding, -1 if strict else 0), inside.orderBy(F.col("t").desc()).rangeBetween(W.unboundedPreceding, 0)
    near = rows.withColumn("prev", F.max(back).over(before)).withColumn("next", F.min(ahead).over(after)).where("q_id IS NOT NULL")
    both = near.join(carried, near[run].eqNullSafe(F.col("__run")) & near[SEGMENT].eqNullSafe(F.col("__at")), "left")
    return both.withColumn("prev", F.coalesce("prev", "__before")).withColumn("next", F.coalesce("next", "__after")).drop("__run", "__at", "__before", "__after")


def bracket(queries: DataFrame, samples: DataFrame, run: str, t: str, q_id: str, values: list[str], bits: int = BITS) -> DataFrame:
    """For each query its bracketing samples: status, t0, t1, alpha, v0 and v1 of each value.

    The sample at or after t and its predecessor; a sample exactly at t is both.  Status: EMPTY without
    samples, TOO_OLD before the first, NEED_NEWER after the last, else OK.  `t` is a bigint.
    """
    packed = F.when(F.col("s").isNotNull(), F.struct(F.col("t").alias("at"), *values))
    w = _around(_united(queries, samples, run, t, q_id, values, bits), run, packed, packed, strict=True)
    exact = F.col("next.at") == F.col("t")
    status = F.when(F.col("next").isNull(), F.when(F.col("prev").isNull(), "EMPTY").otherwise("NEED_NEWER")).when(exact, "OK").when(F.col("prev").isNull(), "TOO_OLD").otherwise("OK")
    lo = F.when(exact, F.col("next")).otherwise(F.col("prev"))
    out = w.select(run, "t", "q_id", status.alias("status"), lo.alias("lo"), F.col("next").alias("hi"))
    ok = F.col("status") == "OK"
    return out.select(
        run, "t", "q_id", "status",
        F.when(ok, F.col("lo.at")).alias("t0"), F.when(ok, F.col("hi.at")).alias("t1"),
        F.when(ok, alpha(F.col("t"), F.col("lo.at"), F.col("hi.at"))).alias("alpha"),
        *(F.when(ok, F.col(f"lo.{v}")).alias(f"{v}0") for v in values), *(F.when(ok, F.col(f"hi.{v}")).alias(f"{v}1") for v in values),
    )


def interpolate(bracketed: DataFrame, values: list[str]) -> DataFrame:
    """bracket() with each value interpolated; null where the status is not OK."""
    return bracketed.select("*", *(lerp(F.col(f"{v}0"), F.col(f"{v}1"), F.col("alpha")).alias(v) for v in values))


def nearest(queries: DataFrame, samples: DataFrame, run: str, t: str, q_id: str, s_id: str, bits: int = BITS) -> DataFrame:
    """For each query the sample with the least |dt|; of two equally near the earlier.  Of samples at one
    time the one with the smallest id.  Queries without samples have nulls."""
    seen = F.when(F.col("s").isNotNull(), F.struct(F.col("t").alias("at"), (-F.col(s_id)).alias("neg")))
    later = F.when(F.col("s").isNotNull(), F.struct(F.col("t").alias("at"), F.col(s_id).alias("id")))
    w = _around(_united(queries, samples, run, t, q_id, [s_id], bits), run, seen, later, strict=False)
    prev = F.when(F.col("prev").isNotNull(), F.struct((F.col("t") - F.col("prev.at")).alias("dt"), F.col("prev.at").alias("at"), (-F.col("prev.neg")).alias("id")))
    nxt = F.when(F.col("next").isNotNull(), F.struct((F.col("next.at") - F.col("t")).alias("dt"), F.col("next.at").alias("at"), F.col("next.id").alias("id")))
    best = F.least(prev, nxt)  # nulls are skipped; equal dt: the earlier time
    return w.select(run, "t", "q_id", best.alias("b")).select(run, "t", "q_id", F.col("b.id").alias("s_id"), F.col("b.at").alias("s_t"), F.col("b.dt").alias("dt"))


def numbered(rows: DataFrame, run: str, order: str, then: list[str], name: str, bits: int = BITS) -> DataFrame:
    """rows with their number from 1 inside their run, in order of the bigint `order`, then the others: rows are
    numbered inside segments of it, whose counts are summed by run."""
    cut = rows.withColumn(SEGMENT, F.shiftright(order, bits))
    counts = cut.groupBy(F.col(run).alias("__run"), F.col(SEGMENT).alias("__at")).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("__run").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    sums = counts.select("__run", "__at", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = cut.withColumn(name, F.row_number().over(W.partitionBy(run, SEGMENT).orderBy(order, *then)))
    both = inside.join(sums, inside[run].eqNullSafe(F.col("__run")) & inside[SEGMENT].eqNullSafe(F.col("__at")))
    return both.withColumn(name, (F.col(name) + F.col("__off")).cast("int")).drop("__run", "__at", "__off", SEGMENT)


def monotonic(rows: DataFrame, run: str, arrival: str, t: str, bits: int = 16) -> DataFrame:
    """Rows whose time is above that of all rows that arrived before (`arrival` is a bigint)."""
    cut = rows.withColumn(SEGMENT, F.shiftright(arrival, bits))
    tops = cut.groupBy(F.col(run).alias("__run"), F.col(SEGMENT).alias("__at")).agg(F.max(t).alias("__m"))
    tops = tops.select("__run", "__at", F.max("__m").over(W.partitionBy("__run").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)).alias("__had"))
    inside = cut.withColumn("__top", F.max(t).over(W.partitionBy(run, SEGMENT).orderBy(arrival).rowsBetween(W.unboundedPreceding, -1)))
    both = inside.join(tops, inside[run].eqNullSafe(F.col("__run")) & inside[SEGMENT].eqNullSafe(F.col("__at")))
    top = F.greatest("__top", "__had")  # nulls are skipped
    return both.where(top.isNull() | (F.col(t) > top)).drop("__top", "__run", "__at", "__had", SEGMENT)


def ring(rows: DataFrame, run: str, order: str, size: int, t: str) -> DataFrame:
    """rows with the oldest time, newest time and number of a ring of the last `size` rows."""
    w = W.partitionBy(run).orderBy(order).rowsBetween(-(size - 1), 0)
    return rows.select("*", F.min(t).over(w).alias("oldest"), F.max(t).over(w).alias("newest"), F.count(F.lit(1)).over(w).alias("held"))


def replay(scans: DataFrame, images: DataFrame, run: str, t: str, item: str, start: int, count: int, step: int, guard: int) -> DataFrame:
    """Both streams merged by time, scans before images at equal times.

    Images number `start` to `start + count - 1` of each run (in order of time), each `step`-th of
    them; scans no more than `guard` outside the times of that window.  A run whose window is empty has
    no rows.
    """
    window = numbered(images, run, t, [item], "idx").withColumn("idx", F.col("idx") - 1).where((F.col("idx") >= start) & (F.col("idx") < start + count))
    span = window.groupBy(F.col(run).alias("__run")).agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    near = scans.join(span, scans[run] == span["__run"]).where((F.col(t) >= F.col("lo") - guard) & (F.col(t) <= F.col("hi") + guard))
    kept = stride(window, F.col("idx") - start, step)
    both = near.select(run, t, item, F.lit(0).alias("is_image")).unionByName(kept.select(run, t, item, F.lit(1).alias("is_image")))
    return numbered(both, run, t, ["is_image", item], "pos")


def stride(rows: DataFrame, idx: Column, step: int) -> DataFrame:
    return rows.where(F.pmod(idx, F.lit(max(1, step))) == 0)
