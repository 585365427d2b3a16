"""Kills that act on later frames.

What a frame sees depends on the cells that earlier frames have killed, and what it kills on what it sees.
Frames are not worked off one by one: all are looked at with the kills known so far, again those after the
first one whose kills have changed, until no kill is new.  Kills up to and with that first frame are final
after a round, so there are never more rounds than frames with kills, and few where kills seldom meet.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.operators.tables import settle

LAST = 2**31 - 1


def per_frame(points: DataFrame, key: list[str], frame: str, values: list[str]) -> DataFrame:
    """(key..., frame, n, sum_*) of a frame's points, `first` being the frame itself."""
    sums = points.groupBy(*key, frame).agg(F.count(F.lit(1)).alias("n"), *(F.sum(v).alias(f"sum_{v}") for v in values))
    return sums.withColumn("first", F.col(frame))


def intervals(per: DataFrame, key: list[str], frame: str, values: list[str], kills: DataFrame | None = None) -> DataFrame:
    """(key..., frame, until, killed, first, n, sum_*, means): a cell's state from a frame in which it was fused until the
    next (the latest has `until` LAST).  `killed` is the frame in between whose kill it did not survive:
    after it the cell is dead until it is fused again, and then starts from nothing.

    per: rows of per_frame(), or a cell's earlier state in their form; kills: (key..., frame).
    """
    held = per.select(*key, frame, "first", "n", *(f"sum_{v}" for v in values), F.lit(0).alias("__kill"))
    if kills is not None:
        none = [F.lit(None).cast(held.schema[c].dataType).alias(c) for c in ["first", "n", *(f"sum_{v}" for v in values)]]
        held = held.unionByName(kills.select(*key, F.col(frame).cast(held.schema[frame].dataType).alias(frame), *none, F.lit(1).alias("__kill")).distinct())
    w = W.partitionBy(*key).orderBy(frame, "__kill")
    marked = held.select(
        "*", F.sum("__kill").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("__epoch"),
        F.when(F.lead("__kill").over(w) == 1, F.lead(frame).over(w)).alias("killed"), F.min("first").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("__first"),
    ).where("__kill = 0")
    only, run = W.partitionBy(*key).orderBy(frame), W.partitionBy(*key, "__epoch").orderBy(frame).rowsBetween(W.unboundedPreceding, 0)
    sums = {c: F.sum(c).over(run) for c in ["n", *(f"sum_{v}" for v in values)]}
    out = marked.select(*key, frame, F.coalesce(F.lead(frame).over(only), F.lit(LAST)).alias("until"), "killed", F.col("__first").alias("first"), *(s.alias(c) for c, s in sums.items()))
    return out.select("*", *((F.col(f"sum_{v}") / F.col("n")).alias(v) for v in values))


def dead(now: Column) -> Column:
    """Whether a state of intervals() is dead in a frame that it covers."""
    return F.coalesce(F.col("killed") < now, F.lit(False))


def latest(state: DataFrame, frame: str) -> DataFrame:
    """The state after all frames; dead cells keep `killed`."""
    return state.where(F.col("until") == LAST).drop("until")


Look = Callable[[DataFrame, DataFrame], DataFrame]


def settle_kills(per: DataFrame, frames: DataFrame, runs: list[str], key: list[str], frame: str, values: list[str], look: Look, kills: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(state, shell) with the kills of all frames.

    frames: (runs..., frame, ...), one row each; look(frames, state) -> the rows that those frames see of the cells that
    are alive for them (key..., frame, kill, ...), key beginning with runs.  kills: those of earlier frames.
    """
    known = kills
    state = settle(intervals(per, key, frame, values, known))
    shell = settle(look(frames, state))
    before, rounds = None, frames.select(*runs, frame).distinct().count() + 1
    for _ in range(rounds):
        found = settle(shell.where("kill").select(*key, frame).distinct())
        was = found.limit(0) if before is None else before
        changed = found.exceptAll(was).unionByName(was.exceptAll(found)).groupBy(*runs).agg(F.min(frame).alias("__from"))
        changed = settle(changed)
        if changed.isEmpty():
            break
        known = found if kills is None else found.unionByName(kills.select(*key, F.col(frame).cast(found.schema[frame].dataType).alias(frame)))
        state = settle(intervals(per, key, frame, values, known))
        on = [F.col(f"a.{r}") == F.col(f"c.{r}") for r in runs] + [F.col(f"a.{frame}") > F.col("c.__from")]
        both = reduce(lambda p, q: p & q, on)
        again = frames.alias("a").join(changed.alias("c"), both, "left_semi")
        kept = shell.alias("a").join(changed.alias("c"), both, "left_anti")
        shell, before = settle(kept.unionByName(look(again, state))), found
    return state, shell
