"""Sets that contain each other, whatever elements most of them share.

A pair of sets of which the smaller, of n elements, has at least k in the larger must share one of the
smaller one's n - k + 1 rarest elements.  So only those are looked up, and an element that half of all
sets hold is looked up for sets that have little else.  The lookups of an element of very many sets are
dealt over tasks: the sets that hold it by a hash, each lookup to all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.operators import tables

DEAL = 1000  # sets that hold an element, from which on it is dealt, and sets in a share
PAIRS = 2_000_000  # meetings of two sets at an element that a task of shared() counts
MEMBERS = 250_000  # members of sets that a task of its join has
FEW = 64  # where a member's element is held by no more sets on average, all pairs that share one are counted


def frequencies(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows with the number of rows of their key; a key of very many rows is not brought together."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return tables.join_split(rows, n, key, tables.hot_keys(rows, key))


def dealt(lookups: DataFrame, holders: DataFrame, key: str, times: Column, by: str) -> DataFrame:
    """lookups joined with holders on `key`; `times`, a column of both, says how often holders have it."""
    shares = F.floor(times / F.lit(DEAL)).cast("int")
    x = lookups.withColumn("__share", F.explode(F.sequence(F.lit(0), shares)))
    y = holders.withColumn("__share", F.pmod(F.xxhash64(by), shares + 1).cast("int"))
    return x.join(y.drop("__f"), [key, "__share"]).drop("__share")


def contained(sets: DataFrame, set_id: str, on: list[str], bar: float) -> DataFrame:
    """(a, b, shared, containment) with a < b of the pairs of sets that share at least the part `bar` (above 0) of the
    smaller one's distinct elements.

    Elements are the values of the columns `on`; sets and elements that are null count as values.
    """
    named = sets.select(F.col(set_id).alias("s"), F.struct(*on).alias("e")).distinct()
    rows = tables.settle(frequencies(tables.settle(frequencies(tables.settle(named), "e", "__f")), "s", "n"))
    smaller = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    # Rounding may only make the part that is looked up longer.
    least = F.greatest(F.lit(1), F.ceil(F.lit(bar) * F.col("n") - 1e-6))
    rank = F.row_number().over(W.partitionBy("s").orderBy("__f", "e"))
    few = (rows.agg(F.avg("__f")).first()[0] or 0) <= FEW
    ranked = rows.withColumn("rare", F.lit(True)) if few else tables.settle(rows.withColumn("rare", rank <= F.col("n") - least + 1))
    lookups = ranked.where("rare").select("e", "__f", F.col("s").alias("x"), F.col("n").alias("nx"))
    holders = ranked.select("e", "__f", F.col("s").alias("y"), F.col("n").alias("ny"))
    pairs = dealt(lookups, holders, "e", F.col("__f"), "y").where(smaller).groupBy("x", "y", "nx").agg(F.count(F.lit(1)).alias("k"))
    pairs = pairs if few else tables.settle(pairs)
    # The rarest elements are counted; what is left of the smaller set is looked up for these pairs only.
    rest = pairs.join(ranked.where("NOT rare").select(F.col("s").alias("x"), "e"), "x").join(ranked.select(F.col("s").alias("y"), "e"), ["y", "e"])
    more = rest.select("x", "y", "nx", F.lit(1).alias("k")).groupBy("x", "y", "nx").agg(F.sum("k").alias("k"))
    found = pairs.withColumnRenamed("k", "shared") if few else pairs.unionByName(more).groupBy("x", "y", "nx").agg(F.sum("k").alias("shared"))
    part = F.col("shared").cast("double") / F.col("nx").cast("double")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared", part.alias("containment")).where(F.col("containment") >= bar)


def parts_of(rows: int | None, most: int) -> int:
    return max(1, -(-(rows or 0) // most))


def shared(a: DataFrame, b: DataFrame, a_id: str, b_id: str, on: list[str]) -> DataFrame:
    """(a_id, b_id, shared): the distinct elements that two sets have in common, for pairs with any.

    An equi-join on the elements; sets that share nothing never meet.  The sets b of an element move as arrays of
    some DEAL, to the task of their set a, which counts.  There are as many tasks as no more than PAIRS meetings
    come to one on average, so what a task counts at once does not grow with the tables.
    """
    left, right = (tables.settle(x.select(i, *on).distinct()) for x, i in ((a, a_id), (b, b_id)))
    often = tables.settle(right.groupBy(*on).agg(F.count(F.lit(1)).alias("__f")))
    meetings = left.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).join(often, on).agg(F.sum(F.col("__n") * F.col("__f"))).first()[0]
    by = parts_of(left.count() + right.count(), MEMBERS)
    hot = often.where(F.col("__f") > DEAL)
    if hot.isEmpty():
        x, y, key = left.repartition(by, *on), right.repartition(by, *on), on
    else:
        hot = tables.settle(hot)
        shares = F.floor(F.coalesce("__f", F.lit(0)) / F.lit(DEAL)).cast("int")
        key = [*on, "__share"]
        x = left.join(hot, on, "left").withColumn("__share", F.explode(F.sequence(F.lit(0), shares))).drop("__f").repartition(by, *key)
        y = right.join(hot, on, "left").withColumn("__share", F.pmod(F.xxhash64(b_id), shares + 1).cast("int")).drop("__f").repartition(by, *key)
    held = y.groupBy(*key).agg(F.collect_list(F.struct(b_id)).alias("__b"))
    met = x.join(held, key).select(a_id, "__b").repartition(parts_of(meetings, PAIRS), a_id)
    return met.select(a_id, F.explode("__b").alias("__b")).select(a_id, f"__b.{b_id}").groupBy(a_id, b_id).agg(F.count(F.lit(1)).alias("shared"))
