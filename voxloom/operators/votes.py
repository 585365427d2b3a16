"""Class votes of cells, and the vocabulary of classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SATURATION = 65535  # a fixed value: votes of one class for one cell stop there
THING, STUFF, UNKNOWN = 1, 2, 0


def tally(votes: DataFrame, key: list[str], cls: str) -> DataFrame:
    """(key..., class, votes), saturated."""
    return votes.groupBy(*key, cls).agg(F.least(F.count(F.lit(1)), F.lit(SATURATION)).cast("long").alias("votes"))


def resolve(counts: DataFrame, key: list[str], cls: str, stuff: Column, bias: float = 1.0, min_votes: int = 1, min_conf: float = 0.0) -> DataFrame:
    """(key..., class_id, best, total): the class with the most weight, stuff classes weighing `bias`.

    Ties go to the lower class.  class_id is null when there are fewer than min_votes votes or the
    winner has less than min_conf of them (both by raw votes).  The bias and min_votes are at least 1,
    min_conf is between 0 and 1.
    """
    bias, min_votes, min_conf = max(1.0, bias), max(1, min_votes), min(1.0, max(0.0, min_conf))
    weight = F.col("votes") * F.when(stuff, F.lit(bias)).otherwise(F.lit(1.0))
    best = counts.groupBy(*key).agg(F.max(F.struct(weight.alias("w"), (-F.col(cls)).alias("neg"), "votes")).alias("m"), F.sum("votes").alias("total"))
    ok = (F.col("total") >= min_votes) & (F.col("m.votes") >= F.lit(min_conf) * F.col("total"))
    return best.select(*key, F.when(ok, -F.col("m.neg")).alias("class_id"), F.col("m.votes").alias("best"), "total")


def frame_label(votes: DataFrame, key: list[str], frame: str, order: list[Column], cls: str) -> DataFrame:
    """The last class written to each cell in each frame; nothing is kept from frame to frame."""
    w = W.partitionBy(*key, frame).orderBy(*[o.desc() for o in order])
    return votes.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*key, frame, F.col(cls).alias("label"))


def intern(names: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """(name, class_id): ids from 0 in the order in which names were first seen.  A name keeps its id
    when more rows follow."""
    first = names.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.min(F.struct(*order)).alias("f"))
    return first.select("name", (F.row_number().over(W.orderBy("f", "name")) - 1).cast("int").alias("class_id"))


def declare(things: list[str], stuff: list[str]) -> list[tuple[int, str, int]]:
    """(class_id, name, kind) in order of declaration; a name is entered once, its first kind stays."""
    seen: dict[str, int] = {}
    for name, kind in [(n, THING) for n in things] + [(n, STUFF) for n in stuff]:
        seen.setdefault(name, kind)
    return [(i, n, k) for i, (n, k) in enumerate(seen.items())]


def model_labels(things: list[str], stuff: list[str]) -> list[str]:
    """Names by model label: sorted things, then sorted stuff; a name listed twice has two labels."""
    return sorted(things) + sorted(stuff)
