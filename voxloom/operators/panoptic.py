"""Panoptic segments from scored masks, and class probabilities from two heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def resolve_segments(masks: DataFrame, queries: DataFrame, keep_ratio: float) -> DataFrame:
    """(pixel, segment, label): who owns each pixel.

    masks(query, pixel, m) with m the mask's probability, queries(query, score, label, thing).  A pixel
    goes to the query with the highest score * m (ties: the first query) if that m is at least a half.
    A segment is dropped when what it owns with m >= 0.5 is less than keep_ratio of its whole mask at that
    level, or nothing.  Things are numbered from 1 in order of the queries, stuff segments have 0.
    """
    scored = masks.join(queries, "query")
    top = scored.groupBy("pixel").agg(F.max(F.struct((F.col("score") * F.col("m")).alias("p"), (-F.col("query")).alias("neg"), "m", "label", "thing")).alias("b"))
    own = top.select("pixel", (-F.col("b.neg")).alias("query"), F.col("b.m").alias("m"), F.col("b.label").alias("label"), F.col("b.thing").alias("thing")).where("m >= 0.5")
    area = masks.where("m >= 0.5").groupBy("query").agg(F.count(F.lit(1)).alias("whole"))
    kept = own.groupBy("query", "label", "thing").agg(F.count(F.lit(1)).alias("n")).join(area, "query").where(F.col("n") >= F.lit(keep_ratio) * F.col("whole"))
    named = kept.withColumn("segment", F.when(F.col("thing"), F.sum(F.col("thing").cast("int")).over(W.orderBy("query").rowsBetween(W.unboundedPreceding, 0))).otherwise(F.lit(0)).cast("int"))
    return own.join(named.select("query", "segment"), "query").select("pixel", "query", "segment", "label")


def geometric_ensemble(a: Column, b: Column, weight: float) -> Column:
    """a^(1 - weight) * b^weight of two arrays of probabilities."""
    return F.zip_with(a, b, lambda x, y: F.pow(x, F.lit(1.0 - weight)) * F.pow(y, F.lit(weight)))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def with_void(probs: Column, void: Column) -> Column:
    """Class probabilities scaled to leave room for the void class, which is appended."""
    return F.concat(F.transform(probs, lambda x: x * (1 - void)), F.array(void))
