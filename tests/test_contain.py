"""Containment and overlap joins against all pairs, with elements that most sets hold."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from voxloom.operators import contain


def skewed(seed, n=120):
    """Sets of which half hold one element, and some are parts of others."""
    rng, rows = random.Random(seed), []
    for s in range(n):
        own = {rng.randrange(400) for _ in range(rng.randrange(1, 12))}
        if s % 3 == 0 and s:
            other = [e for t, e in rows if t == s - 1]
            own = set(rng.sample(other, max(1, len(other) * 3 // 4))) | {rng.randrange(400)}
        rows += [(s, e) for e in sorted(own | ({-1} if s % 2 else set()))]
    return rows


def all_pairs(rows, bar):
    sets = defaultdict(set)
    for s, e in rows:
        sets[s].add(e)
    out = []
    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            part = k / min(len(sets[a]), len(sets[b]))
            if a < b and k and part >= bar:
                out.append((a, b, k, part))
    return sorted(out)


@pytest.mark.parametrize(("seed", "bar", "few"), [(0, 0.3, 0), (1, 0.5, 64), (2, 0.75, 0), (3, 1.0, 0), (4, 0.01, 0), (5, 0.4, 64)])
def test_contained_equals_all_pairs(spark, monkeypatch, seed, bar, few):
    """By rare elements (few = 0), and where no element is held by many sets."""
    monkeypatch.setattr(contain, "DEAL", 8)
    monkeypatch.setattr(contain, "FEW", few)
    rows = skewed(seed)
    df = spark.createDataFrame(rows + rows[:50], "s long, e int").withColumn("z", F.col("e") % 7)
    got = sorted(map(tuple, contain.contained(df, "s", ["e", "z"], bar).collect()))
    assert got == all_pairs(rows, bar)


def test_an_element_in_half_of_all_sets(spark):
    """It is looked up for few sets, and its holders are dealt."""
    n = 6000
    rows = [(s, e) for s in range(n) for e in ([0] if s % 2 else []) + [10 + 5 * s + k for k in range(4)]]
    rows += [(n + s, 10 + 5 * s + k) for s in range(0, n, 100) for k in range(3)]  # parts of some
    df = spark.createDataFrame(rows, "s long, e int")
    assert sorted(map(tuple, contain.contained(df, "s", ["e"], 0.75).collect())) == [(s, n + s, 3, 1.0) for s in range(0, n, 100)]
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        held = df.where("e = 0").select("e", F.lit(3000).alias("__f"), F.col("s").alias("y"))
        asks = spark.createDataFrame([(0, 3000, -1)], "e int, __f int, x long")
        sizes = [r["count"] for r in contain.dealt(asks, held, "e", F.col("__f"), "y").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set(name, before)
    assert sum(sizes) == 3000 and len(sizes) > 1 and max(sizes) < 2600


@pytest.mark.parametrize("deal", [3, 1000])
def test_shared_counts(spark, monkeypatch, deal):
    monkeypatch.setattr(contain, "DEAL", deal)
    a, b = skewed(5, 40), skewed(6, 40)
    got = sorted(map(tuple, contain.shared(spark.createDataFrame(a, "p long, e int"), spark.createDataFrame(b, "q long, e int"), "p", "q", ["e"]).collect()))
    sets = [defaultdict(set), defaultdict(set)]
    for rows, into in ((a, sets[0]), (b, sets[1])):
        for s, e in rows:
            into[s].add(e)
    assert got == sorted((p, q, len(x & y)) for p, x in sets[0].items() for q, y in sets[1].items() if x & y)


def test_shared_counts_few_meetings_in_a_task(spark, monkeypatch):
    """The tasks that count grow with the meetings, so that none counts more pairs at once as tables grow."""
    rows = [(s, e) for s in range(60) for e in range(s % 7, 40, 7)]
    a, b = spark.createDataFrame(rows, "p long, e int"), spark.createDataFrame(rows + [(None, 3)], "q long, e int")
    meetings = a.join(b, "e").count()
    monkeypatch.setattr(contain, "PAIRS", 100, raising=False)
    out = contain.shared(a, b, "p", "q", ["e"])
    assert out.rdd.getNumPartitions() >= meetings / 100 > 10
    assert sorted(map(str, out.collect())) == sorted(map(str, a.join(b, "e").groupBy("p", "q").agg(F.count(F.lit(1)).alias("shared")).collect()))
