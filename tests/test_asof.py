"""Time joins whose runs are cut into segments, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from voxloom.operators import asof


def tables(spark, seed, n=60):
    rng = random.Random(seed)
    q = [(r, rng.randrange(-400, 400), i) for i, r in enumerate(rng.choices("abc", k=n))]
    s = [(r, rng.randrange(-400, 400, 3), 1000 + i, rng.randrange(50)) for i, r in enumerate(rng.choices("ab", k=n))]
    return q, s, spark.createDataFrame(q, "run string, t long, q_id int"), spark.createDataFrame(s, "run string, t long, s_id int, v int")


@pytest.mark.parametrize(("seed", "bits"), [(0, 3), (1, 6), (2, 20)])
def test_bracket_and_nearest(spark, seed, bits):
    queries, samples, q, s = tables(spark, seed)
    got = {r.q_id: r for r in asof.bracket(q, s, "run", "t", "q_id", ["v"], bits).collect()}
    near = {r.q_id: r for r in asof.nearest(q, s, "run", "t", "q_id", "s_id", bits).collect()}
    assert len(got) == len(near) == len(queries)
    for run, t, i in queries:
        own = sorted((x[1], x[3]) for x in samples if x[0] == run)
        before, after = [x for x in own if x[0] < t], [x for x in own if x[0] >= t]
        if not own:
            want = ("EMPTY", None, None)
        elif not after:
            want = ("NEED_NEWER", None, None)
        elif after[0][0] == t:
            want = ("OK", t, t)
        else:
            want = ("OK", before[-1][0], after[0][0]) if before else ("TOO_OLD", None, None)
        r = got[i]
        assert (r.status, r.t0, r.t1) == want
        if want[0] == "OK":
            assert r.v1 == after[0][1] and r.v0 == (after[0][1] if want[1] == t else before[-1][1])
        best = min(((abs(x[1] - t), x[1], x[2]) for x in samples if x[0] == run), default=(None, None, None))
        assert (near[i].dt, near[i].s_t, near[i].s_id) == best


@pytest.mark.parametrize("bits", [2, 30])
def test_numbers_and_rising_times(spark, bits):
    rng = random.Random(bits)
    rows = [(rng.choice("ab"), a, rng.randrange(300)) for a in rng.sample(range(-200, 200), 150)]
    df = spark.createDataFrame(rows, "run string, arrival long, t long")
    kept, tops = [], {}
    for run, a, t in sorted(rows, key=lambda r: r[1]):
        if t > tops.get(run, -1):
            kept.append((run, a, t))
            tops[run] = t
    assert sorted(map(tuple, asof.monotonic(df, "run", "arrival", "t", bits).collect())) == sorted(kept)
    numbers = {(r.run, r.arrival): r.k for r in asof.numbered(df, "run", "arrival", ["t"], "k", bits).collect()}
    for run in "ab":
        own = sorted(a for r, a, _ in rows if r == run)
        assert [numbers[run, a] for a in own] == list(range(1, len(own) + 1))


def test_a_long_run_is_not_one_task(spark):
    q = spark.range(4000).select(F.lit("r").alias("run"), (F.col("id") * 10).alias("t"), F.col("id").alias("q_id"))
    s = spark.range(4000).select(F.lit("r").alias("run"), (F.col("id") * 10 + 5).alias("t"), F.col("id").alias("v"))
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        out = asof.bracket(q, s, "run", "t", "q_id", ["v"], 8).withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in out.groupBy("p").count().collect()]
    finally:
        spark.conf.set(name, before)
    assert sum(sizes) == 4000 and len(sizes) > 2 and max(sizes) < 3000
