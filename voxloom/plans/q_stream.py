"""Queries that run a stream over a table to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import votes
from voxloom.operators.tables import scratch, settle
from voxloom.plans.bindings import MOMENTS_SQL, POINTS_SQL, moments, table
from voxloom.streaming import folds, gate, keyed, mapstate, sync

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def in_order(rows, t, parts):
    """rows in so many slices of time, one after the other."""
    cuts = rows.agg(F.percentile_approx(t, [k / parts for k in range(1, parts)])).first()[0] or []
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows if lo is None else rows.where(F.col(t) > lo)
        yield part if hi is None else part.where(F.col(t) <= hi)


def fed(rows, t, folder, start, parts=4):
    """start() after each slice of rows has come as files, one micro-batch; what the last one returns."""
    for part in in_order(rows, t, parts):
        part.write.mode("append").parquet(folder)
        out = start()
    return out


def folded(rows, t, order, start, step, schema):
    """keyed.fold_stream by user over four micro-batches, each with a start of the query."""
    spark, at = rows.sparkSession, scratch(rows.sparkSession)

    def begin():
        s = spark.readStream.schema(rows.schema).parquet(f"{at}/rows")
        return keyed.run_once(keyed.fold_stream(s, "user_id", order, start, step, schema), at, "out")

    with mapstate.state_store(spark):
        return fed(rows, t, f"{at}/rows", begin)


def stream(spark, sf, name):
    """A table as a file stream."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}[.]parquet")  # as a pattern, a single file may stand for a folder


@query(f"""WITH {MOMENTS_SQL}, q AS (SELECT * FROM ev WHERE event_type = 'purchase'), s AS (SELECT * FROM ev WHERE event_type = 'view'),
a AS (
  SELECT q.user_id, q.event_id, q.us, p.us AS p_us, p.event_id AS p_id, n.us AS n_us, n.event_id AS n_id
  FROM q ASOF JOIN s p ON q.user_id = p.user_id AND q.us > p.us ASOF JOIN s n ON q.user_id = n.user_id AND q.us <= n.us
)
SELECT user_id, us AS image_t, event_id AS image_id, CASE WHEN us - p_us <= n_us - us THEN p_us ELSE n_us END AS scan_t,
       CASE WHEN us - p_us <= n_us - us THEN p_id ELSE n_id END AS scan_id FROM a""")
def stream_sync(spark, sf):
    """Images synced with poses and scans by a stream (ST1, ST2, ST3, ST4, J2)."""
    ev = table(spark, sf, "events").where("event_type IN ('purchase', 'view')")
    rows = ev.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), (F.col("event_type") == "purchase").cast("int").alias("is_image"), F.col("event_id").alias("item"), F.array("value", "value", F.lit(0.0)).alias("pose"))
    out = folded(rows, "t", ["t", "is_image", "item"], sync.Sync, sync.step("user_id"), f"user_id long, {sync.FRAMES}")
    return out.select("user_id", "image_t", "image_id", "scan_t", "scan_id")


@query(f"WITH {POINTS_SQL} SELECT cx, cy, cz, count(*)::BIGINT AS n, sum(q)::BIGINT AS sum_q, sum(price)::BIGINT AS sum_price FROM pts GROUP BY ALL")
def stream_fuse(spark, sf):
    """The map kept by a stream (ST5)."""
    li = stream(spark, sf, "lineitem")
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    p = li.select(F.floor(F.col("l_quantity") / 5).cast("int").alias("cx"), F.floor(F.col("l_extendedprice") / 5000).cast("int").alias("cy"), F.floor(cents("l_discount") / 2).cast("int").alias("cz"), F.col("l_quantity").cast("long").alias("q"), cents("l_extendedprice").alias("price"))
    at = scratch(spark)
    mapstate.publish(mapstate.fuse_stream(p, ["cx", "cy", "cz"], ["q", "price"]), at, "map").awaitTermination()
    return mapstate.snapshot(spark, at, "map", ["cx", "cy", "cz"])


@query(f"""WITH {MOMENTS_SQL}, o AS (
  SELECT *, CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 1 ELSE 0 END AS op,
         sum((event_type = 'error')::INT) OVER w AS part FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)
), f AS (
  SELECT *, sum((op = 0)::INT) OVER (PARTITION BY user_id, part ORDER BY us, event_id) AS points, max(part) OVER (PARTITION BY user_id) AS top FROM o
), e AS (  -- a part without points was dead: the kill that ends it met no live cell
  SELECT user_id, top, count(DISTINCT part) FILTER (op = 0 AND part < top)::BIGINT AS epoch, count(*) FILTER (op = 0 AND part = top) > 0 AS alive,
         count(*) FILTER (op = 0 AND part = top)::BIGINT AS n, coalesce(sum(cents) FILTER (op = 0 AND part = top), 0)::BIGINT AS sum_cents,
         count(*) FILTER (op = 1 AND part = top AND points > 0 AND event_type = 'purchase') AS v1,
         count(*) FILTER (op = 1 AND part = top AND points > 0 AND event_type = 'signup') AS v2
  FROM f GROUP BY user_id, top
)
SELECT user_id, epoch, alive, n, sum_cents, CASE WHEN v1 + v2 = 0 THEN NULL WHEN greatest(v1, v2 * 2) = v1 AND v1 >= 0.2 * (v1 + v2) THEN 1
       WHEN v2 * 2 > v1 AND v2 >= 0.2 * (v1 + v2) THEN 2 END::INT AS class_id, (v1 + v2)::BIGINT AS total FROM e""")
def stream_map_state(spark, sf):
    """The map kept by a stream of points, votes and kills (ST5, W4, P3, A3, A4), over four micro-batches, each
    with a start of the query."""
    m = moments(spark, sf)
    kind = F.when(F.col("event_type") == "error", mapstate.KILL).when(F.col("event_type").isin("purchase", "signup"), mapstate.VOTE).otherwise(mapstate.FUSE)
    ops = m.select("user_id", "us", "event_id", kind.alias("op"), F.when(F.col("event_type") == "purchase", 1).otherwise(2).alias("class_id"), "cents")
    at = scratch(spark)

    def start():
        rows = spark.readStream.schema(ops.schema).parquet(f"{at}/ops")
        mapstate.publish(mapstate.map_stream(rows, ["user_id"], ["us", "event_id"], "op", "class_id", ["cents"]), at, "cells").awaitTermination()

    with mapstate.state_store(spark):
        fed(ops, "us", f"{at}/ops", start)
    cells = mapstate.snapshot(spark, at, "cells", ["user_id"])
    ballots = cells.select("user_id", F.explode("votes").alias("v")).select("user_id", "v.class_id", F.col("v.votes").cast("long").alias("votes"))
    won = votes.resolve(ballots, ["user_id"], "class_id", F.col("class_id") == 2, bias=2.0, min_votes=1, min_conf=0.2)
    return cells.drop("votes").join(won.select("user_id", "class_id", "total"), "user_id", "left").withColumn("total", F.coalesce("total", F.lit(0)))


@query(f"""WITH RECURSIVE {MOMENTS_SQL}, q AS (SELECT user_id, us, event_id FROM ev WHERE event_type = 'error'),
g AS (
  SELECT user_id, us, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rk FROM q) WHERE rk = 1
  UNION ALL
  SELECT user_id, us, event_id FROM (
    SELECT q.user_id, q.us, q.event_id, row_number() OVER (PARTITION BY q.user_id ORDER BY q.us, q.event_id) AS rk
    FROM g JOIN q ON q.user_id = g.user_id AND q.us >= g.us + 86400000000) WHERE rk = 1
) SELECT user_id, us, event_id, us + 86400000000 AS done_t FROM g""")
def stream_gate(spark, sf):
    """Requests let through one at a time by a stream (ST7, ST9)."""
    ev = moments(spark, sf).where("event_type = 'error'").select("user_id", "us", "event_id")
    return folded(ev, "us", ["us", "event_id"], dict, folds.gate_step("user_id", "us", "event_id", 86_400_000_000), "user_id long, us long, event_id long, done_t long")


@query(f"""WITH {MOMENTS_SQL}, l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) AS was FROM ev)
SELECT user_id, us, event_id, event_type FROM l WHERE was IS DISTINCT FROM event_type""")
def stream_delta(spark, sf):
    """Rows that change their key's value, by a stream (ST11)."""
    ev = moments(spark, sf).select("user_id", "us", "event_id", "event_type")
    return folded(ev, "us", ["us", "event_id"], dict, folds.delta_step("user_id", ["event_type"], ["user_id", "us", "event_id", "event_type"]), "user_id long, us long, event_id long, event_type string")


@query(f"""WITH RECURSIVE {MOMENTS_SQL}, n AS (
  SELECT user_id, us, event_id, event_type = 'error' AS req, event_type = 'view' AS ok,
         count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY us, event_id) - event_id % 3 AS id
  FROM ev WHERE event_type IN ('error', 'view', 'signup')
), e AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, req, CASE WHEN req THEN event_id END, id) AS rn FROM n
), s AS (
  SELECT DISTINCT user_id, 0::BIGINT AS rn, 1::BIGINT AS nxt, false AS shut, []::BIGINT[] AS pend, NULL::BIGINT AS us, NULL::BIGINT AS event_id, NULL::BIGINT AS id, NULL::VARCHAR AS status FROM e
  UNION ALL
  SELECT e.user_id, e.rn, CASE WHEN req AND NOT shut THEN nxt + 1 ELSE nxt END, req AND (shut OR len(pend) < 2),
         CASE WHEN req AND NOT shut AND len(pend) < 2 THEN list_append(pend, nxt) WHEN NOT req THEN list_filter(pend, lambda x: x <> e.id) ELSE pend END, e.us, CASE WHEN req THEN e.event_id END,
         CASE WHEN NOT req THEN e.id WHEN NOT shut AND len(pend) < 2 THEN nxt END,
         CASE WHEN req THEN CASE WHEN shut THEN 'BUSY' WHEN len(pend) < 2 THEN 'SENT' ELSE 'FULL' END WHEN NOT list_contains(pend, e.id) THEN 'UNKNOWN' WHEN ok THEN 'READ' ELSE 'FAILED' END
  FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1
)
SELECT s.user_id, s.us AS t, CASE WHEN s.status IN ('READ', 'FAILED') THEN q.event_id ELSE s.event_id END AS item, s.id, s.status
FROM s LEFT JOIN s q ON q.user_id = s.user_id AND q.id = s.id AND q.status = 'SENT' WHERE s.rn > 0""")
def stream_match(spark, sf):
    """Requests matched with results by id, over four micro-batches, each with a start of the query (ST7, ST9, J12)."""
    from pyspark.sql import Window as W

    m = moments(spark, sf).where("event_type IN ('error', 'view', 'signup')")
    before = F.sum((F.col("event_type") == "error").cast("long")).over(W.partitionBy("user_id").orderBy("us", "event_id"))
    rows = m.select("user_id", F.col("us").alias("t"), F.col("event_id").alias("item"), (F.col("event_type") == "error").alias("req"), (F.col("event_type") == "view").alias("ok"), (before - F.col("event_id") % 3).alias("id"))
    rows, at = settle(rows.select("user_id", "t", "item", "req", "ok", "id")), scratch(spark)

    def start():
        s = spark.readStream.schema(rows.schema).parquet(f"{at}/rows")
        out = gate.match_stream(s.where("req"), s.where("NOT req").withColumn("text", F.lit("read")), "user_id", queue=2)
        return keyed.run_once(out, at, "matched")

    with mapstate.state_store(spark):
        out = fed(rows, "t", f"{at}/rows", start)
    return out.select("user_id", "t", "item", "id", "status")
