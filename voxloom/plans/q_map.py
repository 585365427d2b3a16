"""Queries on the map and on time: fusing, votes, vocabulary, as-of joins, replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions import geometry as G
from voxloom.operators import asof, fuse, project, tables, votes
from voxloom.plans.bindings import ARRIVAL_BITS, MOMENTS_SQL, POINTS_SQL, SEQ_SQL, arrival, moments, points, table

CELL = ["cx", "cy", "cz"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("WITH pts AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_tax FROM lineitem) SELECT * FROM pts WHERE NOT (l_discount = 0 AND l_tax = 0)")
def scan_filter_zero(spark, sf):
    """Points without the empty beams and without missing or non-finite ones."""
    li = table(spark, sf, "lineitem")
    return project.non_empty(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax"), ["l_discount", "l_tax"])


@query(f"""WITH {POINTS_SQL}, {SEQ_SQL}
SELECT cx, cy, cz, count(*)::BIGINT AS n, sum(q)::DOUBLE / count(*) AS mean_q, sum(price)::DOUBLE / count(*) AS mean_price,
       sum(disc)::DOUBLE / count(*) AS mean_disc, (row_number() OVER (ORDER BY min(seq), cx, cy, cz) - 1)::BIGINT AS gidx
FROM seq GROUP BY cx, cy, cz""")
def voxel_fuse(spark, sf):
    """Occupied cells with their means and ids in order of first arrival."""
    p = points(spark, sf)
    m = fuse.fuse(p, CELL, ["q", "price", "disc"], arrival(), ARRIVAL_BITS)
    return m.select(*CELL, "n", (F.col("sum_q") / F.col("n")).alias("mean_q"), (F.col("sum_price") / F.col("n")).alias("mean_price"), (F.col("sum_disc") / F.col("n")).alias("mean_disc"), F.col("gidx").cast("long").alias("gidx"))


@query(f"""WITH {POINTS_SQL}, v AS (
  SELECT cx, cy, cz, ascii(flag) AS class_id, least(count(*), 65535)::BIGINT AS votes FROM pts GROUP BY ALL
), r AS (
  SELECT *, sum(votes) OVER (PARTITION BY cx, cy, cz) AS total,
         row_number() OVER (PARTITION BY cx, cy, cz ORDER BY votes * CASE WHEN class_id = 78 THEN 2.0 ELSE 1.0 END DESC, class_id) AS rk FROM v
), w AS (
  SELECT cx, cy, cz, CASE WHEN total >= 4 AND votes >= 0.2 * total THEN class_id END AS class_id FROM r WHERE rk = 1
)
SELECT coalesce(class_id, -1)::INT AS class_id, count(*)::BIGINT AS cells FROM w GROUP BY class_id""")
def cell_class_tally(spark, sf):
    """Which class is each occupied cell, and how many cells has each class."""
    v = votes.tally(points(spark, sf).withColumn("class_id", F.ascii("flag")), CELL, "class_id")
    w = votes.resolve(v, CELL, "class_id", F.col("class_id") == 78, bias=2.0, min_votes=4, min_conf=0.2)
    return w.groupBy(F.coalesce("class_id", F.lit(-1)).alias("class_id")).agg(F.count(F.lit(1)).alias("cells"))


@query(f"""WITH {POINTS_SQL}, o AS (
  SELECT p.*, (year(o_orderdate) * 12 + month(o_orderdate))::INT AS frame FROM pts p JOIN orders ON ok = o_orderkey
), f AS (
  SELECT cx, cy, cz, frame, count(*) AS n, sum(q) AS sq, sum(price) AS sp FROM o GROUP BY ALL
), w AS (
  SELECT cx, cy, cz, frame, sum(n) OVER x AS n, sum(sq) OVER x AS sq, sum(sp) OVER x AS sp FROM f
  WINDOW x AS (PARTITION BY cx, cy, cz ORDER BY frame ROWS UNBOUNDED PRECEDING)
)
SELECT cx, cy, cz, frame, n::BIGINT AS n, sq::DOUBLE / n::DOUBLE AS mean_q, sp::DOUBLE / n::DOUBLE AS mean_price FROM w""")
def fuse_asof_frame(spark, sf):
    """Means of each cell as of each month in which it was seen."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("frame"))
    p = points(spark, sf).join(o, F.col("ok") == F.col("o_orderkey"))
    m = fuse.as_of_frame(p, CELL, "frame", ["q", "price"])
    return m.select(*CELL, "frame", "n", (F.col("sum_q") / F.col("n")).alias("mean_q"), (F.col("sum_price") / F.col("n")).alias("mean_price"))


@query(f"""WITH {MOMENTS_SQL}, e AS (
  SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM ev
), t AS (SELECT *, max(epoch) OVER (PARTITION BY user_id) AS top FROM e)
SELECT user_id, max(epoch)::BIGINT AS kills, count(*) FILTER (epoch = top AND event_type <> 'error')::BIGINT AS n,
       coalesce(sum(cents) FILTER (epoch = top AND event_type <> 'error'), 0)::BIGINT AS sum_cents,
       count(*) FILTER (epoch = top AND event_type <> 'error') > 0 AS alive
FROM t GROUP BY user_id""")
def tombstone_revive(spark, sf):
    """Cells killed and revived: state since the last kill."""
    m = fuse.last_epoch(moments(spark, sf), ["user_id"], [F.col("us"), F.col("event_id")], F.col("event_type") == "error", ["cents"])
    return m.select("user_id", F.col("kills").cast("long").alias("kills"), F.col("n").cast("long").alias("n"), F.col("sum_cents").cast("long").alias("sum_cents"), "alive")


@query(f"""WITH {MOMENTS_SQL}, f AS (SELECT event_type AS name, min(us) AS first_us FROM ev GROUP BY 1)
SELECT name, (row_number() OVER (ORDER BY first_us, name) - 1)::INT AS class_id, (row_number() OVER (ORDER BY name) - 1)::INT AS model_id FROM f""")
def vocab_intern(spark, sf):
    """Ids in order of first sight beside those by sorted name."""
    from pyspark.sql import Window as W

    v = votes.intern(moments(spark, sf), "event_type", [F.col("us")])
    return v.withColumn("model_id", (F.row_number().over(W.orderBy("name")) - 1).cast("int"))


@query(f"""WITH {MOMENTS_SQL}, v AS (
  SELECT user_id, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS c, least(count(*), 65535) AS votes
  FROM ev GROUP BY ALL
), r AS (
  SELECT *, sum(votes) OVER (PARTITION BY user_id) AS total,
         row_number() OVER (PARTITION BY user_id ORDER BY votes * CASE WHEN c IN (0, 4) THEN 2.0 ELSE 1.0 END DESC, c) AS rk FROM v
)
SELECT user_id, CASE WHEN total >= 4 AND votes >= 0.2 * total THEN c END::INT AS class_id, votes::BIGINT AS best, total::BIGINT AS total FROM r WHERE rk = 1""")
def vote_argmax(spark, sf):
    """Biased argmax over votes with both gates (A3, A4)."""
    ids = {n: i for i, n in enumerate(["click", "error", "purchase", "signup", "view"])}
    c = F.lit(4)
    for n, i in ids.items():
        c = F.when(F.col("event_type") == n, F.lit(i)).otherwise(c)
    v = votes.tally(moments(spark, sf).withColumn("c", c), ["user_id"], "c")
    return votes.resolve(v, ["user_id"], "c", F.col("c").isin(0, 4), bias=2.0, min_votes=4, min_conf=0.2)


@query(f"""WITH {MOMENTS_SQL}, r AS (
  SELECT user_id, ts::DATE AS day, event_type AS label, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY us DESC, event_id DESC) AS rk FROM ev
)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, label FROM r WHERE rk = 1""")
def frame_label_naive(spark, sf):
    """The last label of each frame (A5)."""
    m = moments(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return votes.frame_label(m, ["user_id"], "day", [F.col("us"), F.col("event_id")], "event_type")


@query(f"""WITH {MOMENTS_SQL}, q AS (SELECT * FROM ev WHERE event_type = 'purchase'), s AS (SELECT * FROM ev WHERE event_type = 'view'),
a AS (
  SELECT q.user_id, q.event_id, q.us, p.us AS p_us, p.cents AS p_c, n.us AS n_us, n.cents AS n_c
  FROM q ASOF LEFT JOIN s p ON q.user_id = p.user_id AND q.us > p.us
         ASOF LEFT JOIN s n ON q.user_id = n.user_id AND q.us <= n.us
), b AS (
  SELECT *, CASE WHEN p_us IS NULL AND n_us IS NULL THEN 'EMPTY' WHEN n_us IS NULL THEN 'NEED_NEWER' WHEN n_us = us THEN 'OK'
                 WHEN p_us IS NULL THEN 'TOO_OLD' ELSE 'OK' END AS status FROM a
)
SELECT user_id, event_id, status, CASE WHEN status = 'OK' THEN CASE WHEN n_us = us THEN n_us ELSE p_us END END AS t0,
       CASE WHEN status = 'OK' THEN n_us END AS t1,
       CASE WHEN status <> 'OK' THEN NULL WHEN n_us = us THEN n_c::DOUBLE
            ELSE p_c + (n_c - p_c) * ((us - p_us)::DOUBLE / (n_us - p_us)::DOUBLE) END AS value
FROM b""")
def asof_bracket_lerp(spark, sf):
    """Each purchase between the views around it, with the value interpolated."""
    m = moments(spark, sf).withColumn("t", F.col("us"))
    b = asof.bracket(m.where("event_type = 'purchase'"), m.where("event_type = 'view'"), "user_id", "t", "event_id", ["cents"])
    out = asof.interpolate(b, ["cents"])
    return out.select("user_id", F.col("q_id").alias("event_id"), "status", "t0", "t1", F.col("cents").cast("double").alias("value"))


@query(f"""WITH {MOMENTS_SQL}, q AS (SELECT * FROM ev WHERE event_type = 'purchase'), s AS (SELECT * FROM ev WHERE event_type = 'click'),
a AS (
  SELECT q.user_id, q.event_id, q.us, p.us AS p_us, p.event_id AS p_id, n.us AS n_us, n.event_id AS n_id
  FROM q ASOF LEFT JOIN s p ON q.user_id = p.user_id AND q.us >= p.us
         ASOF LEFT JOIN s n ON q.user_id = n.user_id AND q.us <= n.us
)
SELECT user_id, event_id, CASE WHEN n_us IS NULL OR us - p_us <= n_us - us THEN p_id ELSE n_id END AS scan_id,
       CASE WHEN n_us IS NULL OR us - p_us <= n_us - us THEN us - p_us ELSE n_us - us END AS dt FROM a""")
def nearest_scan(spark, sf):
    """The click nearest to each purchase, the earlier of two."""
    m = moments(spark, sf).withColumn("t", F.col("us"))
    out = asof.nearest(m.where("event_type = 'purchase'"), m.where("event_type = 'click'"), "user_id", "t", "event_id", "event_id")
    return out.select("user_id", F.col("q_id").alias("event_id"), F.col("s_id").alias("scan_id"), "dt")


@query(f"""WITH {MOMENTS_SQL}, a AS (SELECT user_id, event_id, us, (event_id * 7919) % 10007 AS arrival FROM ev),
k AS (SELECT *, max(us) OVER (PARTITION BY user_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM
      (SELECT *, row_number() OVER (PARTITION BY user_id, arrival ORDER BY event_id) AS d FROM a) WHERE d = 1),
m AS (SELECT user_id, event_id, us, arrival FROM k WHERE top IS NULL OR us > top)
SELECT user_id, event_id, us, min(us) OVER w AS oldest, max(us) OVER w AS newest, count(*) OVER w AS held FROM m
WINDOW w AS (PARTITION BY user_id ORDER BY arrival ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""")
def monotonic_ring(spark, sf):
    """Samples accepted in a scrambled arrival order, with a ring of the last eight."""
    m = moments(spark, sf).select("user_id", "event_id", "us", F.pmod(F.col("event_id") * 7919, F.lit(10007)).alias("arrival"))
    m = tables.top1(m, ["user_id", "arrival"], [F.col("event_id")])
    kept = asof.monotonic(m, "user_id", "arrival", "us")
    return asof.ring(kept, "user_id", "arrival", 8, "us").select("user_id", "event_id", "us", "oldest", "newest", "held")


@query(f"""WITH {MOMENTS_SQL}, i AS (
  SELECT user_id, us, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS idx FROM ev WHERE event_type = 'view'
), w AS (SELECT * FROM i WHERE idx >= 2 AND idx < 12), span AS (SELECT user_id, min(us) AS lo, max(us) AS hi FROM w GROUP BY 1),
b AS (
  SELECT e.user_id, e.us, e.event_id, 0 AS is_image FROM ev e JOIN span USING (user_id)
  WHERE event_type = 'click' AND us BETWEEN lo - 3600000000 AND hi + 3600000000
  UNION ALL SELECT user_id, us, event_id, 1 FROM w WHERE (idx - 2) % 2 = 0
)
SELECT user_id, us, event_id, is_image::INT AS is_image, row_number() OVER (PARTITION BY user_id ORDER BY us, is_image, event_id)::INT AS pos FROM b""")
def replay_merge_window(spark, sf):
    """Two streams merged by time: an image window with stride, scans within a guard band."""
    m = moments(spark, sf)
    out = asof.replay(m.where("event_type = 'click'"), m.where("event_type = 'view'"), "user_id", "us", "event_id", 2, 10, 2, 3_600_000_000)
    return out.select("user_id", "us", "event_id", "is_image", "pos")


@query(f"""WITH {MOMENTS_SQL}, q AS (SELECT * FROM ev WHERE event_type = 'purchase'), s AS (SELECT * FROM ev WHERE event_type = 'view'),
a AS (
  SELECT q.event_id, (q.us - p.us)::DOUBLE / (n.us - p.us)::DOUBLE AS al, p.cents / 10000.0 AS y0, n.cents / 10000.0 AS y1
  FROM q ASOF JOIN s p ON q.user_id = p.user_id AND q.us > p.us ASOF JOIN s n ON q.user_id = n.user_id AND q.us <= n.us WHERE n.us > q.us
), d AS (
  SELECT *, atan2(sin(y1 - y0), cos(y1 - y0)) AS delta FROM a
), f AS (SELECT event_id, y0 + al * delta AS yaw FROM d)
SELECT event_id, round(cos(yaw), 4) + 0.0 AS c, round(sin(yaw), 4) + 0.0 AS s, round(2 * cos(yaw) - 3 * sin(yaw) + 1, 4) + 0.0 AS px FROM f""")
def slerp_pose(spark, sf):
    """Headings interpolated on the sphere, and a point carried by the pose."""
    m = moments(spark, sf).withColumn("t", F.col("us")).withColumn("yaw", F.col("cents") / 10000.0)
    b = asof.bracket(m.where("event_type = 'purchase'"), m.where("event_type = 'view'"), "user_id", "t", "event_id", ["yaw"]).where("status = 'OK' AND t1 > t")
    zero = F.lit(0.0)
    p = G.with_slerp(b.select(F.col("q_id").alias("event_id"), "yaw0", "yaw1", "alpha"), [zero, zero, F.col("yaw0")], [zero, zero, F.col("yaw1")], F.col("alpha"))
    r = G.quaternion_to_rotation([F.col(f"q{i}") for i in range(4)])
    moved = G.apply(r, [F.lit(1.0), zero, zero], [F.lit(2.0), F.lit(3.0), zero])
    return p.select("event_id", (F.round(r[0], 4) + 0.0).alias("c"), (F.round(r[3], 4) + 0.0).alias("s"), (F.round(moved[0], 4) + 0.0).alias("px"))


@query(f"""WITH {MOMENTS_SQL}, a AS (
  SELECT event_id, (cents % 600) / 100.0 - 3 AS roll, (user_id % 140) / 50.0 - 1.4 AS pitch, (event_id % 620) / 100.0 - 3.1 AS yaw, ((event_id % 7) - 3.0)::DOUBLE AS x, ((user_id % 5) - 2.0)::DOUBLE AS y, (2.0 + event_id % 9)::DOUBLE AS z FROM ev
)
SELECT event_id, round(roll, 4) + 0.0 AS roll, round(pitch, 4) + 0.0 AS pitch, round(yaw, 4) + 0.0 AS yaw, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, round(z, 4) + 0.0 AS z,
       floor(60 * x / z + 32.5 + 1e-7)::INT AS u, floor(60 * y / z + 24.5 + 1e-7)::INT AS v, round(z, 4) AS depth, 0.0::DOUBLE AS turned, 0.0::DOUBLE AS twisted FROM a""")
def pose_round_trip(spark, sf):
    """Rotations to angles and back, transforms there and back, a camera's projection of what lies before it, axes and
    adjoints: each ends where it began (E3, E5, E6, E9, E11, E20)."""
    m = moments(spark, sf)
    angle = [(F.col("cents") % 600) / 100.0 - 3, (F.col("user_id") % 140) / 50.0 - 1.4, (F.col("event_id") % 620) / 100.0 - 3.1]
    near = [(F.col("event_id") % 7) - 3.0, (F.col("user_id") % 5) - 2.0, 2.0 + F.col("event_id") % 9]
    a = m.select("event_id", *(x.alias(n) for n, x in zip(("a0", "a1", "a2", *"xyz"), [*angle, *near], strict=True)))
    r0 = G.euler_to_rotation(*(F.col(f"a{i}") for i in range(3)))
    b = a.select("*", *(x.alias(f"r{i}") for i, x in enumerate(r0)))
    r, t, p = [F.col(f"r{i}") for i in range(9)], [F.col("x") * 2 - 1, F.col("y") + 3, F.col("z") / 2], [F.col(c) for c in "xyz"]
    # the point in the world, and back again
    w = b.select("*", *(x.alias(f"w{i}") for i, x in enumerate(G.apply(r, t, p))), *(x.alias(f"t{i}") for i, x in enumerate(t)))
    world, t = [F.col(f"w{i}") for i in range(3)], [F.col(f"t{i}") for i in range(3)]
    back = G.apply(*G.invert(r, t), world)
    u, v, depth = G.pixel(G.projection(*(F.lit(k) for k in (60.0, 60.0, 32.0 + 1e-7, 24.0 + 1e-7)), r, t), world)
    theta, axis = G.angle_axis(r)
    c = w.select("*", theta.alias("th"), *(x.alias(f"k{i}") for i, x in enumerate(axis)), *(x.alias(f"b{i}") for i, x in enumerate(back)), u.alias("u"), v.alias("v"), depth.alias("depth"))
    again = G.rotation_of(F.col("th"), [F.col(f"k{i}") for i in range(3)])
    # a point that a twist moves: the adjoint's upper right block is [t]R
    ad = G.adjoint(r, t)
    cross = [t[1] * r[6 + j] - t[2] * r[3 + j] for j in range(3)]
    e = G.rotation_to_euler(r)
    off = lambda xs, ys: F.round(F.greatest(*(F.abs(x - y) for x, y in zip(xs, ys, strict=True))), 4) + 0.0
    return c.select(
        "event_id", *((F.round(x, 4) + 0.0).alias(n) for n, x in zip(("roll", "pitch", "yaw"), e, strict=True)), *((F.round(f"b{i}", 4) + 0.0).alias(n) for i, n in enumerate("xyz")),
        "u", "v", F.round("depth", 4).alias("depth"), off(again, r).alias("turned"), off(ad[3:6], cross).alias("twisted"),
    )
