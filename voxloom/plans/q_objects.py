"""Queries on neighbours, clusters, components and what is published."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions import ids as I
from voxloom.functions import timeconv as T
from voxloom.operators import cluster, grow, merge, objects, panoptic, patches, tables, tally
from voxloom.plans.bindings import MOMENTS_SQL, POINTS_SQL, moments, points, table
from voxloom.plans.q_view import SETS_SQL, set_tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def vectors(spark, sf):
    """embeddings as points: their first three components."""
    return table(spark, sf, "embeddings").select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")))


VEC_SQL = "e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
NEAR_SQL = f"""{VEC_SQL}, near AS (
  SELECT a.label, a.vec_id AS a, b.vec_id AS b, {D2} AS d2,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY {D2}, b.vec_id) AS rank FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
)"""


@query(f"WITH {NEAR_SQL} SELECT label, a, b, round(d2, 9) AS d2, rank::INT AS rank FROM near WHERE rank <= 4")
def knn_topk(spark, sf):
    """The four nearest vectors of the same label."""
    return cluster.knn(vectors(spark, sf), ["label"], "vec_id", list("xyz"), 4).withColumn("d2", F.round("d2", 9))


@query(f"""WITH {NEAR_SQL}, m AS (SELECT label, a AS vec_id, sum(sqrt(d2)) / 8 AS mean FROM near WHERE rank <= 8 GROUP BY ALL),
g AS (SELECT label, count(*) AS n, avg(mean) + stddev_pop(mean) AS bound FROM m GROUP BY label)
SELECT label, vec_id FROM m JOIN g USING (label) WHERE n <= 9 OR mean <= bound""")
def sor_outlier(spark, sf):
    """Vectors that are no outliers among their label's."""
    return cluster.remove_outliers(vectors(spark, sf), ["label"], "vec_id", list("xyz"), 8, 1.0).select("label", "vec_id")


@query(f"""WITH RECURSIVE {VEC_SQL}, pairs AS (
  SELECT a.vec_id AS s, b.vec_id AS t FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE {D2} <= 0.08 * 0.08
), reach AS (SELECT vec_id AS s, vec_id AS t FROM e UNION SELECT r.s, p.t FROM reach r JOIN pairs p ON r.t = p.s)
SELECT label, e.vec_id, min(t) AS comp FROM e JOIN reach ON e.vec_id = reach.s GROUP BY ALL""")
def euclid_components(spark, sf):
    """Components of vectors linked within a radius."""
    return cluster.radius_components(vectors(spark, sf), ["label"], "vec_id", list("xyz"), 0.08).select("label", "vec_id", "comp")


@query()
def hdbscan_by_class(spark, sf):
    """Density clusters of each label."""
    return cluster.cluster_classes(vectors(spark, sf), ["label"], "vec_id", list("xyz"), min_pts=5, least=5, split=0.25)


# Patches: voxels, normals in closed form, and each round as a CTE of its own.
VOXEL_SQL = f"""{VEC_SQL}, sc AS (SELECT vec_id, label, x / 0.05::DOUBLE AS u, y / 0.05::DOUBLE AS v, z / 0.05::DOUBLE AS w FROM e),
pt AS (SELECT *, floor(u)::BIGINT AS cx, floor(v)::BIGINT AS cy, floor(w)::BIGINT AS cz FROM sc),
fold AS (SELECT label, cx, cy, cz, count(*) AS n, sum(floor((u - cx) * 1e6)::BIGINT)::BIGINT AS sx, sum(floor((v - cy) * 1e6)::BIGINT)::BIGINT AS sy, sum(floor((w - cz) * 1e6)::BIGINT)::BIGINT AS sz FROM pt GROUP BY ALL),
vx AS MATERIALIZED (SELECT label, cx, cy, cz, cx * 1000000 + (2 * sx + n) // (2 * n) AS px, cy * 1000000 + (2 * sy + n) // (2 * n) AS py, cz * 1000000 + (2 * sz + n) // (2 * n) AS pz
  FROM fold WHERE label IN (SELECT label FROM fold GROUP BY label HAVING sum(n) >= 8)),
df AS (SELECT a.label, a.cx, a.cy, a.cz, b.px - a.cx * 1000000 AS x, b.py - a.cy * 1000000 AS y, b.pz - a.cz * 1000000 AS z
  FROM vx a JOIN vx b ON a.label = b.label AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AND abs(a.cz - b.cz) <= 1),
cv AS (SELECT label, cx, cy, cz, count(*) AS n, (count(*) * sum(x * x) - sum(x) * sum(x))::DOUBLE AS a, (count(*) * sum(x * y) - sum(x) * sum(y))::DOUBLE AS b, (count(*) * sum(x * z) - sum(x) * sum(z))::DOUBLE AS c,
  (count(*) * sum(y * y) - sum(y) * sum(y))::DOUBLE AS d, (count(*) * sum(y * z) - sum(y) * sum(z))::DOUBLE AS f, (count(*) * sum(z * z) - sum(z) * sum(z))::DOUBLE AS g FROM df GROUP BY ALL),
cq AS (SELECT *, (a + d + g) / 3 AS q, b * b + c * c + f * f AS o FROM cv),
cp AS (SELECT *, sqrt(((a - q) * (a - q) + (d - q) * (d - q) + (g - q) * (g - q) + o * 2) / 6) AS p FROM cq),
ch AS (SELECT *, ((a - q) / p * ((d - q) / p * ((g - q) / p) - f / p * (f / p)) - b / p * (b / p * ((g - q) / p) - f / p * (c / p)) + c / p * (b / p * (f / p) - (d - q) / p * (c / p))) / 2 AS h FROM cp WHERE n >= 3 AND p > 0),
ce AS (SELECT *, q + p * 2 * cos(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, h))) / 3 + 2.0::DOUBLE * pi() / 3) AS e FROM ch),
cr AS (SELECT label, cx, cy, cz, q, unnest([{{'i': 0, 'x': b * f - c * (d - e), 'y': c * b - (a - e) * f, 'z': (a - e) * (d - e) - b * b}},
  {{'i': 1, 'x': b * (g - e) - c * f, 'y': c * c - (a - e) * (g - e), 'z': (a - e) * f - b * c}}, {{'i': 2, 'x': (d - e) * (g - e) - f * f, 'y': f * c - b * (g - e), 'z': b * f - (d - e) * c}}], recursive := true) FROM ce),
cl AS (SELECT *, x * x + y * y + z * z AS l FROM cr),
ct AS (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY label, cx, cy, cz ORDER BY l DESC, i) = 1),
nm AS (SELECT label, cx, cy, cz, floor(x / sqrt(l) * 10000 + 0.5)::BIGINT AS nx, floor(y / sqrt(l) * 10000 + 0.5)::BIGINT AS ny, floor(z / sqrt(l) * 10000 + 0.5)::BIGINT AS nz FROM ct WHERE l > 1e-12 * q * q * q * q),
vn AS (SELECT vx.*, coalesce(nx, 0) AS mx, coalesce(ny, 0) AS my, coalesce(nz, 0) AS mz FROM vx LEFT JOIN nm USING (label, cx, cy, cz)),
vo AS (SELECT * REPLACE (CASE WHEN away THEN -mx ELSE mx END AS mx, CASE WHEN away THEN -my ELSE my END AS my, CASE WHEN away THEN -mz ELSE mz END AS mz)
  FROM (SELECT *, mx * floor(px / 1e6) + my * floor(py / 1e6) + mz * floor(pz / 1e6) > 0 AS away FROM vn)),
vs AS (SELECT *, floor(px / 4e6)::BIGINT AS ix, floor(py / 4e6)::BIGINT AS iy, floor(pz / 4e6)::BIGINT AS iz FROM vo),
s0 AS MATERIALIZED (SELECT label, cx, cy, cz, px, py, pz, mx, my, mz, 0::BIGINT AS cost, CASE WHEN row_number() OVER (PARTITION BY label, ix, iy, iz
    ORDER BY (px - (ix + 0.5::DOUBLE) * 4e6) ** 2 + (py - (iy + 0.5::DOUBLE) * 4e6) ** 2 + (pz - (iz + 0.5::DOUBLE) * 4e6) ** 2, cx, cy, cz) = 1
  THEN ((ix + 1048576) << 42) + ((iy + 1048576) << 21) + iz + 1048576 ELSE 0 END AS k FROM vs)"""


def _middle(state: str) -> str:
    """Whole means of positions and sums of normals of each patch of a state."""
    whole = lambda p: f"(2 * sum({p}) + count(*) - ((2 * sum({p}) + count(*)) % (2 * count(*)) + 2 * count(*)) % (2 * count(*)))::BIGINT // (2 * count(*))"
    return f"SELECT label, k, {', '.join(f'{whole(f'p{a}')} AS p{a}, sum(m{a})::BIGINT AS m{a}' for a in 'xyz')} FROM {state} WHERE k > 0 GROUP BY ALL"


def _round_sql(state: str, to: str) -> str:
    cost = """floor((0.9::DOUBLE * sqrt((v.px - o.px)::DOUBLE * (v.px - o.px) + (v.py - o.py)::DOUBLE * (v.py - o.py) + (v.pz - o.pz)::DOUBLE * (v.pz - o.pz)) / 4e6 + 0.5::DOUBLE * CASE WHEN v.l * o.l > 0
  THEN 1 - abs(v.mx::DOUBLE * o.mx + v.my::DOUBLE * o.my + v.mz::DOUBLE * o.mz) / (v.l * o.l) ELSE 1.0 END) * 1e6)::BIGINT"""
    length = "sqrt(mx::DOUBLE * mx + my::DOUBLE * my + mz::DOUBLE * mz) AS l"
    return f""", {to}o AS (SELECT *, {length} FROM ({_middle(state)})), {to}v AS (SELECT *, {length} FROM {state}),
{to}n AS (SELECT DISTINCT b.label, b.cx, b.cy, b.cz, a.k FROM {state} a JOIN {state} b ON a.label = b.label AND a.k > 0 AND a.k <> b.k AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AND abs(a.cz - b.cz) <= 1),
{to}b AS (SELECT label, cx, cy, cz, n.k AS k2, {cost} AS c2 FROM {to}n n JOIN {to}v v USING (label, cx, cy, cz) JOIN {to}o o ON n.label = o.label AND n.k = o.k
  QUALIFY row_number() OVER (PARTITION BY label, cx, cy, cz ORDER BY c2, k2) = 1),
{to} AS MATERIALIZED (SELECT label, cx, cy, cz, px, py, pz, mx, my, mz, CASE WHEN k2 > 0 AND (k = 0 OR c2 < cost) THEN c2 ELSE cost END AS cost, CASE WHEN k2 > 0 AND (k = 0 OR c2 < cost) THEN k2 ELSE k END AS k
  FROM {state} LEFT JOIN {to}b USING (label, cx, cy, cz))"""


def _replant_sql(state: str, to: str) -> str:
    return f""", {to} AS MATERIALIZED (SELECT label, v.cx, v.cy, v.cz, v.px, v.py, v.pz, v.mx, v.my, v.mz, 0::BIGINT AS cost, CASE WHEN v.k > 0 AND row_number() OVER (PARTITION BY label, v.k
  ORDER BY (v.px - o.px)::DOUBLE ** 2 + (v.py - o.py)::DOUBLE ** 2 + (v.pz - o.pz)::DOUBLE ** 2, v.cx, v.cy, v.cz) = 1 THEN v.k ELSE 0 END AS k FROM {state} v LEFT JOIN ({_middle(state)}) o USING (label, k))"""


def _patches_sql() -> str:
    """Six rounds (1.8 * 0.2 / 0.05 - 1), seeds moved once, six rounds."""
    grown = [_round_sql(f"s{i}", f"s{i + 1}") for i in range(6)] + [_replant_sql("s6", "t0")] + [_round_sql(f"t{i}", f"t{i + 1}") for i in range(6)]
    return f"WITH {VOXEL_SQL}{''.join(grown)} SELECT label, vec_id, coalesce(k, 0)::BIGINT AS supervoxel FROM pt LEFT JOIN t6 USING (label, cx, cy, cz)"


@query(_patches_sql())
def supervoxels(spark, sf):
    """Patches of each label's vectors, seeds moved once."""
    return patches.supervoxels(vectors(spark, sf), ["label"], "vec_id", list("xyz"), 0.05, 0.2, refine=1)


@query(f"""WITH {POINTS_SQL}, s AS (SELECT cx, cy, ascii(flag) AS c, count(*) AS n FROM pts GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY cx, cy) AS total, row_number() OVER (PARTITION BY cx, cy ORDER BY n DESC, c) AS rk FROM s),
i AS (SELECT cx, cy, count(DISTINCT sk % 17)::BIGINT AS ids, avg(disc) AS mean_disc FROM pts GROUP BY ALL)
SELECT r.cx, r.cy, total::BIGINT AS n, CASE WHEN n >= 0.4 * total THEN c END::INT AS class_id, n::BIGINT AS best, n::DOUBLE / total::DOUBLE AS confidence, ids, round(mean_disc, 6) AS mean_disc
FROM r JOIN i USING (cx, cy) WHERE rk = 1""")
def segment_majority(spark, sf):
    """Majority class, confidence, ids and mean of each segment."""
    p = points(spark, sf).withColumn("c", F.ascii("flag"))
    extra = p.groupBy("cx", "cy").agg(F.countDistinct(F.pmod("sk", F.lit(17))).alias("ids"), F.round(F.avg("disc"), 6).alias("mean_disc"))
    return tally.segments(p, ["cx", "cy"], "c", 0.4).join(extra, ["cx", "cy"])


@query(f"""WITH {VEC_SQL}, h AS (SELECT (vec_id % 40)::BIGINT AS item, label, count(*) AS n FROM e GROUP BY ALL),
c AS (SELECT (vec_id % 40)::BIGINT AS item, sum(round(x * 1e6)::BIGINT)::DOUBLE AS x, sum(round(y * 1e6)::BIGINT)::DOUBLE AS y, sum(round(z * 1e6)::BIGINT)::DOUBLE AS z FROM e GROUP BY 1),
nb AS (SELECT a, b FROM (SELECT a.item AS a, b.item AS b, row_number() OVER (PARTITION BY a.item ORDER BY {D2}, b.item) AS rk FROM c a JOIN c b ON a.item <> b.item) WHERE rk <= 4),
u AS (SELECT item, label, n::DOUBLE AS w FROM h UNION ALL SELECT nb.a, label, n * 0.2::DOUBLE FROM nb JOIN h ON h.item = nb.b)
SELECT item, label, round(sum(w), 6) AS pooled FROM u GROUP BY ALL""")
def neighbor_pool(spark, sf):
    """Histograms with a share of the four nearest neighbours' (G10)."""
    v = vectors(spark, sf).withColumn("item", F.pmod("vec_id", F.lit(40)))
    hist = v.groupBy("item", "label").agg(F.count(F.lit(1)).alias("n"))
    centres = v.groupBy("item").agg(*(F.sum(F.round(F.col(c) * 1e6).cast("long")).cast("double").alias(c) for c in "xyz")).withColumn("g", F.lit(0))
    near = cluster.knn(centres, ["g"], "item", list("xyz"), 4).select("a", "b")
    return grow.pool_histograms(hist, near, "item", "label", 0.2).withColumn("pooled", F.round("pooled", 6))


@query()
def grow_sweeps(spark, sf):
    """Proposals grown over segments, frame by frame.

    The table has no proposals: the first line of an order (`ln = 1`) has the role of an original member;
    the others are in segments only, and growth reaches them or does not.
    """
    p = points(spark, sf).select((F.col("day") - F.pmod("day", F.lit(30))).alias("frame"), "cx", "cy", "cz", "sk", "pk", "ln", F.ascii("flag").alias("cls"), F.xxhash64("ok", "ln", "pk", "sk", "price").alias("item"), F.col("cx").cast("double").alias("x"), F.col("cy").cast("double").alias("y"), F.col("cz").cast("double").alias("z"))
    seg = p.select("frame", F.pmod("sk", F.lit(20)).alias("seg"), F.lit(78).alias("seg_cls"), "item", "cls", "x", "y", "z", "cx", "cy", "cz")
    prop = p.where("ln = 1").select("frame", F.pmod("pk", F.lit(7)).alias("prop"), F.lit(78).alias("prop_cls"), "item", "cls", "x", "y", "z", "cx", "cy", "cz")
    out = grow.grow_frames(seg, prop, "frame", ["x", "y", "z"], ["cx", "cy", "cz"], grow.Growth(margin=1.0))
    return out.groupBy("frame", "prop").agg(F.count(F.lit(1)).alias("members"), F.sum(F.col("added").cast("int")).alias("added"))


@query(f"""WITH RECURSIVE {SETS_SQL}, n AS (SELECT prop, count(*) AS size FROM ord GROUP BY 1),
p AS (SELECT a.prop AS a, b.prop AS b, count(*) AS shared FROM ord a JOIN ord b ON a.e = b.e AND a.prop < b.prop GROUP BY ALL),
g AS (SELECT a, b FROM p JOIN n x ON x.prop = a JOIN n y ON y.prop = b WHERE shared::DOUBLE / least(x.size, y.size)::DOUBLE >= 0.24),
u AS (SELECT a, b FROM g UNION SELECT b, a FROM g),
reach AS (SELECT prop AS s, prop AS t FROM n UNION SELECT r.s, u.b FROM reach r JOIN u ON r.t = u.a)
SELECT s AS prop, min(t) AS comp FROM reach GROUP BY s""")
def containment_merge(spark, sf):
    """Sets united by containment."""
    _, prop = set_tables(spark, sf)
    return merge.merge_sets(prop.select("prop", "e"), "prop", ["e"], 0.24)


EDGES_SQL = """dep AS (
  SELECT (l_suppkey % 30)::BIGINT AS a, (l_partkey % 30)::BIGINT AS b, round(l_discount * 100)::BIGINT AS s, l_quantity::BIGINT AS c FROM lineitem
), ed AS (
  SELECT least(a, b) AS lo, greatest(a, b) AS hi, sum(s * c)::DOUBLE AS sim_conf, sum(c)::DOUBLE AS conf FROM dep WHERE a <> b GROUP BY ALL
), edges AS (SELECT *, sim_conf / conf AS adj FROM ed)"""


def deposits(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.pmod("l_suppkey", F.lit(30)).alias("a"), F.pmod("l_partkey", F.lit(30)).alias("b"), F.round(F.col("l_discount") * 100).cast("long").alias("sim"), F.col("l_quantity").cast("long").alias("conf"))


@query(f"""WITH {EDGES_SQL}, bo AS (SELECT lo AS a, hi AS b, adj FROM edges UNION ALL SELECT hi, lo, adj FROM edges),
t AS (SELECT a, b, b AS k, 1.0::DOUBLE AS f FROM bo UNION ALL SELECT x.a, x.b, y.b, 0.3::DOUBLE FROM bo x JOIN bo y ON x.b = y.a AND y.b <> x.a),
r AS (SELECT t.a, t.b, sum(f * (k + 1) * coalesce(bo.adj, 0)) / sum(f * (k + 1)) AS region FROM t LEFT JOIN bo ON bo.a = t.a AND bo.b = t.k GROUP BY ALL)
SELECT r.a, r.b, round(adj, 6) AS adj, round(region, 6) AS region FROM r JOIN bo USING (a, b)""")
def edge_affinity(spark, sf):
    """Affinities of pairs and of their neighbourhoods."""
    e = tables.settle(merge.edge_sums(deposits(spark, sf)))
    nodes = e.select(F.col("lo").alias("node")).union(e.select("hi")).distinct().withColumn("w", F.col("node") + 1)
    r = merge.region_scores(e, nodes, F.lit(0.3))
    both = e.select(F.col("lo").alias("a"), F.col("hi").alias("b"), "adj").unionByName(e.select(F.col("hi").alias("a"), F.col("lo").alias("b"), "adj"))
    return r.join(both, ["a", "b"]).select("a", "b", F.round("adj", 6).alias("adj"), F.round("region", 6).alias("region"))


@query()
def consolidate_fold(spark, sf):
    """Proposals folded into components over all frames."""
    p = points(spark, sf)
    props = p.select((F.col("day") - F.pmod("day", F.lit(60))).cast("long").alias("frame"), F.pmod("sk", F.lit(8)).alias("prop"), F.ascii("flag").alias("cls"), F.pmod("pk", F.lit(5)).alias("inst"), "cx", "cy")
    return merge.consolidate(props, ["cx", "cy"])


@query(f"""WITH {EDGES_SQL}, bo AS (SELECT lo AS node, hi AS target, adj FROM edges UNION ALL SELECT hi, lo, adj FROM edges),
sp AS (SELECT a AS node, count(*) AS support FROM dep GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(adj, 9) DESC, target) AS rk FROM bo)
SELECT node, target, round(adj, 6) AS adj, support::BIGINT AS support FROM r JOIN sp USING (node)
WHERE rk = 1 AND support < (SELECT avg(support) FROM sp)""")
def small_comp_absorb(spark, sf):
    """Components of little support with the neighbour that takes them in."""
    d = deposits(spark, sf)
    nodes = tables.settle(d.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("support")))
    mean = nodes.agg(F.avg("support")).first()[0] or 0.0
    small = nodes.where(F.col("support") < F.lit(mean))
    e = merge.edge_sums(d).withColumn("adj", F.round("adj", 9))
    return merge.absorb_once(small, e, 2**31 - 1).withColumn("adj", F.round("adj", 6))


@query(f"""WITH {VEC_SQL}, p AS (SELECT DISTINCT label, x, y FROM e), m AS (SELECT label, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM e GROUP BY label),
d AS (SELECT label, count(*) AS n FROM p GROUP BY label),
edges AS (
  SELECT a.label, a.x, a.y FROM p a JOIN p b ON a.label = b.label AND (a.x <> b.x OR a.y <> b.y)
  WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.label = a.label AND (
    (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
    OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) > 0)))
), corners AS (SELECT DISTINCT * FROM edges UNION SELECT p.* FROM p JOIN d USING (label) WHERE d.n < 3)
SELECT label, x, y, round(cx, 6) AS cx, round(cy, 6) AS cy FROM corners JOIN m USING (label)""")
def convex_hull(spark, sf):
    """Hull corners of each label's vectors in the plane, with its centroid."""
    h = cluster.hulls(vectors(spark, sf), "label", "x", "y").select("label", F.explode("polygon").alias("c"), "cx", "cy")
    return h.select("label", "c.x", "c.y", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query(f"""WITH {VEC_SQL} SELECT 211 AS vehicle_id, label::BIGINT AS ident, 'class' || label AS label, '' AS direction,
  round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, xor(211::BIGINT << 48, label::BIGINT) AS node FROM e GROUP BY label""")
def room_objects(spark, sf):
    """Published objects: keys, label, centroid."""
    v = vectors(spark, sf).withColumn("object_id", F.col("label").cast("long")).withColumn("label", F.concat(F.lit("class"), F.col("label").cast("string")))
    o = objects.room_objects(v, 211, k=0)
    return o.select("vehicle_id", "ident", "label", "direction", F.round("centroid.x", 6).alias("cx"), F.round("centroid.y", 6).alias("cy"), I.node_key(F.col("vehicle_id"), F.col("ident")).alias("node"))


@query(f"""WITH {VEC_SQL}, near AS (
  SELECT a.label, a.vec_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.vec_id) AS rank FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
), w AS (SELECT label, vec_id, sum(sqrt(d2)) / 8 AS mean FROM near WHERE rank <= 8 GROUP BY ALL), g AS (SELECT label, avg(mean) + stddev_pop(mean) AS bound FROM w GROUP BY label),
n AS (SELECT label, count(*) AS n FROM e GROUP BY label),
kept AS (SELECT e.* FROM e JOIN n USING (label) LEFT JOIN w USING (vec_id) LEFT JOIN g ON g.label = e.label WHERE n <= 9 OR mean <= bound),
p AS (SELECT DISTINCT label, x, y FROM kept), m AS (SELECT label, avg(x) AS cx, avg(y) AS cy FROM kept GROUP BY label), d AS (SELECT label, count(*) AS n FROM p GROUP BY label),
edges AS (
  SELECT a.label, a.x, a.y FROM p a JOIN p b ON a.label = b.label AND (a.x <> b.x OR a.y <> b.y)
  WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.label = a.label AND (
    (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
    OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) > 0)))
), corners AS (SELECT DISTINCT * FROM edges UNION SELECT p.* FROM p JOIN d USING (label) WHERE d.n < 3)
SELECT 211 AS vehicle_id, label::BIGINT AS ident, 'class' || label AS label, x, y, round(cx, 6) AS cx, round(cy, 6) AS cy FROM corners JOIN m USING (label)""")
def room_polygons(spark, sf):
    """Published footprints: the hull and centroid of each object's points without outliers."""
    v = vectors(spark, sf).withColumn("object_id", F.col("label").cast("long")).withColumn("label", F.concat(F.lit("class"), F.col("label").cast("string")))
    o = objects.room_objects(v, 211).select("vehicle_id", "ident", "label", F.explode("polygon").alias("c"), "centroid")
    return o.select("vehicle_id", "ident", "label", "c.x", "c.y", F.round("centroid.x", 6).alias("cx"), F.round("centroid.y", 6).alias("cy"))


@query(f"""WITH {MOMENTS_SQL}, s AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, arg_max(event_type, (us, event_id)) AS label, count(*) // 4 AS size FROM ev GROUP BY ALL),
l AS (SELECT *, lag(label) OVER w AS pl, lag(size) OVER w AS ps, row_number() OVER w AS rk FROM s WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, day, label, size::BIGINT AS size FROM l WHERE rk = 1 OR pl IS DISTINCT FROM label OR ps IS DISTINCT FROM size""")
def delta_changed(spark, sf):
    """Snapshots that differ from those sent before (ST11)."""
    m = moments(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    s = m.groupBy("user_id", "day").agg(F.max(F.struct("us", "event_id", "event_type")).alias("t"), F.floor(F.count(F.lit(1)) / 4).cast("long").alias("size"))
    s = s.select("user_id", "day", F.col("t.event_type").alias("label"), "size")
    return objects.changes(s, ["user_id"], "day", ["label", "size"]).select("user_id", "day", "label", "size")


@query(f"""WITH RECURSIVE {MOMENTS_SQL}, q AS (SELECT user_id, us, event_id FROM ev WHERE event_type = 'error'),
g AS (
  SELECT user_id, us, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rk FROM q) WHERE rk = 1
  UNION ALL
  SELECT user_id, us, event_id FROM (
    SELECT q.user_id, q.us, q.event_id, row_number() OVER (PARTITION BY q.user_id ORDER BY q.us, q.event_id) AS rk
    FROM g JOIN q ON q.user_id = g.user_id AND q.us >= g.us + 86400000000) WHERE rk = 1
) SELECT user_id, us, event_id, us + 86400000000 AS done_t FROM g""")
def sign_gate(spark, sf):
    """Requests let through one at a time (ST7)."""
    m = moments(spark, sf).where("event_type = 'error'")
    return objects.single_flight(m, "user_id", "us", "event_id", 86_400_000_000)


@query("""WITH p AS (SELECT l_partkey % 100 AS instance, (l_orderkey % 20)::BIGINT AS frame, (l_suppkey % 64)::INT AS u, (l_linenumber)::INT AS v FROM lineitem),
n AS (SELECT frame, instance, count(*) AS n, min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1 FROM p GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY n DESC, instance) AS rk FROM n WHERE n >= 20)
SELECT frame, instance, n::BIGINT AS n, u0, u1, v0, v1 FROM r WHERE rk = 1""")
def instance_boxes(spark, sf):
    """The largest instance of each frame with its box."""
    li = table(spark, sf, "lineitem")
    p = li.select(F.pmod("l_partkey", F.lit(100)).alias("instance"), F.pmod("l_orderkey", F.lit(20)).alias("frame"), F.pmod("l_suppkey", F.lit(64)).cast("int").alias("u"), F.col("l_linenumber").cast("int").alias("v"))
    return objects.largest_instance(p, ["frame"], 20)


@query("""WITH m AS (SELECT (l_suppkey % 12)::BIGINT AS q, (l_partkey % 300)::BIGINT AS px, max(l_discount * 10)::DOUBLE AS m FROM lineitem GROUP BY ALL),
s AS (SELECT (s_suppkey % 12)::BIGINT AS q, max(s_suppkey) AS k FROM supplier GROUP BY 1),
b AS (SELECT px, m.q, m, row_number() OVER (PARTITION BY px ORDER BY ((k % 7) + 1) * 0.125 * m DESC, m.q) AS rk FROM m JOIN s ON m.q = s.q),
o AS (SELECT * FROM b WHERE rk = 1 AND m >= 0.5), w AS (SELECT q, count(*) AS whole FROM m WHERE m >= 0.5 GROUP BY q),
k AS (SELECT o.q, count(*) AS n FROM o GROUP BY o.q), kept AS (SELECT k.q FROM k JOIN w ON k.q = w.q WHERE n >= 0.02 * whole),
num AS (SELECT q, CASE WHEN q % 2 = 0 THEN sum((q % 2 = 0)::INT) OVER (ORDER BY q ROWS UNBOUNDED PRECEDING) ELSE 0 END AS segment FROM kept)
SELECT px AS pixel, o.q AS query, segment::INT AS segment, ('L' || (o.q % 5)) AS label FROM o JOIN num ON o.q = num.q""")
def panoptic_resolve(spark, sf):
    """Owners of pixels among scored masks."""
    m = table(spark, sf, "lineitem").groupBy(F.pmod("l_suppkey", F.lit(12)).alias("query"), F.pmod("l_partkey", F.lit(300)).alias("pixel")).agg(F.max(F.col("l_discount") * 10).alias("m"))
    s = table(spark, sf, "supplier").groupBy(F.pmod("s_suppkey", F.lit(12)).alias("query")).agg(F.max("s_suppkey").alias("k"))
    q = s.select("query", ((F.pmod("k", F.lit(7)) + 1) * 0.125).alias("score"), F.concat(F.lit("L"), F.pmod("query", F.lit(5)).cast("string")).alias("label"), (F.pmod("query", F.lit(2)) == 0).alias("thing"))
    return panoptic.resolve_segments(m, q, 0.02)


@query("""SELECT l_returnflag AS kind, l_linestatus AS cls, count(*)::BIGINT AS n, (GROUPING(l_returnflag) * 2 + GROUPING(l_linestatus))::INT AS level
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def class_tally_rollup(spark, sf):
    """Counts by kind and class with totals."""
    return tally.by_kind(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("cls")), "kind", "cls")


@query(f"""WITH {MOMENTS_SQL}, f AS (SELECT event_type AS cls, ts::DATE AS d, count(DISTINCT user_id) AS ids FROM ev GROUP BY ALL)
SELECT cls, count(*)::BIGINT AS frames, sum(ids)::DOUBLE / count(*) AS mean_ids FROM f GROUP BY cls""")
def id_overseg_stats(spark, sf):
    """Ids by class and frame."""
    return tally.segmentation(moments(spark, sf).withColumn("d", F.to_date("ts")).withColumnRenamed("event_type", "cls"), "d", "cls", "user_id")


@query("""WITH RECURSIVE px AS (
  SELECT (l_orderkey % 40)::BIGINT AS frame, (l_suppkey % 24)::INT AS u, l_linenumber::INT AS v, min(l_partkey) % 90 AS id FROM lineitem GROUP BY 1, 2, 3
), k AS (SELECT DISTINCT frame, id, id % 5 AS c FROM px), t AS (
  SELECT DISTINCT a.frame, a.id AS a, b.id AS b FROM px a JOIN px b ON a.frame = b.frame AND ((b.u = a.u + 1 AND b.v = a.v) OR (b.u = a.u AND b.v = a.v + 1))
  WHERE a.id <> b.id AND a.id % 5 = b.id % 5
), e AS (SELECT a, b FROM t UNION SELECT b, a FROM t), r AS (SELECT DISTINCT id AS s, id AS t FROM px UNION SELECT r.s, e.b FROM r JOIN e ON r.t = e.a),
g AS (SELECT count(DISTINCT s) AS ids, count(DISTINCT m) AS groups FROM (SELECT s, min(t) AS m FROM r GROUP BY s)),
m AS (SELECT sum(n)::DOUBLE / count(*) AS mean_ids FROM (SELECT frame, c, count(*) AS n FROM k GROUP BY ALL)),
f AS (SELECT count(DISTINCT frame) AS frames FROM px), x AS (SELECT count(DISTINCT frame) AS touching FROM t)
SELECT frames::BIGINT AS frames, mean_ids, touching::BIGINT AS touching, touching::DOUBLE / frames AS touching_share, ids::BIGINT AS ids, groups::BIGINT AS groups, ids::DOUBLE / groups AS ids_per_group FROM f, x, m, g""")
def id_oversegmentation(spark, sf):
    """Ids that touch others of their class: how many frames have them, and ids for one group of them."""
    li = table(spark, sf, "lineitem")
    px = li.groupBy(F.pmod("l_orderkey", F.lit(40)).alias("frame"), F.pmod("l_suppkey", F.lit(24)).cast("int").alias("u"), F.col("l_linenumber").cast("int").alias("v")).agg(F.pmod(F.min("l_partkey"), F.lit(90)).alias("id"))
    return tally.oversegmentation(px.withColumn("cls", F.pmod("id", F.lit(5))), ["frame"], "u", "v", "cls")


@query("""WITH px AS (SELECT DISTINCT (p_partkey % 64)::INT AS u, (p_size % 48)::INT AS v, min(p_partkey) % 9 AS id FROM part GROUP BY p_partkey % 64, p_size % 48)
SELECT least(a.id, b.id) AS lo, greatest(a.id, b.id) AS hi, count(*)::BIGINT AS n FROM px a JOIN px b ON (b.u = a.u + 1 AND b.v = a.v) OR (b.u = a.u AND b.v = a.v + 1)
WHERE a.id <> b.id GROUP BY ALL""")
def id_adjacency(spark, sf):
    """Ids that touch in a raster."""
    from voxloom.operators.project import neighbour_pixels

    px = table(spark, sf, "part").groupBy(F.pmod("p_partkey", F.lit(64)).cast("int").alias("u"), F.pmod("p_size", F.lit(48)).cast("int").alias("v")).agg(F.pmod(F.min("p_partkey"), F.lit(9)).alias("id"))
    n = neighbour_pixels(px, [], "u", "v").where("id1 <> id2")
    return n.groupBy(F.least("id1", "id2").alias("lo"), F.greatest("id1", "id2").alias("hi")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, ((p_partkey * 2654435761) & 4294967295)::BIGINT AS hash, (p_partkey % 20)::INT AS palette,
(p_partkey & 255)::INT AS r, ((p_partkey >> 8) & 255)::INT AS g, ((p_partkey >> 16) & 255)::INT AS b FROM part""")
def color_hash(spark, sf):
    """Colours of ids."""
    p = table(spark, sf, "part").select("p_partkey")
    r, g, b = I.rgb_of(F.col("p_partkey"))
    return p.select("p_partkey", I.colour_hash(F.col("p_partkey")).alias("hash"), I.palette_index(F.col("p_partkey")).alias("palette"), r.alias("r"), g.alias("g"), b.alias("b"))


@query("""SELECT event_id, xor((user_id % 65536) << 48, event_id)::BIGINT AS node, (epoch_us(ts) * 1000)::BIGINT AS ns, (epoch_us(ts) * 10)::BIGINT AS ticks,
(epoch_us(ts) // 1000000)::BIGINT AS secs, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, ('img' || (epoch_us(ts) * 1000)::BIGINT) AS name FROM events""")
def node_keys(spark, sf):
    """Keys and conversions of times."""
    from voxloom.functions.text import image_name

    e = table(spark, sf, "events").withColumn("ns", T.timestamp_to_ns(F.col("ts")))
    return e.select("event_id", I.node_key(F.pmod("user_id", F.lit(65536)), F.col("event_id")).alias("node"), "ns", T.ns_to_ticks(F.col("ns")).alias("ticks"), T.ns_to(F.col("ns"), "s").alias("secs"), T.date_text(F.col("ns")).alias("text"), image_name(F.col("ns")).alias("name"))
