"""From scans, images and pixel labels to map points and objects.

Frames are worked off side by side: the map as of each frame comes from prefix sums over the frames in
which a cell was seen, kept as intervals, so no loop over frames is needed.  Kills that change what later
frames see are found in rounds (operators.feedback).  What is sequential, growing inside a frame and
merging over frames, runs by frame and by class.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.functions import geometry as G
from voxloom.functions.voxel import cell
from voxloom.operators import asof, cluster, feedback, grow, merge, objects, overlap, patches, project, tally, votes
from voxloom.operators.tables import dense_ids, settle
from voxloom.sources.config import RunConfig, from_dict

CELL = ["vx", "vy", "vz"]
POSE = ["px", "py", "pz", "roll", "pitch", "yaw"]
VIEW = ["run", "frame"]
Hook = Callable[[DataFrame, DataFrame], None]


@dataclass
class Camera:
    """Pinhole parameters and the camera's place in the body: rotation (row by row) and offset."""

    fx: float
    fy: float
    cx: float
    cy: float
    width: int
    height: int
    rotation: list[float] = field(default_factory=lambda: [1.0, 0, 0, 0, 1, 0, 0, 0, 1])
    offset: list[float] = field(default_factory=lambda: [0.0, 0, 0])


@dataclass
class Result:
    """The tables of a run; see Pipeline.batch()."""

    frames: DataFrame
    points: DataFrame
    shell: DataFrame
    proposals: DataFrame
    components: DataFrame
    members: DataFrame
    objects: DataFrame


class Pipeline:
    """scans(run, t, x, y, z, intensity, px, py, pz, roll, pitch, yaw): points in the body frame with
    their scan's pose; images(run, image_id, t); pixels(run, image_id, u, v, name, instance)."""

    def __init__(self, spark, camera: Camera, config: RunConfig | None = None):
        self.spark, self.camera, self.config = spark, camera, config or from_dict({})

    def vocabulary(self) -> DataFrame:
        return self.spark.createDataFrame(votes.declare(self.config.thing, self.config.stuff), "class_id int, name string, kind int")

    def sync(self, scans: DataFrame, images: DataFrame) -> DataFrame:
        """(run, image_id, t, scan_t, p_*): images between poses, with the pose at their time and the
        nearest scan.  Others are left out.  Frames are numbered in order of time."""
        poses = scans.select("run", "t", *POSE).distinct()
        b = asof.bracket(images, poses, "run", "t", "image_id", POSE).where("status = 'OK'")
        turned = G.with_slerp(b, *([F.col(f"{c}{k}") for c in POSE[3:]] for k in (0, 1)), F.col("alpha"))
        posed = turned.select("run", F.col("q_id").alias("image_id"), "t", *(G.lerp(F.col(f"{c}0"), F.col(f"{c}1"), F.col("alpha")).alias(f"p_{c}") for c in POSE[:3]), *(f"q{i}" for i in range(4)))
        near = asof.nearest(images, poses.withColumn("scan_t", F.col("t")), "run", "t", "image_id", "scan_t").select("run", F.col("q_id").alias("image_id"), F.col("s_t").alias("scan_t"))
        out = posed.join(near, ["run", "image_id"])
        return asof.numbered(out, "run", "t", ["image_id"], "frame")

    def matrices(self, frames: DataFrame) -> DataFrame:
        """frames with m0..m11, the projection of each image, and its camera's place."""
        c = self.camera
        body = G.quaternion_to_rotation([F.col(f"q{i}") for i in range(4)])
        one = frames.select("*", *(x.alias(f"b{i}") for i, x in enumerate(body)))
        r, t = G.compose([F.col(f"b{i}") for i in range(9)], [F.col(f"p_{a}") for a in POSE[:3]], [F.lit(float(x)) for x in c.rotation], [F.lit(float(x)) for x in c.offset])
        two = one.select("*", *(x.alias(f"r{i}") for i, x in enumerate(r)), *(x.alias(f"t{i}") for i, x in enumerate(t)))
        m = G.projection(*(F.lit(float(x)) for x in (c.fx, c.fy, c.cx, c.cy)), [F.col(f"r{i}") for i in range(9)], [F.col(f"t{i}") for i in range(3)])
        return two.select(*frames.columns, *(F.col(f"t{i}").alias(f"cam_{a}") for i, a in enumerate("xyz")), *(x.alias(f"m{i}") for i, x in enumerate(m)))

    def lift(self, scans: DataFrame, frames: DataFrame) -> DataFrame:
        """Points of each frame's scan in the world, by the scan's own pose; empty and non-finite ones go."""
        s = project.non_empty(scans, list("xyz"))
        r = G.euler_to_rotation(F.col("roll"), F.col("pitch"), F.col("yaw"))
        s = s.select("run", F.col("t").alias("scan_t"), "intensity", *(F.col(a).cast("double").alias(a) for a in "xyz"), *(F.col(a).alias(a) for a in POSE[:3]), *(x.alias(f"r{i}") for i, x in enumerate(r)))
        w = G.apply([F.col(f"r{i}") for i in range(9)], [F.col(a) for a in POSE[:3]], [F.col(a) for a in "xyz"])
        world = s.select("run", "scan_t", "intensity", *(x.alias(f"w{a}") for x, a in zip(w, "xyz", strict=True)))
        return world.join(frames, ["run", "scan_t"]).withColumnsRenamed({f"w{a}": a for a in "xyz"})

    def pixel_of(self, rows: DataFrame, truncated: bool = False) -> DataFrame:
        """rows(x, y, z, m0..m11) with u, v, depth; points behind the camera have no u and v.  With
        `truncated` also cut_u and cut_v, the pixel by which dynamic points are rejected."""
        m, p = [F.col(f"m{i}") for i in range(12)], [F.col(a) for a in "xyz"]
        u, v, d = G.pixel(m, p)
        cut = [x.alias(n) for x, n in zip(G.pixel_truncated(m, p), ("cut_u", "cut_v"), strict=True)] if truncated else []
        return rows.select(*[c for c in rows.columns if not (c[0] == "m" and c[1:].isdigit())], u.alias("u"), v.alias("v"), d.alias("depth"), *cut)

    def batch(self, scans: DataFrame, images: DataFrame, pixels: DataFrame) -> Result:
        """All frames of all runs at once."""
        online = Online(self)
        online.step(self.sync(scans, images), scans, pixels)
        return online.finish()

    def fresh(self, scans: DataFrame, frames: DataFrame, labels: DataFrame) -> DataFrame:
        """(run, frame, cell..., x, y, z, intensity): the points that frames bring to the map; those on pixels of
        dynamic classes are left out."""
        seen = self.pixel_of(self.lift(scans, frames), truncated=True)
        kept = project.reject_dynamic(seen, VIEW, "cut_u", "cut_v", labels, self.config.dynamic) if self.config.dynamic else seen
        return kept.select(*VIEW, *(cell(F.col(a), self.config.voxel).alias(c) for a, c in zip("xyz", CELL, strict=True)), *"xyz", F.col("intensity").cast("double").alias("intensity"))

    def look(self, frames: DataFrame, state: DataFrame, labels: DataFrame) -> DataFrame:
        """The shell of frames: the live cells on their front surface, with the labels of their pixels.  Dead
        cells still hide what is behind them, unless the map is cropped around the camera."""
        p = self.config
        at = self.pixel_of(self.candidates(frames, state)).where(F.col("u").isNotNull())
        radius = F.lit(p.splat) if p.splat_mult <= 0 else G.splat_radius(F.col("depth"), self.camera.fx * p.voxel * p.splat_mult, p.splat_min, p.splat)
        buffer = project.depth_buffer(at, VIEW, "u", "v", "depth", radius.cast("int"), self.camera.width, self.camera.height)
        seen = project.visible(at, buffer, VIEW, "u", "v", "depth", p.tau).where("visible AND NOT dead").drop("dead")
        front = project.front_shell(seen, VIEW, "u", "v", "depth", p.surf_band)
        return project.stamp(front, VIEW, "u", "v", labels, self.vocabulary(), p.dynamic, p.things_only)

    def candidates(self, frames: DataFrame, state: DataFrame) -> DataFrame:
        """Frame and cell pairs to be projected: the cell's state as of the frame with whether it is dead, within
        proj_radius (or else radius) of it and alive; where neither is set, all cells in the frame's frustum."""
        p = self.config
        slim = state.select("run", *CELL, "frame", "until", "killed", *"xyz", "intensity", "n")
        f = frames.select("run", F.col("frame").alias("now"), *(f"cam_{a}" for a in "xyz"), *(f"m{i}" for i in range(12)))
        live = (F.col("now") >= F.col("frame")) & (F.col("now") < F.col("until"))
        reach = p.proj_radius if p.proj_radius > 0 else p.radius
        if reach > 0:
            both = project.within(f, slim, [f"cam_{a}" for a in "xyz"], list("xyz"), reach, ["run"]).where(live & ~feedback.dead(F.col("now")))
        else:
            both = project.in_frusta(f, slim, "run", CELL, p.voxel, self.camera.width, self.camera.height, max(p.splat, p.splat_min)).where(live)
        return both.withColumn("dead", feedback.dead(F.col("now"))).drop("frame", "until", "killed", *(f"cam_{a}" for a in "xyz")).withColumnRenamed("now", "frame")

    def classify(self, last: DataFrame, shell: DataFrame) -> DataFrame:
        """The map after all frames: cells with mean, gidx, class by votes, and whether they are alive
        (a cell killed in or after the frame in which it was last seen is not).  Without voting a class
        lasts for its frame only, so it is that of the run's last frame."""
        p = self.config
        v = p.voting
        # Votes before a kill do not count.
        kills = shell.where("kill").groupBy("run", *CELL).agg(F.max("frame").alias("killed"))
        cast = shell.where("NOT kill").join(kills, ["run", *CELL], "left").where(F.col("killed").isNull() | (F.col("frame") > F.col("killed")))
        if not v["enabled"]:
            end = cast.groupBy("run").agg(F.max("frame").alias("frame"))
            cls = self.labels_of_frames(cast).join(end, ["run", "frame"]).select("run", *CELL, F.col("label").alias("class_id"), F.lit(1).cast("long").alias("total"))
        else:
            counts = votes.tally(cast, ["run", *CELL], "class_id").join(F.broadcast(self.vocabulary()), "class_id")
            cls = votes.resolve(counts, ["run", *CELL], "class_id", F.col("kind") == votes.STUFF, v["stuff_bias"], v["min_votes"], v["min_conf"]).select("run", *CELL, "class_id", "total")
        out = last.drop(*(c for c in last.columns if c.startswith("sum_"))).join(cls, ["run", *CELL], "left")
        out = out.withColumn("alive", F.col("killed").isNull())
        return dense_ids(out.drop("frame", "killed"), "first", [F.col(c) for c in ["run", *CELL]])

    def labels_of_frames(self, cast: DataFrame) -> DataFrame:
        """(run, cell..., frame, label): the class that each frame gives a cell; of several that of the
        deepest point."""
        return votes.frame_label(cast, ["run", *CELL], "frame", [F.col("depth"), F.col("class_id")], "class_id")

    def things(self, shell: DataFrame, points: DataFrame) -> DataFrame:
        """Shell points of thing classes; the class is that of the cell's votes or, without voting, the
        frame's own."""
        if not self.config.voting["enabled"]:
            item = points.select("run", *CELL, F.col("gidx").alias("item"))
            own = self.labels_of_frames(shell.where("NOT kill AND class_id IS NOT NULL")).withColumnRenamed("label", "cls")
            kinds = self.vocabulary().where(F.col("kind") == votes.THING).select(F.col("class_id").alias("cls"))
            rows = shell.where("NOT kill").select("run", "frame", *CELL, *"xyz", "instance")
            return rows.join(own, ["run", "frame", *CELL]).join(item, ["run", *CELL]).join(F.broadcast(kinds), "cls")
        voted = points.where("class_id IS NOT NULL").select("run", *CELL, F.col("class_id").alias("cls"), F.col("gidx").alias("item"))
        kinds = self.vocabulary().where(F.col("kind") == votes.THING).select(F.col("class_id").alias("cls"))
        return shell.where("NOT kill").select("run", "frame", *CELL, *"xyz", "instance").join(voted, ["run", *CELL]).join(F.broadcast(kinds), "cls")

    def propose(self, things: DataFrame) -> DataFrame:
        """(run, frame, prop, cls, inst, cell...): clusters of each class of each frame, grown over patches."""
        h, s, g = self.config.hdbscan, self.config.superpoints, self.config.grow
        if not h["enabled"]:
            return self.none_proposed(things)
        flat = things.withColumn("view", F.struct("run", "frame").cast("string"))
        base = flat
        if h["sor_enabled"]:
            base = cluster.remove_outliers(flat, ["view", "cls"], "item", list("xyz"), h["sor_mean_k"], h["sor_std_mul"])
        by, classes = (["view"], "cls") if h["single_scan"] else (["view", "cls"], None)
        c = cluster.cluster_classes(base, by, "item", list("xyz"), h["min_pts"], h["min_cluster_size"], h["min_class_points"], h["allow_single_cluster"], h["leaf_selection"], h["split_radius"], classes)
        ids = c.select("view", "cls", "cluster").distinct().withColumn("prop", F.row_number().over(W.partitionBy("view").orderBy("cls", "cluster")).cast("long"))
        member = c.join(ids, ["view", "cls", "cluster"]).select("view", "prop", F.col("cls").alias("prop_cls"), "item")
        facts = flat.select("view", "item", "cls", *"xyz", *CELL).distinct()
        full = member.join(facts, ["view", "item"])
        if g["enabled"] and s["enabled"]:
            patch = patches.supervoxels(flat, ["view"], "item", list("xyz"), self.config.voxel, s["seed"], s["spatial"], s["normal"], s["refine"]).where("supervoxel > 0")
            major = tally.segments(patch.join(facts, ["view", "item"]), ["view", "supervoxel"], "cls", s["thing_frac"])
            seg = patch.join(major.select("view", "supervoxel", F.coalesce("class_id", F.lit(-1)).alias("seg_cls")), ["view", "supervoxel"]).select("view", F.col("supervoxel").cast("long").alias("seg"), "seg_cls", "item").join(facts, ["view", "item"])
            rule = grow.Growth(g["affinity"], g["sweeps"], g["overlap_sets"], g["require_class"], g["pool_k"] if g["neighbor_pool"] else 0, g["dis_decay"], self.config.voxel)
            grown = grow.grow_frames(seg, full, "view", list("xyz"), CELL, rule).select("view", "prop", "item")
            full = grown.join(full.select("view", "prop", "prop_cls").distinct(), ["view", "prop"]).join(facts, ["view", "item"])
        where = flat.select("view", "run", "frame").distinct()
        inst = flat.groupBy("view", "item").agg(F.max("instance").alias("inst"))
        return full.join(where, "view").join(inst, ["view", "item"]).select("run", "frame", "prop", F.col("prop_cls").alias("cls"), "inst", *CELL)

    @staticmethod
    def none_proposed(things: DataFrame) -> DataFrame:
        return things.where("false").select("run", "frame", F.lit(0).cast("long").alias("prop"), "cls", F.col("instance").alias("inst"), *CELL)

    def merge(self, proposals: DataFrame, shell: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(components, members of promoted ones): contested cells go to the component with the most
        support, then the most cells, then the older.  None where objects are switched off."""
        o = self.config.objects
        if not o["enabled"]:
            proposals = proposals.where("false")
        rule = merge.Merging(tuple(o["merge_thresh"]), o["min_merges"], o["global_context"], o["min_evidence"], o["dis_decay"], o["overlap_sets"], o["require_class"], o["use_semantic_affinity"], o["use_containment"], o["small_seg_min"])
        stride = max(1, o["consol_stride"])
        seen = merge.with_views(proposals.where((F.col("frame") - 1) % stride == 0), shell, CELL)
        comps = settle(merge.consolidate_members(seen, CELL, rule))
        heads = comps.drop("cells")
        held = comps.where("promoted").select("comp", "cls", "support", "n_cells", "run", F.explode("cells").alias("c")).select("comp", "cls", "support", "n_cells", "run", *(F.col("c")[i].alias(n) for i, n in enumerate(CELL)))
        return heads, overlap.winners(held, ["run", *CELL], [F.col("support").desc(), F.col("n_cells").desc(), F.col("comp")])

    def run_on_input(self, scans: DataFrame, images: DataFrame | None, pixels: DataFrame) -> DataFrame:
        """The list of objects; empty without images.  More than one image of a run at one time is the
        caller's error, and so is one that could not be read (a column rgb that is null: a bad encoding)."""
        if images is None:
            return self.spark.createDataFrame([], "vehicle_id int, ident long, label string")
        if images.groupBy("run", "t").count().where("count > 1").limit(1).count():
            raise ValueError("more than one image at one time")
        if "rgb" in images.columns and not images.where("rgb IS NULL").isEmpty():
            raise ValueError("an image that cannot be read: a bad encoding or size")
        return self.batch(scans, images, pixels).objects


class Online:
    """A run in steps of one or more frames: begin, step for step, finish.

    After each step on_frame(frames, shell) gets its frames and what they see, on_labels(frames, labels) their
    pixel labels, and on_objects(objects) the list of objects so far, where given (it is made anew for each
    step then; the last list comes with finish()).  A step looks at its own frames only, over the map as
    the frames before have left it; its kills act on the frames that follow, in the step and after it.
    """

    def __init__(self, pipeline: Pipeline, on_frame: Hook | None = None, on_labels: Hook | None = None, on_objects: Callable[[DataFrame], None] | None = None):
        self.p, self.on_frame, self.on_labels, self.on_objects = pipeline, on_frame, on_labels, on_objects
        self.begin()

    def begin(self) -> None:
        """Forget everything."""
        self.frames = self.map = self.shell = None
        self.steps = 0

    def step(self, synced: DataFrame, scans: DataFrame, pixels: DataFrame) -> None:
        """Frames of Pipeline.sync(), later than all of the steps before, with their scans and pixels."""
        p = self.p
        frames = settle(p.matrices(synced))
        labels = settle(pixels.join(frames.select(*VIEW, "image_id"), ["run", "image_id"]).select(*VIEW, "u", "v", "name", "instance"))
        key, values = ["run", *CELL], [*"xyz", "intensity"]
        per, kills = settle(feedback.per_frame(p.fresh(scans, frames, labels), key, "frame", values)), None
        if self.map is not None:
            per = self.map.select(per.columns).unionByName(per)
            kills = self.map.where("killed IS NOT NULL").select(*key, F.col("killed").alias("frame"))
        state, shell = feedback.settle_kills(per, frames, ["run"], key, "frame", values, lambda f, s: p.look(f, s, labels), kills)
        self.map = settle(feedback.latest(state, "frame"))
        self.frames = frames if self.frames is None else self.frames.unionByName(frames)
        self.shell = shell if self.shell is None else self.shell.unionByName(shell)
        self.steps += 1
        if self.on_labels:
            self.on_labels(frames, labels)
        if self.on_frame:
            self.on_frame(frames, shell)
        if self.on_objects:
            self.on_objects(self.result().objects)

    def result(self) -> Result:
        """The tables of all steps so far."""
        p = self.p
        points = p.classify(self.map, self.shell)
        proposals = settle(p.propose(p.things(self.shell, points)))
        comps, members = p.merge(proposals, self.shell)
        named = members.join(points.where("alive").select("run", *CELL, *"xyz"), ["run", *CELL]).join(F.broadcast(p.vocabulary().select(F.col("class_id").alias("cls"), "name")), "cls")
        room = objects.room_objects(named.select(F.col("comp").alias("object_id"), F.col("name").alias("label"), *"xyz"), p.config.cam)
        return Result(self.frames, points, self.shell, proposals, comps, members, room)

    def finish(self) -> Result:
        out = self.result()
        if self.on_objects:
            self.on_objects(out.objects)
        return out
