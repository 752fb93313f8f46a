"""Fits, greedy choices, sources and streams on the test tables (V rows of the inventory; most have no SQL form)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.operators import choosing, fitting, neighbours, spatial, temporal
from orrery.plans.binding import CLOUD, FRAMES, OBJECTS, cloud, frames, objects
from orrery.plans.relations import CHUNKS
from orrery.plans.projections import r6, sr
from orrery.plans.registry import Registry
from orrery.session import materialize, shared_dir, table
from orrery.sources import packs, points
from orrery.streaming import incremental

query = Registry()
Q = g.Later("q", "wxyz")


@query("a12_oriented_box")
def a12(spark, d):
    return fitting.oriented_box(cloud(spark, d), ["dataset"])


@query("a13_principal_axes")
def a13(spark, d):
    return fitting.principal_axes(cloud(spark, d), ["dataset"])


@query("a19_mean_rotation")
def a19(spark, d):
    r = g.rotation_of(Q)
    cols = [f"r{i}{j}" for i in range(3) for j in range(3)]
    f = frames(spark, d).select("dataset", "cam", *[r[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)])
    return fitting.mean_rotation(f, ["dataset", "cam"], cols)


def _axes_pairs(spark, d):
    """Viewing direction of each camera A frame and the one of camera B at the same moment, between its neighbours."""
    f = g.rotation_of(Q)[2]
    t = frames(spark, d).select("dataset", "cam", F.col("name").alias("key"), F.unix_micros("ts").alias("t"), *[c.alias(a) for c, a in zip(f, ("fx", "fy", "fz"))])
    a = t.filter("cam = 'A'").select("dataset", "t", "fx", "fy", "fz")
    b = t.filter("cam = 'B'")
    hit = temporal.bracket_join(b.select("dataset", "key", "t"), a, ["dataset"], ["fx", "fy", "fz"], 600_000)
    own = b.select("key", *[F.col(c).alias("b" + c[1]) for c in ("fx", "fy", "fz")])
    return hit.join(own, "key").select("dataset", *[F.col("prev_" + c).alias("a" + c[1]) for c in ("fx", "fy", "fz")], "bx", "by", "bz", F.lit(1.0).alias("w"))


@query("a20_rig_rotation")
def a20(spark, d):
    return fitting.align_vectors(_axes_pairs(spark, d), ["dataset"], ["ax", "ay", "az"], ["bx", "by", "bz"], "w")


@query("a21_similarity", f"WITH {FRAMES} SELECT dataset, cam, 2.0 AS s, count(*) AS n FROM frames GROUP BY 1, 2 HAVING count(*) >= 3 AND var_pop(px) + var_pop(py) + var_pop(pz) > 1e-12")
def a21(spark, d):
    """Each camera's track onto itself turned, shifted and scaled by 2: the scale is found again, from all pairs."""
    f = frames(spark, d).select("dataset", "cam", F.col("px").alias("ax"), F.col("py").alias("ay"), F.col("pz").alias("az"))
    p = f.withColumn("bx", 2 * F.col("az") + 1).withColumn("by", 2 * F.col("ay") - 3).withColumn("bz", -2 * F.col("ax"))
    return fitting.similarity(p, ["dataset", "cam"]).filter("s is not null").select("dataset", "cam", r6(F.col("s"), "s", 4), "n")


@query("a22_ground_plane")
def a22(spark, d):
    return fitting.ground_plane(cloud(spark, d).select("dataset", "x", "y", "z"), ["dataset"])


@query("a23_track_fit", CHUNKS + f", p AS (SELECT c.dataset, c.cam, c.chunk, f.px, f.py, f.pz FROM c JOIN frames f ON f.name = c.name) SELECT dataset, cam, chunk, CASE WHEN count(*)*(var_pop(px) + var_pop(py) + var_pop(pz)) >= 2.25e-12 THEN 1.5 ELSE 0.0 END AS scale, count(*) AS n FROM p GROUP BY 1, 2, 3")
def a23(spark, d):
    """Chunks in their own units, 1.5 times smaller and from their first frame on: the scale is found again."""
    f = temporal.chunk_windows(frames(spark, d), ["dataset", "cam"], ["ts", "name"], 24, 6)
    first = [F.first(c).over(W.partitionBy("dataset", "cam", "chunk").orderBy("ts", "name")) for c in ("px", "py", "pz")]
    local = [((F.col(c) - o) / 1.5).alias("q" + c[1]) for c, o in zip(("px", "py", "pz"), first)]
    fit = fitting.fit_track(f.select("dataset", "cam", "chunk", *local, "px", "py", "pz"), ["dataset", "cam", "chunk"])
    return fit.select("dataset", "cam", F.col("chunk").cast("long").alias("chunk"), r6(F.col("scale"), "scale", 4), "n")


@query("a37_point_radius", f"WITH {OBJECTS}, o AS (SELECT id, coalesce(dataset, '') AS dataset, cx, cy, cz FROM obj WHERE cx IS NOT NULL AND cy IS NOT NULL AND cz IS NOT NULL), n AS (SELECT a.dataset, a.id, min(sqrt((a.cx - b.cx)**2 + (a.cy - b.cy)**2 + (a.cz - b.cz)**2)) AS d FROM o a JOIN o b ON a.dataset = b.dataset AND a.id <> b.id GROUP BY 1, 2) SELECT dataset, {sr('1.6*median(d)', 'radius', 9)} FROM n GROUP BY dataset")
def a37(spark, d):
    """1.6 times the median distance to the nearest other object, per recording (the reference samples; this takes all, however far)."""
    o = objects(spark, d).dropna(subset=["cx", "cy", "cz"]).select(F.col("id").alias("seq"), F.coalesce("dataset", F.lit("")).alias("dataset"), *[F.col("c" + c).alias(c) for c in "xyz"])
    return neighbours.nearest(o, None, 1, ["dataset"]).groupBy("dataset").agg(r6(1.6 * F.median("dist"), "radius", 9))


@query("j22_seam_chain", f"WITH s AS (SELECT dataset, cam, run_no, chunk, max(CASE WHEN centre_gap_med > 0 AND centre_gap_med < 1e4 THEN ln(centre_gap_med) END) AS r FROM poses_report GROUP BY 1, 2, 3, 4), n AS (SELECT *, CASE WHEN r IS NULL OR lag(chunk) OVER w IS NULL OR chunk - lag(chunk) OVER w <> 1 THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY dataset, cam, run_no ORDER BY chunk)), g AS (SELECT *, sum(new) OVER (PARTITION BY dataset, cam, run_no ORDER BY chunk) AS grp FROM n) SELECT dataset, cam, run_no, chunk, {sr('sum(CASE WHEN new = 1 THEN 0 ELSE r END) OVER (PARTITION BY dataset, cam, run_no, grp ORDER BY chunk)', 'log_scale', 5)} FROM g")
def j22(spark, d):
    s = table(spark, d, "poses_report").groupBy("dataset", "cam", "run_no", "chunk").agg(F.max(F.when((F.col("centre_gap_med") > 0) & (F.col("centre_gap_med") < 1e4), F.log("centre_gap_med"))).alias("log_ratio"))
    return choosing.chain_scales(s, ["dataset", "cam", "run_no"]).withColumn("log_scale", r6(F.col("log_scale"), "log_scale", 5))


def _view_candidates(spark, d, least_span: float | None):
    """Frames of an object's recording at any distance, with bearing, size in pixels and place in the camera's sequence.

    With `least_span` only frames that see the object at least so many pixels large. The reach then grows with the object,
    so objects meet the frames on a grid whose side is the power of two above their reach.
    """
    f = temporal.placed(frames(spark, d).select("dataset", "cam", "name", "ts", "px", "pz"), ["dataset", "cam"], "ts", ["ts", "name"]).drop("ts").withColumnRenamed("pos", "i")
    o = objects(spark, d).dropna(subset=["cx", "cz", "sx"]).select("id", F.coalesce("dataset", F.lit("")).alias("dataset"), "cx", "cz", "sx")
    if least_span is None:
        both = o.join(f, "dataset")
    else:
        cell = lambda x, z: [F.floor(F.col(c) / F.col("side")).alias(g) for c, g in ((x, "gx"), (z, "gz"))]
        reach = 1183.5 * F.col("sx") / least_span
        o = o.filter("sx > 0").withColumn("side", F.pow(F.lit(2.0), F.ceil(F.log2(reach)))).select("*", *cell("cx", "cz"))
        around = F.explode(F.array(*[F.struct((F.col("gx") + a).alias("gx"), (F.col("gz") + b).alias("gz")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
        sides = o.select("dataset", "side").distinct()
        seen = f.join(sides, "dataset").select("*", *cell("px", "pz")).withColumn("c", around).drop("gx", "gz").select("*", "c.gx", "c.gz")
        both = o.join(seen, ["dataset", "side", "gx", "gz"])
    dist = F.hypot(F.col("px") - F.col("cx"), F.col("pz") - F.col("cz"))
    both = both.withColumn("dist", dist).filter("dist > 1").withColumn("span", 1183.5 * F.col("sx") / F.col("dist")).filter(F.lit(least_span is None) | (F.col("span") >= (least_span or 0.0)))
    return both.select("id", "name", "cam", "i", F.atan2(F.col("px") - F.col("cx"), F.col("pz") - F.col("cz")).alias("bearing"), "span", F.lit(1.0).alias("vis"))


def _objects_and_frames(spark, d):
    o = objects(spark, d).dropna(subset=["cx", "cz", "sx"]).select("id", F.coalesce("dataset", F.lit("")).alias("dataset"), "cx", "cz", "sx")
    return o, frames(spark, d).select("dataset", "name", "px", "pz")


@query("o04_auto_views")
def o04(spark, d):
    """Candidate views per object, those of at least 36 pixels as in the reference, and the greedy choice among them (G05)."""
    return choosing.auto_views(_view_candidates(spark, d, 36.0), ["id"])


@query("o05_quality_views")
def o05(spark, d):
    """All frames are candidates: without a good one the two best count."""
    return choosing.near_quality_views(*_objects_and_frames(spark, d))


def cloud_normals(spark, d):
    """seq, nx, ny, nz, cx, cy, cz: normals of all finite points, and the camera (or, without one, the middle) they face."""
    c = materialize(cloud(spark, d).select("seq", "dataset", "x", "y", "z"), "normals-points")
    return fitting.surface_normals(c, frames(spark, d).select("dataset", F.col("name").alias("seq"), *[F.col("p" + a).alias(a) for a in "xyz"]))


@query("g06_normals", f"WITH {CLOUD} SELECT seq, true AS unit, true AS faces FROM cloud")
def g06(spark, d):
    """Normals of all points of the cloud from their 20 nearest, smoothed once, turned to the nearest camera of the recording
    or, where it has none, away from its middle. What SQL can say of them: every point has one, of length 1, on that side."""
    n = cloud_normals(spark, d)
    return n.select("seq", (F.abs(F.sqrt(sum((F.col("n" + a) ** 2 for a in "xyz"), F.lit(0.0))) - 1) < 1e-6).alias("unit"), (F.col("facing") >= 0).alias("faces"))


@query("g07_place_asset", f"WITH {CLOUD}, b AS (SELECT dataset, quantile_cont(x, 0.02) AS lx, quantile_cont(x, 0.98) AS hx, quantile_cont(y, 0.02) AS ly FROM cloud GROUP BY dataset) SELECT seq, {sr('(x - (lx + hx)/2)*(4.0/(hx - lx)) + 10', 'x', 4)}, {sr('(y - ly)*(4.0/(hx - lx)) + 1.5', 'y', 4)} FROM cloud c JOIN b ON c.dataset = b.dataset WHERE hx > lx")
def g07(spark, d):
    """A pack scaled to a box of length 4 and set on its base: percentiles, one similarity, no collection of points."""
    c = materialize(cloud(spark, d).select("seq", "dataset", "x", "y", "z"), "asset")
    b = spatial.quantiles(c, ["dataset"], {"lx": ("x", 0.02), "hx": ("x", 0.98), "ly": ("y", 0.02)}).filter("hx > lx")
    k = 4.0 / (F.col("hx") - F.col("lx"))
    return c.join(b, "dataset").select("seq", r6((F.col("x") - (F.col("lx") + F.col("hx")) / 2) * k + 10, "x", 4), r6((F.col("y") - F.col("ly")) * k + 1.5, "y", 4))


# ---- sources and sinks: written, read again, compared with what went in
@query("s08_ply_round_trip", f"WITH {CLOUD} SELECT {sr('x', 'x', 3)}, {sr('y', 'y', 3)}, CAST(coalesce(r, 0) AS INTEGER) AS r FROM cloud")
def s08(spark, d):
    points.register(spark)
    path = shared_dir(spark, "ply")
    c = cloud(spark, d).select(*[F.col(a).cast("float").alias(a) for a in "xyz"], *[F.coalesce(F.col(a), F.lit(0)).cast("smallint").alias(a) for a in "rgb"])
    c.write.format("ply").mode("append").save(path)
    back = spark.read.format("ply").load(path)
    return back.select(r6(F.col("x").cast("double"), "x", 3), r6(F.col("y").cast("double"), "y", 3), F.col("r").cast("int").alias("r"))


@query("s11_splat_round_trip", f"WITH {CLOUD} SELECT CAST(r AS INTEGER) AS r, count(*) AS n FROM cloud WHERE r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL GROUP BY 1")
def s11(spark, d):
    points.register(spark)
    path = shared_dir(spark, "splat")
    whole = cloud(spark, d).dropna(subset=["r", "g", "b"])
    # half a step up, so that the harmonic's rounding does not lose a colour step
    lifted = whole.select("x", "y", "z", *[(F.col(c) + 0.5).alias(c) for c in "rgb"])
    packs.splats(packs.gaussians(lifted, 0.02)).write.format("splat").mode("append").save(path)
    return spark.read.format("splat").load(path).groupBy(F.col("r").cast("int").alias("r")).agg(F.count("*").alias("n"))


@query("s12_pack_box", f"WITH {CLOUD} SELECT seq FROM cloud WHERE dataset = 'rec/shuttle_line_07' AND x BETWEEN 20 AND 60 AND y BETWEEN -5 AND 20 AND z BETWEEN -10 AND 10")
def s12(spark, d):
    path = shared_dir(spark, "pack")
    packs.write_pack(cloud(spark, d), path, 5.1)
    return packs.read_box(spark, path, "rec/shuttle_line_07", 5.1, (20.0, -5.0, -10.0), (60.0, 20.0, 10.0)).select("seq")


@query("s15_json_poses", f"WITH {FRAMES} SELECT name, {sr('px', 'px', 7)} FROM frames")
def s15(spark, d):
    path = shared_dir(spark, "json")
    f = frames(spark, d).select("dataset", F.struct(F.lit(0).cast("decimal(38,0)").alias("i"), "name", F.array("px", "py", "pz").alias("p"), F.array("qw", "qx", "qy", "qz").alias("q")).alias("f"))
    f.groupBy("dataset").agg(F.collect_list("f").alias("frames")).drop("dataset").write.json(path)
    packed = spark.read.schema(packs.POSES).json(path).select(F.explode("frames").alias("f"))
    return packed.select(F.col("f.name").alias("name"), r6(F.col("f.p")[0], "px", 7))


# ---- streams: run to the end of the files there are, compared with the batch result
def _file_stream(spark, d, name):
    """The table itself as a stream of files."""
    import os

    path = f"{d}/{name}.parquet"
    schema = table(spark, d, name).schema
    if os.path.isdir(path):
        return incremental.arriving(spark, path, schema)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query("t03_stream_voxels", f"WITH {CLOUD} SELECT DISTINCT ((CAST(floor(x/0.9) AS BIGINT) + 1048576) << 42) | ((CAST(floor(y/0.9) AS BIGINT) + 1048576) << 21) | (CAST(floor(z/0.9) AS BIGINT) + 1048576) AS key FROM cloud")
def t03(spark, d):
    pts = _file_stream(spark, d, "street_pack").select(*[F.col(c).cast("double").alias(c) for c in "xyz"]).filter("not isnan(x) and not isnan(y) and not isnan(z)")
    return incremental.run_to_end(incremental.fresh_voxels(pts, 0.9).select("key"), shared_dir(spark, "stream"), shared_dir(spark, "stream-log"))


@query("t04_stream_nearest", f"WITH {CLOUD}, a AS (SELECT DISTINCT seq, x, y, z FROM cloud) SELECT ((CAST(floor(x/0.9) AS BIGINT) + 1048576) << 42) | ((CAST(floor(y/0.9) AS BIGINT) + 1048576) << 21) | (CAST(floor(z/0.9) AS BIGINT) + 1048576) AS key, {sr('min(sqrt(x*x + z*z))', 'zmin', 4)} FROM a GROUP BY 1")
def t04(spark, d):
    pts = _file_stream(spark, d, "street_pack").select(*[F.col(c).cast("double").alias(c) for c in "xyz"]).filter("not isnan(x) and not isnan(y) and not isnan(z)").withColumn("depth", F.hypot("x", "z"))
    out = incremental.run_to_end(incremental.nearest_so_far(pts, 0.9, "depth"), shared_dir(spark, "stream"), shared_dir(spark, "stream-log"), "complete")
    return out.select("key", r6(F.col("zmin"), "zmin", 4))


@query("t05_stream_latest", "SELECT id, arg_max(status, {'r': CASE status WHEN 'done' THEN 3 WHEN 'error' THEN 2 WHEN 'running' THEN 1 ELSE 0 END, 's': status}) AS status FROM jobs GROUP BY id")
def t05(spark, d):
    rank = F.when(F.col("status") == "done", 3).when(F.col("status") == "error", 2).when(F.col("status") == "running", 1).otherwise(0)
    j = _file_stream(spark, d, "jobs").select("id", "status", F.struct(rank.alias("r"), F.col("status").alias("s")).alias("o"))
    return incremental.run_to_end(incremental.latest_state(j, "id", "o", ["status"]), shared_dir(spark, "stream"), shared_dir(spark, "stream-log"), "complete")


@query("t07_stream_sessions", """WITH e AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT event_type, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1200000000 AS end_us, count(*) AS n FROM g GROUP BY event_type, s HAVING epoch_us(max(ts)) + 1800000000 <= (SELECT epoch_us(max(ts)) FROM events)""")
def t07(spark, d):
    """Sessions with a fixed gap of 20 minutes; those still open at the end of the input do not come out."""
    e = _file_stream(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    s = incremental.gap_sessions(e, ["event_type"], "ts", "20 minutes", "10 minutes")
    s = s.select("event_type", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")
    return incremental.run_to_end(s, shared_dir(spark, "stream"), shared_dir(spark, "stream-log"))


@query("t01_append_missing", "SELECT DISTINCT object_id FROM jobs WHERE object_id IS NOT NULL")
def t01(spark, d):
    """Resumable work (also T02): what is missing in the output is made and appended, twice in a row, nothing twice."""
    out = shared_dir(spark, "work")
    for _ in range(2):
        j = _file_stream(spark, d, "jobs").select("object_id").filter("object_id is not null")
        incremental.append_missing(j, out, ["object_id"], lambda b: b, shared_dir(spark, "stream-log")).awaitTermination()
    return spark.read.parquet(out)


QUERIES, ORACLES = query.queries, query.oracles
