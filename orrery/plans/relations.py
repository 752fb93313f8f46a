"""Joins, aggregates, windows, sorts and set operations (J, A, W, O, U rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.operators import neighbours, spatial, temporal
from orrery.operators.compaction import identify
from orrery.plans.binding import CLOUD, DEPTH, FRAMES, JOBS, OBJECTS, SAMPLES, cloud, depth, frames, jobs, objects, samples
from orrery.plans.data_quality import P1_IDENT
from orrery.plans.projections import K, ROI, UPRIGHT, _upright, poly_sql, r6, sr
from orrery.plans.registry import Registry
from orrery.session import materialize, table

query = Registry()

#: Tree and stem of each file, from its path as compaction reads it; the tree column only where the path names none.
STEMS = P1_IDENT.strip().removeprefix("WITH ").replace("c AS (", "path0 AS (", 1).replace("k AS (", "path1 AS (", 1).replace("FROM c)", "FROM path0)") + """,
stems AS (SELECT DISTINCT rec AS dataset, split_part(folder, '/', 1) AS tree, frame AS stem FROM path1)"""
LAYERS = STEMS.replace("SELECT DISTINCT rec AS dataset, split_part(folder, '/', 1) AS tree, frame AS stem", "SELECT DISTINCT rec AS dataset, split_part(folder, '/', 1) AS tree, folder, frame AS stem")


def files(spark, d):
    return identify(table(spark, d, "street_video").select("dataset", "tree", "path"))


def stems(spark, d):
    return files(spark, d).select(F.col("recording").alias("dataset"), F.col("tree_key").alias("tree"), F.col("frame").alias("stem")).distinct()


def frame_stem(name):
    """Stem of a frame's name as a file's path gives it: without its ending, in lower case."""
    return F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))


# ---- sources in relational form (S)
@query("s02_union_of_globs", f"WITH {STEMS} SELECT DISTINCT dataset, stem FROM stems WHERE tree IN ('rgb', 'depth')")
def s02(spark, d):
    s = stems(spark, d)
    return s.filter("tree = 'rgb'").select("dataset", "stem").union(s.filter("tree = 'depth'").select("dataset", "stem")).distinct()


@query("s19_pose_pack_share", f"WITH {STEMS}, r AS (SELECT DISTINCT dataset, stem FROM stems WHERE tree = 'rgb'), {FRAMES}, f AS (SELECT DISTINCT dataset, lower(regexp_replace(name, '\\.[^.]*$', '')) AS stem FROM frames) SELECT r.dataset, count(*) AS n, count(f.stem) AS matched, count(f.stem) * 2 >= count(*) AS usable FROM r LEFT JOIN f ON r.dataset = f.dataset AND r.stem = f.stem GROUP BY r.dataset")
def s19(spark, d):
    r = stems(spark, d).filter("tree = 'rgb'").select("dataset", "stem")
    f = frames(spark, d).select("dataset", frame_stem("name").alias("stem"), F.lit(1).alias("hit")).distinct()
    return r.join(f, ["dataset", "stem"], "left").groupBy("dataset").agg(F.count("*").alias("n"), F.count("hit").alias("matched")).withColumn("usable", F.col("matched") * 2 >= F.col("n"))


@query("s20_depth_source", f"WITH {STEMS} SELECT dataset, CASE WHEN count(*) FILTER (tree = 'depth') > 0 THEN 'depth' ELSE 'none' END AS source FROM stems GROUP BY dataset")
def s20(spark, d):
    return stems(spark, d).groupBy("dataset").agg(F.when(F.count(F.when(F.col("tree") == "depth", 1)) > 0, "depth").otherwise("none").alias("source"))


@query("s21_completeness", f"WITH {STEMS}, a AS (SELECT DISTINCT dataset, stem FROM stems WHERE tree = 'rgb') SELECT a.dataset, count(*) AS decoded FROM a WHERE EXISTS (SELECT 1 FROM stems s WHERE s.dataset = a.dataset AND s.stem = a.stem AND s.tree = 'depth') GROUP BY a.dataset")
def s21(spark, d):
    s = stems(spark, d)
    return s.filter("tree = 'rgb'").join(s.filter("tree = 'depth'"), ["dataset", "stem"], "left_semi").groupBy("dataset").agg(F.count("*").alias("decoded"))


@query("s22_pending", f"WITH {LAYERS}, p AS (SELECT count(DISTINCT folder) AS n FROM stems WHERE tree = 'layers'), g AS (SELECT dataset, stem, count(DISTINCT folder) AS n FROM stems WHERE tree = 'layers' GROUP BY 1, 2) SELECT DISTINCT a.dataset, a.stem FROM stems a, p WHERE tree = 'rgb' AND NOT EXISTS (SELECT 1 FROM g WHERE g.dataset = a.dataset AND g.stem = a.stem AND g.n = p.n)")
def s22(spark, d):
    """Frames that lack any of the products there are below layers."""
    f = files(spark, d)
    made = f.filter("tree_key = 'layers'").select(F.col("recording").alias("dataset"), F.col("frame").alias("stem"), "product").distinct()
    whole = made.select("product").distinct().agg(F.count("*").alias("n"))  # one row
    done = made.groupBy("dataset", "stem").agg(F.count("*").alias("made")).crossJoin(F.broadcast(whole)).filter("made = n")
    rgb = f.filter("tree_key = 'rgb'").select(F.col("recording").alias("dataset"), F.col("frame").alias("stem")).distinct()
    return rgb.join(done, ["dataset", "stem"], "left_anti")


@query("s25_stride", f"WITH {FRAMES}, n AS (SELECT name, row_number() OVER (PARTITION BY dataset, cam ORDER BY ts, name) - 1 AS i FROM frames) SELECT name FROM n WHERE i % 5 = 0")
def s25(spark, d):
    return temporal.placed(frames(spark, d), ["dataset", "cam"], "ts", ["ts", "name"]).filter("pos % 5 = 0").select("name")


@query("s27_recording_profile", f"WITH {FRAMES}, g AS (SELECT dataset, cam, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY dataset, cam ORDER BY ts, name) AS gap FROM frames), m AS (SELECT dataset, cam, count(*) AS n, max(t) - min(t) AS span_us, median(gap) AS usual FROM g GROUP BY 1, 2) SELECT m.dataset, m.cam, m.n, m.span_us, {sr('1e6/m.usual', 'fps', 3)}, count(*) FILTER (g.gap > greatest(1000000, 6*m.usual)) AS holes FROM m JOIN g ON m.dataset = g.dataset AND m.cam = g.cam WHERE m.usual > 0 GROUP BY ALL")
def s27(spark, d):
    f = frames(spark, d).select("dataset", "cam", "name", F.unix_micros("ts").alias("t"))
    gaps = materialize(temporal.beside(f, ["dataset", "cam"], "t", ["t", "name"], {"before": ("t", -1)}).select("dataset", "cam", "t", (F.col("t") - F.col("before")).alias("gap")), "gaps")
    m = gaps.groupBy("dataset", "cam").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span_us"), F.median("gap").alias("usual")).filter("usual > 0")
    holes = F.count(F.when(F.col("gap") > F.greatest(F.lit(1e6), 6 * F.col("usual")), 1)).alias("holes")
    return gaps.join(m, ["dataset", "cam"]).groupBy("dataset", "cam", "n", "span_us", "usual").agg(holes).select("dataset", "cam", "n", "span_us", r6(1e6 / F.col("usual"), "fps", 3), "holes")


# ---- joins (J)
@query("j01_by_frame", f"WITH {OBJECTS}, {FRAMES} SELECT o.id, f.cam, {sr('f.px', 'px', 7)} FROM obj o JOIN frames f ON o.frame = f.name")
def j01(spark, d):
    o = objects(spark, d).select("id", F.col("frame").alias("name"))
    return o.join(frames(spark, d), "name").select("id", "cam", r6(F.col("px"), "px", 7))


@query("j02_stem_fallback", f"WITH {OBJECTS}, {FRAMES}, s AS (SELECT regexp_replace(name, '\\.[^.]*$', '') AS stem, min(name) AS name FROM frames GROUP BY 1) SELECT o.id, coalesce(f.name, s.name) AS name FROM obj o LEFT JOIN frames f ON o.frame = f.name LEFT JOIN s ON regexp_replace(o.frame, '\\.[^.]*$', '') = s.stem")
def j02(spark, d):
    f = frames(spark, d).select("name")
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    s = f.groupBy(stem("name").alias("stem")).agg(F.min("name").alias("by_stem"))
    o = objects(spark, d).select("id", F.col("frame").alias("name"), stem("frame").alias("stem"))
    return o.join(f.withColumn("exact", F.col("name")), "name", "left").join(s, "stem", "left").select("id", F.coalesce("exact", "by_stem").alias("name"))


@query("j03_semi_rosters", f"WITH {STEMS}, {FRAMES}, f AS (SELECT DISTINCT dataset, lower(regexp_replace(name, '\\.[^.]*$', '')) AS stem FROM frames) SELECT DISTINCT a.dataset, a.stem FROM stems a WHERE tree = 'rgb' AND EXISTS (SELECT 1 FROM stems s WHERE s.dataset = a.dataset AND s.stem = a.stem AND s.tree = 'depth') AND EXISTS (SELECT 1 FROM f WHERE f.dataset = a.dataset AND f.stem = a.stem)")
def j03(spark, d):
    s = stems(spark, d)
    f = frames(spark, d).select("dataset", frame_stem("name").alias("stem"))
    return s.filter("tree = 'rgb'").join(s.filter("tree = 'depth'"), ["dataset", "stem"], "left_semi").join(f, ["dataset", "stem"], "left_semi").select("dataset", "stem").distinct()


@query("j05_lookup_default", f"WITH {SAMPLES}, k AS (SELECT vertex, min(value) AS zmin FROM samples WHERE view % 3 = 0 GROUP BY vertex), s AS (SELECT vertex, view, min(value) AS value FROM samples GROUP BY 1, 2) SELECT s.vertex, s.view, {sr('coalesce(k.zmin, s.value)', 'z', 3)} FROM s LEFT JOIN k ON s.vertex = k.vertex")
def j05(spark, d):
    s = samples(spark, d)
    seen = s.filter("view % 3 = 0").groupBy("vertex").agg(F.min("value").alias("zmin"))
    own = s.groupBy("vertex", "view").agg(F.min("value").alias("value"))
    return own.join(seen, "vertex", "left").select("vertex", "view", r6(F.coalesce("zmin", "value"), "z", 3))


@query("j06_new_voxels", f"WITH {CLOUD}, k AS (SELECT seq, dataset, floor(x/0.9) AS a, floor(y/0.9) AS b, floor(z/0.9) AS c FROM cloud) SELECT dataset, CAST(count(*) AS BIGINT) AS fresh FROM (SELECT DISTINCT dataset, a, b, c FROM k WHERE seq % 2 = 1 EXCEPT SELECT DISTINCT dataset, a, b, c FROM k WHERE seq % 2 = 0) GROUP BY dataset")
def j06(spark, d):
    """Voxels of a second batch (odd seq) that the first batch has not seen."""
    c = cloud(spark, d).select("dataset", g.voxel_key(g.vec(""), 0.9).alias("key"), (F.col("seq") % 2).alias("batch"))
    fresh = c.filter("batch = 1").join(c.filter("batch = 0"), ["dataset", "key"], "left_anti").select("dataset", "key").distinct()
    return fresh.groupBy("dataset").agg(F.count("*").alias("fresh"))


_D = "qw*nw + qx*nx + qy*ny + qz*nz"
BRACKET = f"""WITH {FRAMES}, a AS (SELECT dataset, name, epoch_us(ts) AS t, px, py, pz, qw, qx, qy, qz FROM frames WHERE cam = 'A'), b AS (SELECT dataset, name AS key, epoch_us(ts) AS t FROM frames WHERE cam = 'B'),
g AS (SELECT dataset, t - lag(t) OVER (PARTITION BY dataset ORDER BY t) AS gap FROM a), m AS (SELECT dataset, greatest(600000, 4 * coalesce(median(gap), 0)) AS most FROM g GROUP BY dataset),
p AS (SELECT b.dataset, b.key, b.t, a.t AS pt, a.px, a.py, a.pz, a.qw, a.qx, a.qy, a.qz FROM b ASOF JOIN a ON b.dataset = a.dataset AND b.t > a.t),
n AS (SELECT b.key, a.t AS nt, a.px AS ox, a.py AS oy, a.pz AS oz, a.qw AS nw, a.qx AS nx, a.qy AS ny, a.qz AS nz FROM b ASOF JOIN a ON b.dataset = a.dataset AND b.t <= a.t),
h AS (SELECT *, (p.t - pt)/(nt - pt)::DOUBLE AS f, CASE WHEN {_D} < 0 THEN -1 ELSE 1 END AS sg, least(abs({_D}), 1.0) AS dd FROM p JOIN n ON p.key = n.key JOIN m ON p.dataset = m.dataset WHERE nt - pt <= most),
w AS (SELECT *, CASE WHEN dd > 0.9995 THEN 1 - f ELSE sin((1 - f)*acos(dd))/sin(acos(dd)) END AS wa, CASE WHEN dd > 0.9995 THEN f ELSE sin(f*acos(dd))/sin(acos(dd)) END AS wb FROM h),
v AS (SELECT *, wa*qw + wb*sg*nw AS rw, wa*qx + wb*sg*nx AS rx, wa*qy + wb*sg*ny AS ry, wa*qz + wb*sg*nz AS rz FROM w)
SELECT key, {sr('px + (ox - px)*f', 'px', 4)}, {sr('py + (oy - py)*f', 'py', 4)}, {sr('pz + (oz - pz)*f', 'pz', 4)}, """ + ", ".join(sr(f"r{c}/sqrt(rw*rw + rx*rx + ry*ry + rz*rz)", f"q{c}", 4) for c in "wxyz") + " FROM v"


@query("j07_asof_interpolated", BRACKET)
def j07(spark, d):
    """Pose of camera A at the moments of camera B: between its two neighbours in time, if these are at most 0.6 s or four
    usual gaps apart; the place goes straight, the rotation along the sphere (also J08, W14)."""
    f = frames(spark, d).withColumn("t", F.unix_micros("ts"))
    pose = ["px", "py", "pz", "qw", "qx", "qy", "qz"]
    a, b = f.filter("cam = 'A'").select("dataset", "t", *pose), f.filter("cam = 'B'").select("dataset", F.col("name").alias("key"), "t")
    gap = F.col("t") - F.lag("t").over(W.partitionBy("dataset").orderBy("t"))
    most = a.withColumn("gap", gap).groupBy("dataset").agg(F.greatest(F.lit(600_000.0), 4 * F.coalesce(F.median("gap"), F.lit(0.0))).alias("most"))
    hit = temporal.bracket_join(b, a, ["dataset"], pose, 600_000_000).join(most, "dataset").filter("next_t - prev_t <= most")
    share = (F.col("t") - F.col("prev_t")) / (F.col("next_t") - F.col("prev_t"))
    turned = g.slerp(g.vec("prev_q", "wxyz"), g.vec("next_q", "wxyz"), F.col("share"))
    at = [r6(temporal.lerp(F.col("prev_" + c), F.col("next_" + c), F.col("share")), c, 4) for c in pose[:3]]
    return hit.withColumn("share", share).select("key", *at, *[r6(c, f"q{n}", 4) for c, n in zip(turned, "wxyz")])


CHUNKS = f"""WITH {FRAMES}, n AS (SELECT dataset, cam, name, ts, row_number() OVER (PARTITION BY dataset, cam ORDER BY ts, name) - 1 AS i, count(*) OVER (PARTITION BY dataset, cam) AS n FROM frames),
l AS (SELECT *, greatest(ceil((n - 24)/18.0), 0) AS last FROM n),
c AS (SELECT dataset, cam, name, ts, unnest(range(CAST(least(greatest(ceil((i - 23)/18.0), 0), last) AS BIGINT), CAST(least(floor(i/18.0), last) AS BIGINT) + 1)) AS chunk FROM l)"""


@query("j09_chunk_overlap", CHUNKS + " SELECT a.dataset, a.cam, a.chunk, count(*) AS shared FROM c a JOIN c b ON a.dataset = b.dataset AND a.cam = b.cam AND a.name = b.name AND b.chunk = a.chunk + 1 GROUP BY 1, 2, 3")
def j09(spark, d):
    c = temporal.chunk_windows(frames(spark, d), ["dataset", "cam"], ["ts", "name"], 24, 6).select("dataset", "cam", "name", "chunk")
    return c.join(c.withColumn("chunk", F.col("chunk") - 1), ["dataset", "cam", "name", "chunk"]).groupBy("dataset", "cam", F.col("chunk").cast("long").alias("chunk")).agg(F.count("*").alias("shared"))


@query("j10_gap_pairs", f"WITH {FRAMES}, n AS (SELECT dataset, cam, name, row_number() OVER (PARTITION BY dataset, cam ORDER BY ts, name) - 1 AS i FROM frames) SELECT a.name AS name_a, b.name AS name_b, CAST(b.i - a.i AS BIGINT) AS gap FROM n a JOIN n b ON a.dataset = b.dataset AND a.cam = b.cam AND b.i - a.i IN (4, 8) WHERE a.i % 5 = 0")
def j10(spark, d):
    n = temporal.placed(frames(spark, d).select("dataset", "cam", "name", "ts"), ["dataset", "cam"], "ts", ["ts", "name"])
    n = materialize(n.select("dataset", "cam", "name", F.col("pos").cast("long").alias("i")), "places")
    a = n.filter("i % 5 = 0").select("dataset", "cam", F.col("name").alias("name_a"), F.col("i").alias("start"), F.explode(F.array(F.lit(4).cast("long"), F.lit(8).cast("long"))).alias("gap"))
    return a.withColumn("i", F.col("start") + F.col("gap")).join(n.withColumnRenamed("name", "name_b"), ["dataset", "cam", "i"]).select("name_a", "name_b", "gap")


RADIUS = "(a.x - b.x)**2 + (a.y - b.y)**2 + (a.z - b.z)**2"
NEAR_OBJECTS = f"WITH {OBJECTS}, o AS (SELECT id AS seq, coalesce(dataset, '') AS dataset, cx AS x, cy AS y, cz AS z FROM obj WHERE cx IS NOT NULL AND cy IS NOT NULL AND cz IS NOT NULL)"


def _places(spark, d):
    o = objects(spark, d).dropna(subset=["cx", "cy", "cz"])
    return o.select(F.col("id").alias("seq"), F.coalesce("dataset", F.lit("")).alias("dataset"), *[F.col("c" + c).alias(c) for c in "xyz"])


@query("j11_knn_within", NEAR_OBJECTS + f" SELECT a.seq AS id_a, b.seq AS id_b, row_number() OVER (PARTITION BY a.seq ORDER BY {RADIUS}, b.seq) AS rank FROM o a JOIN o b ON a.dataset = b.dataset AND a.seq <> b.seq QUALIFY rank <= 4")
def j11(spark, d):
    """The four nearest other objects of the recording, however far."""
    return neighbours.nearest(_places(spark, d), None, 4, ["dataset"]).select("id_a", "id_b", "rank")


@query("j12_nearest_camera", NEAR_OBJECTS + f", {FRAMES}, f AS (SELECT name, dataset, px AS x, py AS y, pz AS z FROM frames) SELECT a.seq AS id, arg_min(b.name, {RADIUS}) AS name FROM o a JOIN f b ON a.dataset = b.dataset GROUP BY a.seq")
def j12(spark, d):
    """The nearest frame of the object's recording, however far."""
    f = frames(spark, d).select("dataset", F.col("name").alias("seq"), *[F.col("p" + c).alias(c) for c in "xyz"])
    return neighbours.nearest(_places(spark, d), f, 1, ["dataset"]).select(F.col("id_a").alias("id"), F.col("id_b").alias("name"))


@query("j13_radius_join", NEAR_OBJECTS + f" SELECT a.seq AS id_a, b.seq AS id_b, {sr('sqrt(' + RADIUS + ')', 'dist', 4)} FROM o a JOIN o b ON a.dataset = b.dataset AND a.seq <> b.seq AND {RADIUS} <= 64")
def j13(spark, d):
    o = _places(spark, d)
    return spatial.radius_join(o, o, 8.0, ["dataset"]).select("id_a", "id_b", r6(F.col("dist"), "dist", 4))


RATIO = """WITH e AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings),
q AS (SELECT a.vec_id AS a, b.vec_id AS b, list_sum([(a.v[i]-b.v[i])**2 FOR i IN range(1, len(a.v) + 1)]) AS d2 FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS n, lead(d2) OVER (PARTITION BY a ORDER BY d2, b) AS second FROM q) SELECT a, b FROM r WHERE n = 1 AND sqrt(d2) < 0.97 * sqrt(second)"""


@query("j14_descriptor_ratio", RATIO)
def j14(spark, d):
    """Nearest descriptor with the same label, kept if clearly nearer than the second; every twentieth descriptor asks, of all."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    a = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("a"), "label", F.col("v").alias("va"))
    # every asking descriptor meets all others in slots of these, so that a frequent label is many tasks' work
    slots = 32
    a = a.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    pairs = a.join(e.select(F.col("vec_id").alias("b"), "label", "v", F.pmod(F.xxhash64("vec_id"), F.lit(slots)).cast("int").alias("slot")), ["label", "slot"]).filter("a <> b")
    d2 = F.aggregate(F.zip_with("va", "v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    nth = F.row_number().over(W.partitionBy("a").orderBy("d2", "b"))  # the two best of each task go on
    two = pairs.select("a", "b", d2.alias("d2")).withColumn("n", nth).filter("n <= 2").groupBy("a").agg(F.min("d2").alias("first"), F.max("d2").alias("second"), F.count("*").alias("n"), F.min_by("b", "n").alias("b"))
    return two.filter((F.col("n") == 2) & (F.sqrt("first") < 0.97 * F.sqrt("second"))).select("a", "b")


VIEWS = [(k, 10.0 + 20 * k, -30.0 - 5 * k) for k in range(6)]
VIEWS_SQL = "views(view, ex, ez) AS (VALUES " + ", ".join(f"({k}::BIGINT, {x}, {z})" for k, x, z in VIEWS) + ")"


def views(spark):
    return spark.createDataFrame(VIEWS, "view long, ex double, ez double")


@query("j15_points_in_views", f"WITH {CLOUD}, {VIEWS_SQL}, p AS (SELECT seq, view, 1183.5*(x - ex)/(z - ez) + 612 AS sx, 1183.5*(y - 1.5)/(z - ez) + 512 AS sy, z - ez AS z FROM cloud, views WHERE z - ez > 0.3) SELECT view, count(*) AS seen, {sr('min(z)', 'nearest', 4)} FROM p WHERE sx >= 0 AND sx < 1224 AND sy >= 0 AND sy < 1024 GROUP BY view")
def j15(spark, d):
    """Every point in every one of six fixed views: the views are a constant list, so this is a broadcast nested loop."""
    z = F.col("z") - F.col("ez")
    p = cloud(spark, d).crossJoin(F.broadcast(views(spark))).filter(z > 0.3).select("view", z.alias("z"), (K["fx"] * (F.col("x") - F.col("ex")) / z + K["cx"]).alias("sx"), (K["fy"] * (F.col("y") - 1.5) / z + K["cy"]).alias("sy"))
    return p.filter("sx >= 0 and sx < 1224 and sy >= 0 and sy < 1024").groupBy("view").agg(F.count("*").alias("seen"), r6(F.min("z"), "nearest", 4))


@query("j16_sector_candidates", f"WITH {FRAMES}, s AS (SELECT name, dataset, CAST(floor((atan2(px, pz) + pi())/(2*pi())*8) AS INTEGER) % 8 AS sector, round(sqrt(px*px + pz*pz), 6) AS dist FROM frames), r AS (SELECT *, row_number() OVER (PARTITION BY dataset, sector ORDER BY dist, name) AS nth FROM s WHERE dist > 2) SELECT dataset, sector, name FROM r WHERE nth = 1")
def j16(spark, d):
    """Per recording and sector the nearest frame beyond 2 units (also G19's selection)."""
    s = frames(spark, d).select("name", "dataset", g.sector(g.bearing(F.col("px"), F.col("pz")), 8).alias("sector"), F.round(F.hypot("px", "pz"), 6).alias("dist")).filter("dist > 2")
    return s.groupBy("dataset", "sector").agg(F.min(F.struct("dist", "name")).alias("m")).select("dataset", "sector", F.col("m.name").alias("name"))


@query("j17_nearest_pixel", f"WITH {DEPTH}, {CLOUD}, {UPRIGHT}, p AS (SELECT seq, CAST(least(floor(uy*64/1224), 63) AS BIGINT) AS u, CAST(least(floor((1023-ux)*48/1024), 47) AS BIGINT) AS v FROM seen) SELECT p.seq, {sr('d.z', 'z', 3)} FROM p JOIN depth d ON d.frame = 1 AND d.u = p.u AND d.v = p.v")
def j17(spark, d):
    p = _upright(spark, d).filter("inside").select("seq", F.least(F.floor(F.col("sx") * 64 / 1224), F.lit(63)).alias("u"), F.least(F.floor(F.col("sy") * 48 / 1024), F.lit(47)).alias("v"))
    return p.join(depth(spark, d).filter("frame = 1").select("u", "v", "z"), ["u", "v"]).select("seq", r6(F.col("z"), "z", 3))


@query("j18_bilinear", f"WITH {DEPTH}, {CLOUD}, {UPRIGHT}, p AS (SELECT seq, uy*63/1224 AS a, (1023-ux)*47/1024 AS b FROM seen), t AS (SELECT seq, a - floor(a) AS fa, b - floor(b) AS fb, CAST(floor(a) AS BIGINT) AS u, CAST(floor(b) AS BIGINT) AS v FROM p), k AS (SELECT seq, u + i AS u, v + j AS v, (CASE WHEN i = 1 THEN fa ELSE 1 - fa END)*(CASE WHEN j = 1 THEN fb ELSE 1 - fb END) AS w FROM t, (VALUES (0,0),(0,1),(1,0),(1,1)) AS o(i, j)) SELECT seq, {sr('sum(w*z)/sum(w)', 'z', 4)} FROM k JOIN depth d ON d.frame = 1 AND d.u = k.u AND d.v = k.v GROUP BY seq HAVING sum(w) > 0.01")
def j18(spark, d):
    p = _upright(spark, d).filter("inside").select("seq", (F.col("sx") * 63 / 1224).alias("a"), (F.col("sy") * 47 / 1024).alias("b"))
    wa, wb = F.col("a") - F.floor("a"), F.col("b") - F.floor("b")
    taps = F.array(*[F.struct((F.floor("a") + i).alias("u"), (F.floor("b") + j).alias("v"), ((wa if i else 1 - wa) * (wb if j else 1 - wb)).alias("w")) for i in (0, 1) for j in (0, 1)])
    k = p.select("seq", F.explode(taps).alias("k")).select("seq", "k.*").join(depth(spark, d).filter("frame = 1").select("u", "v", "z"), ["u", "v"])
    return k.groupBy("seq").agg(F.sum(F.col("w") * F.col("z")).alias("s"), F.sum("w").alias("w")).filter("w > 0.01").select("seq", r6(F.col("s") / F.col("w"), "z", 4))


@query("j19_objects_jobs", f"WITH {OBJECTS}, {JOBS} SELECT j.id AS job_id, o.id AS object_id, o.kind FROM job j JOIN obj o ON j.object_id = o.id")
def j19(spark, d):
    j = jobs(spark, d).select(F.col("id").alias("job_id"), "object_id")
    return j.join(objects(spark, d).select(F.col("id").alias("object_id"), "kind"), "object_id").select("job_id", "object_id", "kind")


@query("j20_label_lookup", f"WITH {OBJECTS}, {JOBS} SELECT j.id, coalesce(o.label, '?') AS label FROM job j LEFT JOIN obj o ON j.object_id = o.id")
def j20(spark, d):
    o = objects(spark, d).select(F.col("id").alias("object_id"), "label")
    return jobs(spark, d).join(o, "object_id", "left").select("id", F.coalesce("label", F.lit("?")).alias("label"))


@query("j23_substring_lookup", f"WITH {OBJECTS}, lut(pos, word, class) AS (VALUES (0, 'bar', 'block'), (1, 'car', 'vehicle'), (2, 'pl', 'plant'), (3, 'o', 'other')), m AS (SELECT o.id, arg_min(l.class, l.pos) AS class FROM obj o JOIN lut l ON contains(lower(o.label), l.word) GROUP BY o.id) SELECT id, class FROM m")
def j23(spark, d):
    """First entry of a constant list that a label contains; four entries, broadcast."""
    lut = spark.createDataFrame([(0, "bar", "block"), (1, "car", "vehicle"), (2, "pl", "plant"), (3, "o", "other")], "pos int, word string, class string")
    hit = objects(spark, d).select("id", F.lower("label").alias("label")).join(F.broadcast(lut), F.col("label").contains(F.col("word")))
    return hit.groupBy("id").agg(F.min_by("class", "pos").alias("class"))


# ---- aggregates (A)
@query("a01_voxel_first", f"WITH {CLOUD} SELECT dataset, min(seq) AS seq FROM cloud GROUP BY dataset, floor(x/0.37), floor(y/0.37), floor(z/0.37)")
def a01(spark, d):
    return spatial.first_per_voxel(cloud(spark, d), 0.37, ["dataset"]).select("dataset", "seq")


@query("a02_voxel_min", f"WITH {CLOUD} SELECT dataset, ((CAST(floor(x/0.9) AS BIGINT) + 1048576) << 42) | ((CAST(floor(y/0.9) AS BIGINT) + 1048576) << 21) | (CAST(floor(z/0.9) AS BIGINT) + 1048576) AS key, {sr('min(sqrt(x*x + z*z))', 'zmin', 4)}, count(*) AS n FROM cloud GROUP BY 1, 2")
def a02(spark, d):
    return spatial.nearest_per_voxel(cloud(spark, d).withColumn("depth", F.hypot("x", "z")), 0.9, "depth", ["dataset"]).select("dataset", "key", r6(F.col("zmin"), "zmin", 4), "n")


@query("a03_near_view", f"WITH {CLOUD}, k AS (SELECT seq, sqrt(x*x + z*z) AS depth, min(sqrt(x*x + z*z)) OVER (PARTITION BY dataset, floor(x/4.3), floor(y/4.3), floor(z/4.3)) AS zmin FROM cloud) SELECT seq FROM k WHERE depth <= greatest(1.05*zmin, zmin + 0.15)")
def a03(spark, d):
    return spatial.near_views(cloud(spark, d).withColumn("depth", F.hypot("x", "z")), 4.3, "depth", ["dataset"], 1.05).select("seq")


@query("a04_cells", f"WITH {CLOUD}, c AS (SELECT dataset, ((CAST(floor(x/5.1) AS BIGINT) + 1048576) << 42) | ((CAST(floor(y/5.1) AS BIGINT) + 1048576) << 21) | (CAST(floor(z/5.1) AS BIGINT) + 1048576) AS cell, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz, count(*) AS n FROM cloud GROUP BY 1, 2) SELECT dataset, cell, {sr('(lx + hx)/2', 'cx', 4)}, {sr('sqrt((hx-lx)**2 + (hy-ly)**2 + (hz-lz)**2)/2', 'radius', 4)}, n, CAST(coalesce(sum(n) OVER (PARTITION BY dataset ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM c")
def a04(spark, d):
    return spatial.cells(cloud(spark, d), 5.1, ["dataset"]).select("dataset", "cell", r6(F.col("cx"), "cx", 4), r6(F.col("radius"), "radius", 4), "n", "start")


@query("a05_bounds", f"WITH {CLOUD} SELECT dataset, " + ", ".join(f"{sr(f + '(' + a + ')', n + a, 4)}" for a in "xyz" for n, f in (("lo", "min"), ("hi", "max"))) + ", count(*) AS n FROM cloud GROUP BY dataset")
def a05(spark, d):
    b = spatial.bounds(cloud(spark, d), ["dataset"])
    return b.select("dataset", *[r6(F.col(n + a), n + a, 4) for a in "xyz" for n in ("lo", "hi")], "n")


@query("a06_outlier_trim", f"WITH {CLOUD}, m AS (SELECT dataset, median(x) AS mx, median(y) AS my, median(z) AS mz FROM cloud GROUP BY dataset), r AS (SELECT seq, c.dataset, sqrt((x-mx)**2 + (y-my)**2 + (z-mz)**2) AS r FROM cloud c JOIN m ON c.dataset = m.dataset), l AS (SELECT dataset, quantile_cont(r, 0.92) AS lim FROM r GROUP BY dataset) SELECT seq FROM r JOIN l ON r.dataset = l.dataset WHERE r < lim + 1e-6")
def a06(spark, d):
    return spatial.trim_outliers(cloud(spark, d), 0.92, ["dataset"], 1e-6).select("seq")


@query("a07_z_buffer", f"WITH {DEPTH}, o AS (SELECT frame, u // 2 AS gx, v // 2 AS gy, min(z) AS z FROM depth GROUP BY 1, 2, 3) SELECT a.frame, a.gx, a.gy, {sr('min(b.z)', 'zmin', 4)} FROM o a JOIN o b ON a.frame = b.frame AND abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 GROUP BY 1, 2, 3")
def a07(spark, d):
    return spatial.z_buffer(depth(spark, d), ["frame"], "u", "v", "z").select("frame", "gx", "gy", r6(F.col("zmin"), "zmin", 4))


@query("a08_median_views", f"WITH {SAMPLES} SELECT vertex, {sr('median(value)', 'mid', 3)}, count(DISTINCT view) AS n_views FROM samples GROUP BY vertex")
def a08(spark, d):
    return samples(spark, d).groupBy("vertex").agg(r6(F.median("value"), "mid", 3), F.count_distinct("view").alias("n_views"))


BAND = f"WITH {CLOUD}, {UPRIGHT}, h AS (SELECT * FROM seen WHERE {poly_sql('ux', 'uy', ROI)}), q AS (SELECT quantile_cont(z, 0.15) AS zlo FROM h), i AS (SELECT h.*, z BETWEEN zlo - 0.2 AND zlo + 0.6 AS hit FROM h, q), n AS (SELECT count(*) FILTER (hit) AS k FROM i), b AS (SELECT i.* FROM i, n WHERE hit OR k < 12)"


@query("a09_depth_band", BAND + " SELECT seq FROM b")
def a09(spark, d):
    hits = _upright(spark, d).filter("inside").filter(g.in_polygon(F.col("ux"), F.col("uy"), ROI))
    return spatial.depth_band(hits, "z", []).select("seq")


TRIM = BAND + ", m AS (SELECT median(x) AS mx, median(y) AS my, median(wz) AS mz FROM b), r AS (SELECT b.*, sqrt((x-mx)**2 + (y-my)**2 + (wz-mz)**2) AS r FROM b, m), l AS (SELECT quantile_cont(r, 0.92) AS lim FROM r), t AS (SELECT r.* FROM r, l WHERE r < lim + 1e-6)"


def roi_points(spark, d):
    """Points of the cloud under the region of interest, nearest depth cluster, trimmed (the flagship's points)."""
    hits = _upright(spark, d).filter("inside").filter(g.in_polygon(F.col("ux"), F.col("uy"), ROI))
    band = spatial.depth_band(hits, "z", []).select("seq", F.col("wx").alias("x"), F.col("wy").alias("y"), F.col("wz").alias("z"))
    return spatial.trim_outliers(band, 0.92, [], 1e-6)


@query("g03_roi_points", TRIM + " SELECT seq FROM t")
def g03(spark, d):
    return roi_points(spark, d).select("seq")


@query("a11_axis_box", TRIM + " SELECT " + ", ".join(sr(f"(min({a}) + max({a}))/2", f"c{n}", 4) + ", " + sr(f"greatest(max({a}) - min({a}), 0.001)", f"s{n}", 4) for n, a in (("x", "x"), ("y", "y"), ("z", "wz"))) + ", count(*) AS npts FROM t")
def a11(spark, d):
    """Flagship: region of interest -> points -> nearest depth cluster -> trimmed -> axis-aligned box."""
    box = [c for a in "xyz" for c in (r6((F.min(a) + F.max(a)) / 2, f"c{a}", 4), r6(F.greatest(F.max(a) - F.min(a), F.lit(1e-3)), f"s{a}", 4))]
    return roi_points(spark, d).agg(*box, F.count("*").alias("npts"))


@query("a10_roi_union", f"WITH {OBJECTS}, o AS (SELECT coalesce(dataset, '') AS dataset, label, cx AS x, cy AS y, cz AS z FROM obj WHERE cx IS NOT NULL AND cy IS NOT NULL AND cz IS NOT NULL AND label <> ''), m AS (SELECT dataset, label, median(x) AS mx, median(y) AS my, median(z) AS mz FROM o GROUP BY 1, 2), r AS (SELECT o.*, sqrt((x - mx)**2 + (y - my)**2 + (z - mz)**2) AS r FROM o JOIN m USING (dataset, label)), l AS (SELECT dataset, label, quantile_cont(r, 0.92) AS lim FROM r GROUP BY 1, 2) SELECT dataset, label, " + ", ".join(sr(f"(min({c}) + max({c}))/2", f"c{c}", 5) + ", " + sr(f"greatest(max({c}) - min({c}), 0.001)", f"s{c}", 5) for c in "xyz") + ", count(*) AS n FROM r JOIN l USING (dataset, label) WHERE r < lim + 1e-6 GROUP BY 1, 2 HAVING count(*) > 1")
def a10(spark, d):
    """Observations of one label in one recording, concatenated, trimmed and fitted together with an axis box."""
    o = objects(spark, d).dropna(subset=["cx", "cy", "cz"]).filter("label <> ''").select(F.coalesce("dataset", F.lit("")).alias("dataset"), "label", *[F.col("c" + c).alias(c) for c in "xyz"])
    kept = spatial.trim_outliers(o, 0.92, ["dataset", "label"], 1e-6)
    box = [x for c in "xyz" for x in (r6((F.min(c) + F.max(c)) / 2, f"c{c}", 5), r6(F.greatest(F.max(c) - F.min(c), F.lit(1e-3)), f"s{c}", 5))]
    return kept.groupBy("dataset", "label").agg(*box, F.count("*").alias("n")).filter("n > 1")


@query("a13_moments", f"WITH {CLOUD} SELECT dataset, {sr('covar_pop(x, y)', 'xy', 4)}, {sr('covar_pop(y, z)', 'yz', 4)}, {sr('var_pop(x)', 'xx', 4)} FROM cloud GROUP BY dataset")
def a13(spark, d):
    return cloud(spark, d).groupBy("dataset").agg(r6(F.covar_pop("x", "y"), "xy", 4), r6(F.covar_pop("y", "z"), "yz", 4), r6(F.var_pop("x"), "xx", 4))


@query("a14_weighted_match", f"WITH {CLOUD}, w AS (SELECT dataset, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b, 1/(1 + abs(y)) AS w FROM cloud WHERE r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL), m AS (SELECT dataset, " + ", ".join(f"sum(w*{c})/sum(w) AS m{c}, sum(w*{c}*{c})/sum(w) AS q{c}" for c in "rgb") + " FROM w GROUP BY dataset) SELECT dataset, " + ", ".join(sr(f"m{c}", f"mu_{c}", 3) + ", " + sr(f"least(greatest(40/sqrt(greatest(q{c} - m{c}*m{c}, 1e-9)), 0.5), 2)", f"gain_{c}", 3) for c in "rgb") + " FROM m")
def a14(spark, d):
    """Weighted mean of each colour and the gain, within 0.5..2, that brings its spread to 40."""
    w = cloud(spark, d).dropna(subset=["r", "g", "b"]).select("dataset", *[F.col(c).cast("double").alias(c) for c in "rgb"], (1 / (1 + F.abs("y"))).alias("w"))
    m = w.groupBy("dataset").agg(*[x for c in "rgb" for x in ((F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias("m" + c), (F.sum(F.col("w") * F.col(c) * F.col(c)) / F.sum("w")).alias("q" + c))])
    gain = lambda c: F.expr(f"least(greatest(40/sqrt(greatest(q{c} - m{c}*m{c}, 1e-9D)), 0.5D), 2D)")
    return m.select("dataset", *[x for c in "rgb" for x in (r6(F.col("m" + c), f"mu_{c}", 3), r6(gain(c), f"gain_{c}", 3))])


@query("a15_slice_histogram", f"WITH {CLOUD}, b AS (SELECT dataset, min(x) AS lo, max(x) AS hi FROM cloud GROUP BY dataset), s AS (SELECT c.dataset, least(CAST(floor((x - lo)/(hi - lo)*96) AS BIGINT), 95) AS bin, y FROM cloud c JOIN b ON c.dataset = b.dataset WHERE hi > lo) SELECT dataset, bin, {sr('median(y)', 'mid', 4)} FROM s GROUP BY 1, 2 HAVING count(*) >= 5")
def a15(spark, d):
    c = cloud(spark, d)
    b = c.groupBy("dataset").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).filter("hi > lo")
    s = c.join(b, "dataset").select("dataset", F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 96), F.lit(95)).alias("bin"), "y")
    return s.groupBy("dataset", "bin").agg(F.median("y").alias("m"), F.count("*").alias("n")).filter("n >= 5").select("dataset", "bin", r6(F.col("m"), "mid", 4))


@query("a16_seam_ratio", f"WITH {SAMPLES}, s AS (SELECT vertex, view, avg(value) AS v FROM samples GROUP BY 1, 2), p AS (SELECT a.view AS view, median(ln(b.v/a.v)) AS m, count(*) AS n FROM s a JOIN s b ON a.vertex = b.vertex AND b.view = a.view + 1 GROUP BY 1) SELECT {sr('median(m)', 'ratio', 5)}, count(*) AS seams FROM p WHERE n >= 5")
def a16(spark, d):
    s = samples(spark, d).groupBy("vertex", "view").agg(F.avg("value").alias("v"))
    nxt = s.select("vertex", (F.col("view") - 1).alias("view"), F.col("v").alias("w"))
    p = s.join(nxt, ["vertex", "view"]).groupBy("view").agg(F.median(F.log(F.col("w") / F.col("v"))).alias("m"), F.count("*").alias("n")).filter("n >= 5")
    return p.agg(r6(F.median("m"), "ratio", 5), F.count("*").alias("seams"))


@query("a17_chunk_scale", f"SELECT dataset, cam, run_no, {sr('ln(median(centre_gap_med))', 'scale', 5)} FROM (SELECT DISTINCT * FROM poses_report) WHERE centre_gap_med > 0 AND centre_gap_med < 1e4 GROUP BY 1, 2, 3 HAVING count(*) >= 4")
def a17(spark, d):
    t = table(spark, d, "poses_report").distinct().filter("centre_gap_med > 0 and centre_gap_med < 1e4")
    return t.groupBy("dataset", "cam", "run_no").agg(F.median("centre_gap_med").alias("m"), F.count("*").alias("n")).filter("n >= 4").select("dataset", "cam", "run_no", r6(F.log("m"), "scale", 5))


NORMAL_EQ = f"{FRAMES}, n AS (SELECT dataset, cam, px AS v, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY dataset, cam) AS u FROM frames), t AS (SELECT dataset, cam, u/1e6 AS u, v FROM n)"


@query("a18_normal_equations", f"WITH {NORMAL_EQ}, e AS (SELECT dataset, cam, count(*) AS n, sum(u) AS su, sum(u*u) AS suu, sum(v) AS sv, sum(u*v) AS suv FROM t GROUP BY 1, 2) SELECT dataset, cam, {sr('(n*suv - su*sv)/(n*suu - su*su)', 'slope', 3)} FROM e WHERE n >= 10 AND n*suu - su*su > 1")
def a18(spark, d):
    """Two unknowns a track: sums are assembled by aggregation and the 2 x 2 system is solved in place."""
    u = (F.unix_micros("ts") - F.min(F.unix_micros("ts")).over(W.partitionBy("dataset", "cam"))) / 1e6
    t = frames(spark, d).select("dataset", "cam", u.alias("u"), F.col("px").alias("v"))
    e = t.groupBy("dataset", "cam").agg(F.count("*").alias("n"), F.sum("u").alias("su"), F.sum(F.col("u") ** 2).alias("suu"), F.sum("v").alias("sv"), F.sum(F.col("u") * F.col("v")).alias("suv"))
    return e.filter("n >= 10 and n*suu - su*su > 1").select("dataset", "cam", r6(F.expr("(n*suv - su*sv)/(n*suu - su*su)"), "slope", 3))


@query("a24_residuals", f"SELECT dataset, cam, {sr('median(rot_spread_deg)', 'mid', 4)}, {sr('quantile_cont(rot_spread_deg, 0.9)', 'p90', 4)} FROM (SELECT DISTINCT * FROM poses_report) GROUP BY 1, 2")
def a24(spark, d):
    t = materialize(table(spark, d, "poses_report").distinct().select("dataset", "cam", "rot_spread_deg"), "residuals")
    q = spatial.quantiles(t, ["dataset", "cam"], {"mid": ("rot_spread_deg", 0.5), "p90": ("rot_spread_deg", 0.9)})
    return t.select("dataset", "cam").distinct().join(q, ["dataset", "cam"], "left").select("dataset", "cam", r6(F.col("mid"), "mid", 4), r6(F.col("p90"), "p90", 4))


@query("a25_path_length", f"WITH {FRAMES}, s AS (SELECT dataset, cam, sqrt((px - lag(px) OVER w)**2 + (py - lag(py) OVER w)**2 + (pz - lag(pz) OVER w)**2) AS step FROM frames WINDOW w AS (PARTITION BY dataset, cam ORDER BY ts, name)) SELECT dataset, cam, {sr('sum(step)', 'length', 3)} FROM s GROUP BY 1, 2 HAVING sum(step) IS NOT NULL")
def a25(spark, d):
    f = temporal.beside(frames(spark, d), ["dataset", "cam"], "ts", ["ts", "name"], {"b" + c: (c, -1) for c in ("px", "py", "pz")})
    step = F.sqrt(sum(((F.col(c) - F.col("b" + c)) ** 2 for c in ("px", "py", "pz")), F.lit(0.0)))
    return f.select("dataset", "cam", step.alias("step")).groupBy("dataset", "cam").agg(F.sum("step").alias("s")).filter("s is not null").select("dataset", "cam", r6(F.col("s"), "length", 3))


@query("a26_counts", f"WITH {JOBS} SELECT kind, status, count(*) AS n FROM job GROUP BY 1, 2")
def a26(spark, d):
    return jobs(spark, d).groupBy("kind", "status").agg(F.count("*").alias("n"))


@query("a27_frames_per_camera", f"WITH {FRAMES} SELECT dataset, cam, count(*) AS n, min(name) AS first, max(name) AS last FROM frames GROUP BY 1, 2")
def a27(spark, d):
    return frames(spark, d).groupBy("dataset", "cam").agg(F.count("*").alias("n"), F.min("name").alias("first"), F.max("name").alias("last"))


@query("a28_reference_camera", f"WITH {FRAMES}, c AS (SELECT dataset, cam, count(*) AS n FROM frames GROUP BY 1, 2) SELECT dataset, cam FROM c QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY n DESC, cam) = 1")
def a28(spark, d):
    c = frames(spark, d).groupBy("dataset", "cam").count()
    return c.groupBy("dataset").agg(F.min_by("cam", F.struct(-F.col("count"), "cam")).alias("cam"))


@query("a29_latest_job", f"WITH {JOBS} SELECT object_id, max(id) AS id FROM job WHERE status = 'done' AND object_id IS NOT NULL GROUP BY object_id")
def a29(spark, d):
    return jobs(spark, d).filter("status = 'done' and object_id is not null").groupBy("object_id").agg(F.max("id").alias("id"))


@query("a34_set_medians", f"WITH {OBJECTS}, o AS (SELECT id, kind, sx/nullif(sy, 0) AS aspect FROM obj), m AS (SELECT kind, median(aspect) AS mid FROM o GROUP BY kind) SELECT id FROM o JOIN m ON o.kind = m.kind WHERE aspect BETWEEN mid/1.8 AND mid*1.8")
def a34(spark, d):
    """Objects whose aspect is near the median of their kind (also F31)."""
    o = objects(spark, d).select("id", "kind", F.try_divide("sx", "sy").alias("aspect"))
    m = o.groupBy("kind").agg(F.median("aspect").alias("mid"))
    return o.join(m, "kind").filter("aspect between mid/1.8 and mid*1.8").select("id")


@query("a35_map_bounds", f"WITH {FRAMES} SELECT dataset, {sr('min(px)', 'x0', 7)}, {sr('max(px)', 'x1', 7)}, {sr('0.5*sqrt((max(px)-min(px))**2 + (max(py)-min(py))**2 + (max(pz)-min(pz))**2)', 'r', 4)} FROM frames GROUP BY dataset")
def a35(spark, d):
    half = 0.5 * F.sqrt(sum(((F.max(c) - F.min(c)) ** 2 for c in ("px", "py", "pz")), F.lit(0.0)))
    return frames(spark, d).groupBy("dataset").agg(r6(F.min("px"), "x0", 7), r6(F.max("px"), "x1", 7), r6(half, "r", 4))


@query("a36_pose_report", f"WITH {FRAMES} SELECT dataset, string_agg(cam || ':' || n, ',' ORDER BY cam) AS report FROM (SELECT dataset, cam, count(*) AS n FROM frames GROUP BY 1, 2) GROUP BY dataset")
def a36(spark, d):
    c = frames(spark, d).groupBy("dataset", "cam").agg(F.count("*").alias("n"))
    return c.groupBy("dataset").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cam", "n"))), lambda x: F.concat_ws(":", x["cam"], x["n"].cast("string"))), ",").alias("report"))


@query("a38_median_deviation", f"WITH {FRAMES}, m AS (SELECT dataset, cam, median(py) AS mid FROM frames GROUP BY 1, 2) SELECT f.dataset, f.cam, {sr('max(mid)', 'height', 7)}, {sr('median(abs(py - mid))', 'mad', 7)} FROM frames f JOIN m ON f.dataset = m.dataset AND f.cam = m.cam GROUP BY 1, 2")
def a38(spark, d):
    by = ["dataset", "cam"]
    f = materialize(frames(spark, d).select(*by, "py"), "heights")
    m = materialize(spatial.quantiles(f, by, {"height": ("py", 0.5)}), "height")  # a row per camera
    off = materialize(f.join(m, by).select(*by, F.abs(F.col("py") - F.col("height")).alias("off")), "deviations")
    return m.join(spatial.quantiles(off, by, {"mad": ("off", 0.5)}), by).select(*by, r6(F.col("height"), "height", 7), r6(F.col("mad"), "mad", 7))


@query("a40_seen_share", f"WITH {CLOUD} SELECT dataset, {sr('avg(CASE WHEN nr IS NOT NULL THEN 1.0 ELSE 0.0 END)', 'seen')} FROM cloud GROUP BY dataset")
def a40(spark, d):
    return cloud(spark, d).groupBy("dataset").agg(r6(F.avg(F.when(F.col("nr").isNotNull(), 1.0).otherwise(0.0)), "seen"))


@query("a39_mean_axis", f"WITH {FRAMES} SELECT dataset, {sr('avg(2*(qx*qy - qw*qz))', 'ux', 5)}, {sr('avg(1 - 2*(qx*qx + qz*qz))', 'uy', 5)} FROM frames GROUP BY dataset")
def a39(spark, d):
    r = g.rotation_of(g.vec("q", "wxyz"))
    return frames(spark, d).groupBy("dataset").agg(r6(F.avg(r[0][1]), "ux", 5), r6(F.avg(r[1][1]), "uy", 5))


# ---- windows (W)
SESS = f"WITH {FRAMES}, g AS (SELECT dataset, cam, name, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY dataset, cam ORDER BY ts, name) AS gap FROM frames), m AS (SELECT dataset, cam, median(gap) AS usual FROM g GROUP BY 1, 2), s AS (SELECT g.dataset, g.cam, g.name, sum(CASE WHEN gap > greatest(1000000, 6*usual) THEN 1 ELSE 0 END) OVER (PARTITION BY g.dataset, g.cam ORDER BY t, g.name) AS session FROM g JOIN m ON g.dataset = m.dataset AND g.cam = m.cam)"


def sessions(spark, d):
    f = frames(spark, d).withColumn("t", F.unix_micros("ts"))
    return temporal.gap_sessions(f, ["dataset", "cam"], "t", 1_000_000, 6.0, ["name"])


@query("w01_gap_sessions", SESS + " SELECT dataset, cam, CAST(session AS BIGINT) AS session, count(*) AS n FROM s GROUP BY 1, 2, 3")
def w01(spark, d):
    return sessions(spark, d).groupBy("dataset", "cam", "session").agg(F.count("*").alias("n"))


MERGED = ", n0 AS (SELECT dataset, cam, CAST(session AS BIGINT) AS session, count(*) AS n FROM s GROUP BY 1, 2, 3), n AS (SELECT *, row_number() OVER (PARTITION BY dataset, cam ORDER BY session) AS k FROM n0), r AS (SELECT dataset, cam, k, session, session AS merged, n AS size FROM n WHERE k = 1 UNION ALL SELECT n.dataset, n.cam, n.k, n.session, CASE WHEN n.n < 6 OR r.size < 6 THEN r.merged ELSE n.session END, CASE WHEN n.n < 6 OR r.size < 6 THEN r.size + n.n ELSE n.n END FROM r JOIN n ON n.dataset = r.dataset AND n.cam = r.cam AND n.k = r.k + 1) SELECT dataset, cam, session, merged FROM r"


@query("w01_merged_sessions", SESS.replace("WITH ", "WITH RECURSIVE ", 1) + MERGED)
def w01m(spark, d):
    return temporal.merge_short(w01(spark, d), ["dataset", "cam"], 6)


@query("w02_holes", SESS + " SELECT dataset, cam, CAST(max(session) AS BIGINT) AS holes FROM s GROUP BY 1, 2")
def w02(spark, d):
    return sessions(spark, d).groupBy("dataset", "cam").agg(F.max("session").alias("holes"))


@query("w03_chunks", CHUNKS + " SELECT dataset, cam, chunk, count(*) AS n FROM c GROUP BY 1, 2, 3")
def w03(spark, d):
    c = temporal.chunk_windows(frames(spark, d), ["dataset", "cam"], ["ts", "name"], 24, 6)
    return c.groupBy("dataset", "cam", F.col("chunk").cast("long").alias("chunk")).agg(F.count("*").alias("n"))


@query("w04_ownership", CHUNKS + ", b AS (SELECT dataset, cam, name, ts, min(chunk) AS a, max(chunk) AS z FROM c GROUP BY 1, 2, 3, 4), r AS (SELECT *, row_number() OVER (PARTITION BY dataset, cam, a, z ORDER BY ts, name) AS nth, count(*) OVER (PARTITION BY dataset, cam, a, z) AS n FROM b) SELECT name, CASE WHEN a = z OR nth <= ceil(n/2.0) THEN a ELSE z END AS chunk FROM r")
def w04(spark, d):
    c = temporal.chunk_windows(frames(spark, d), ["dataset", "cam"], ["ts", "name"], 24, 6)
    return temporal.owned(c, ["dataset", "cam"], "name", ["ts", "name"], 6).select("name", F.col("chunk").cast("long").alias("chunk"))


@query("w05_direction", f"WITH {FRAMES}, s AS (SELECT name, lead(px) OVER w - lag(px) OVER w AS dx, lead(pz) OVER w - lag(pz) OVER w AS dz, epoch_us(lead(ts) OVER w) - epoch_us(lag(ts) OVER w) AS dt FROM frames WINDOW w AS (PARTITION BY dataset, cam ORDER BY ts, name)) SELECT name, {sr('dx/sqrt(dx*dx + dz*dz)', 'ux', 5)}, {sr('dz/sqrt(dx*dx + dz*dz)', 'uz', 5)} FROM s WHERE sqrt(dx*dx + dz*dz) > 0.25 AND dt < 1000000")
def w05(spark, d):
    near = {f"{n}_{c}": (c, o) for c in ("px", "pz", "t") for n, o in (("after", 1), ("before", -1))}
    f = temporal.beside(frames(spark, d).withColumn("t", F.unix_micros("ts")), ["dataset", "cam"], "ts", ["ts", "name"], near)
    diff = lambda c: F.col("after_" + c) - F.col("before_" + c)
    s = f.select("name", diff("px").alias("dx"), diff("pz").alias("dz"), diff("t").alias("dt"))
    n = F.hypot("dx", "dz")
    return s.filter((F.expr("sqrt(dx*dx + dz*dz)") > 0.25) & (F.col("dt") < 1_000_000)).select("name", r6(F.col("dx") / n, "ux", 5), r6(F.col("dz") / n, "uz", 5))


@query("w06_row_gradient", f"WITH {DEPTH} SELECT frame, u, v, {sr('abs(z - lag(z) OVER (PARTITION BY frame, v ORDER BY u))', 'dz', 4)} FROM depth")
def w06(spark, d):
    return depth(spark, d).select("frame", "u", "v", r6(F.abs(F.col("z") - F.lag("z").over(W.partitionBy("frame", "v").orderBy("u"))), "dz", 4))


SMOOTH = ", ".join(f"({k}::BIGINT, exp(-{k * k}/32.0))" for k in range(-12, 13))


@query("w07_smoothing", f"WITH {FRAMES}, n AS (SELECT dataset, cam, name, px, row_number() OVER (PARTITION BY dataset, cam ORDER BY ts, name) AS i FROM frames), k(o, w) AS (VALUES {SMOOTH}) SELECT a.name, {sr('sum(k.w*b.px)/sum(k.w)', 'px', 4)} FROM n a, k, n b WHERE a.dataset = b.dataset AND a.cam = b.cam AND b.i = a.i + k.o GROUP BY a.name")
def w07(spark, d):
    """Gaussian over 25 rows: the window's values are collected once a row, the weights are a constant array."""
    import math

    b = temporal.in_blocks(temporal.placed(frames(spark, d), ["dataset", "cam"], "ts", ["ts", "name"]), 12)
    w = W.partitionBy("dataset", "cam", "block").orderBy("pos")
    n = b.select("name", F.collect_list("px").over(w.rowsBetween(-12, 12)).alias("v"), F.col("pos").alias("i"), "own").filter("own")
    weights = F.slice(F.array(*[F.lit(math.exp(-k * k / 32.0)) for k in range(-12, 13)]), F.greatest(F.lit(13) - F.col("i"), F.lit(1)), F.size("v"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return n.select("name", r6(total(F.zip_with("v", weights, lambda a, b: a * b)) / total(weights), "px", 4))


@query("w08_window_average", f"WITH s AS (SELECT DISTINCT seam_id, dataset, cam, run_no, chunk, shared, rot_spread_deg FROM poses_report) SELECT seam_id, {sr('sum(rot_spread_deg*shared) OVER w/sum(shared) OVER w', 'spread', 7)} FROM s WINDOW w AS (PARTITION BY dataset, cam, run_no ORDER BY chunk, seam_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)")
def w08(spark, d):
    w = W.partitionBy("dataset", "cam", "run_no").orderBy("chunk", "seam_id").rowsBetween(-4, 4)
    s = table(spark, d, "poses_report").select("seam_id", "dataset", "cam", "run_no", "chunk", "shared", "rot_spread_deg").distinct()
    return s.select("seam_id", r6(F.sum(F.col("rot_spread_deg") * F.col("shared")).over(w) / F.sum("shared").over(w), "spread", 7))


@query("w09_runs", "WITH s AS (SELECT DISTINCT seam_id, dataset, cam, run_no, chunk FROM poses_report), c AS (SELECT *, CASE WHEN chunk - lag(chunk) OVER (PARTITION BY dataset, cam, run_no ORDER BY chunk, seam_id) <= 1 THEN 0 ELSE 1 END AS cut FROM s) SELECT seam_id, CAST(sum(cut) OVER (PARTITION BY dataset, cam, run_no ORDER BY chunk, seam_id) AS BIGINT) AS run FROM c")
def w09(spark, d):
    w = W.partitionBy("dataset", "cam", "run_no").orderBy("chunk", "seam_id")
    s = table(spark, d, "poses_report").select("seam_id", "dataset", "cam", "run_no", "chunk").distinct()
    cut = F.when(F.col("chunk") - F.lag("chunk").over(w) <= 1, 0).otherwise(1)
    return s.withColumn("cut", cut).select("seam_id", F.sum("cut").over(w).alias("run"))


@query("w10_sector_rank", f"WITH {FRAMES}, s AS (SELECT name, dataset, CAST(floor((atan2(px, pz) + pi())/(2*pi())*8) AS INTEGER) % 8 AS sector, round(sqrt(px*px + pz*pz), 6) AS dist FROM frames) SELECT name, row_number() OVER (PARTITION BY dataset, sector ORDER BY dist, name) AS nth FROM s")
def w10(spark, d):
    s = frames(spark, d).select("name", "dataset", g.sector(g.bearing(F.col("px"), F.col("pz")), 8).alias("sector"), F.round(F.hypot("px", "pz"), 6).alias("dist"))
    return s.select("name", F.row_number().over(W.partitionBy("dataset", "sector").orderBy("dist", "name")).cast("long").alias("nth"))


@query("w11_prefix_max", f"WITH {DEPTH}, m AS (SELECT frame, u, v, max(z) OVER (PARTITION BY frame, v ORDER BY u) AS a, max(z) OVER (PARTITION BY frame, v ORDER BY u DESC) AS b FROM depth) SELECT frame, u, v, {sr('least(a, b)', 'inner_max', 4)} FROM m")
def w11(spark, d):
    """Maxima from both sides: what an outer ray along a row would have met."""
    row = W.partitionBy("frame", "v")
    side = lambda o: F.max("z").over(row.orderBy(o).rowsBetween(W.unboundedPreceding, 0))
    return depth(spark, d).select("frame", "u", "v", r6(F.least(side(F.col("u")), side(F.col("u").desc())), "inner_max", 4))


@query("w12_rank_in_reference", f"WITH {DEPTH}, r AS (SELECT frame, z, u, v, (rank() OVER (PARTITION BY frame ORDER BY z) - 1)/count(*) OVER (PARTITION BY frame)::DOUBLE AS s FROM depth) SELECT frame, u, v, CAST(floor(s*255) AS BIGINT) AS conf FROM r")
def w12(spark, d):
    r = (F.rank().over(W.partitionBy("frame").orderBy("z")) - 1) / F.count("*").over(W.partitionBy("frame"))
    return depth(spark, d).select("frame", "u", "v", F.floor(r * 255).alias("conf"))


@query("w13_even_picks", f"WITH {FRAMES}, n AS (SELECT name, dataset, row_number() OVER (PARTITION BY dataset ORDER BY ts, name) - 1 AS i, count(*) OVER (PARTITION BY dataset) AS n FROM frames), k AS (SELECT unnest(range(8)) AS j) SELECT DISTINCT n.dataset, n.name FROM n JOIN k ON n.i = CAST(floor(k.j*(n.n - 1)/7.0) AS BIGINT)")
def w13(spark, d):
    f = materialize(frames(spark, d).select("name", "dataset", "ts"), "picks")
    n = temporal.placed(f, ["dataset"], "ts", ["ts", "name"]).join(f.groupBy("dataset").agg(F.count("*").alias("n")), "dataset").withColumnRenamed("pos", "i")
    picks = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.floor(j * (F.col("n") - 1) / 7.0))
    return n.filter(F.array_contains(picks, F.col("i").cast("long"))).select("dataset", "name")


@query("w15_eta", f"WITH {JOBS}, n AS (SELECT kind, count(*) AS total, count(*) FILTER (status = 'done') AS done, max(created) - min(created) AS span FROM job GROUP BY kind) SELECT kind, {sr('span/done*(total - done)', 'eta', 2)} FROM n WHERE done > 0")
def w15(spark, d):
    n = jobs(spark, d).groupBy("kind").agg(F.count("*").alias("total"), F.count(F.when(F.col("status") == "done", 1)).alias("done"), (F.max("created") - F.min("created")).alias("span"))
    return n.filter("done > 0").select("kind", r6(F.expr("span/done*(total - done)"), "eta", 2))


# ---- order, limits, samples (O)
@query("o01_frame_order", f"WITH {FRAMES} SELECT name, row_number() OVER (PARTITION BY dataset ORDER BY ts, name) AS nth FROM frames")
def o01(spark, d):
    return temporal.placed(frames(spark, d), ["dataset"], "ts", ["ts", "name"]).select("name", (F.col("pos") + 1).cast("long").alias("nth"))


@query("o03_latest_jobs", f"WITH {JOBS} SELECT id, kind, status FROM job WHERE coalesce(hidden, 0) = 0 ORDER BY id DESC LIMIT 6")
def o03(spark, d):
    return jobs(spark, d).filter(F.coalesce("hidden", F.lit(0)) == 0).orderBy(F.desc("id")).limit(6).select("id", "kind", "status")


@query("o06_hash_sample", f"WITH {CLOUD} SELECT seq, md5(seq::VARCHAR) AS h FROM cloud ORDER BY h, seq LIMIT 1000")
def o06(spark, d):
    """A fixed sample of a capped size: the points whose hash is smallest, the same in every run."""
    return cloud(spark, d).select("seq", F.md5(F.col("seq").cast("string")).alias("h")).orderBy("h", "seq").limit(1000)


@query("o07_lod_order", f"WITH {CLOUD} SELECT dataset, seq, row_number() OVER (PARTITION BY dataset ORDER BY md5(seq::VARCHAR), seq) - 1 AS lod_rank FROM cloud")
def o07(spark, d):
    """Level-of-detail rank: a hash order within each recording, so that every prefix is a fair sample."""
    from orrery.operators.spikes import numbered

    c = cloud(spark, d).select("dataset", "seq", F.md5(F.col("seq").cast("string")).alias("h")).withColumn("bucket", F.substring("h", 1, 4))
    return numbered(c, ["dataset"], "bucket", ["h", "seq"]).select("dataset", "seq", F.col("pos").alias("lod_rank"))


@query("o08_cell_order", f"WITH {CLOUD}, c AS (SELECT seq, dataset, floor(x/5.1) AS a, floor(y/5.1) AS b, floor(z/5.1) AS c FROM cloud) SELECT seq, row_number() OVER (PARTITION BY dataset ORDER BY a, b, c, seq) - 1 AS pos FROM c")
def o08(spark, d):
    """Place of each point in cell order, from counts per cell: no task sorts a whole recording."""
    from orrery.operators.spikes import numbered

    c = cloud(spark, d).select("dataset", "seq", g.voxel_key(g.vec(""), 5.1).alias("cell"))
    return numbered(c, ["dataset"], "cell", ["seq"]).select("seq", "pos")


@query("o09_depth_buckets", f"WITH {CLOUD}, m AS (SELECT dataset, min(z) AS lo, max(z) AS hi FROM cloud GROUP BY dataset) SELECT seq, CAST(floor((z - lo)*(65535/(hi - lo))) AS BIGINT) AS bucket FROM cloud c JOIN m ON c.dataset = m.dataset WHERE hi > lo")
def o09(spark, d):
    c = cloud(spark, d)
    m = c.groupBy("dataset").agg(F.min("z").alias("lo"), F.max("z").alias("hi")).filter("hi > lo")
    return c.join(m, "dataset").select("seq", F.floor((F.col("z") - F.col("lo")) * (65535 / (F.col("hi") - F.col("lo")))).alias("bucket"))


@query("o10_best_view", f"WITH {FRAMES} SELECT dataset, arg_max(name, 0.6*2*(qx*qz - qw*qy) + 0.8*(1 - 2*(qx*qx + qy*qy))) AS name FROM frames GROUP BY dataset")
def o10(spark, d):
    f = g.rotation_of(g.vec("q", "wxyz"))[2]
    return frames(spark, d).groupBy("dataset").agg(F.max_by("name", 0.6 * f[0] + 0.8 * f[2]).alias("name"))


@query("o12_pick_point", f"WITH {CLOUD}, {UPRIGHT} SELECT arg_min(seq, z) AS seq FROM seen WHERE abs(ux - 500) <= 60 AND abs(uy - 600) <= 60")
def o12(spark, d):
    return _upright(spark, d).filter("inside and abs(ux - 500) <= 60 and abs(uy - 600) <= 60").agg(F.min_by("seq", "z").alias("seq"))


# ---- sets (U)
@query("u01_union_all", f"WITH {CLOUD} SELECT dataset, count(*) AS n FROM (SELECT * FROM cloud UNION ALL SELECT * FROM cloud WHERE r > 200) GROUP BY dataset")
def u01(spark, d):
    c = cloud(spark, d)
    return c.unionByName(c.filter("r > 200")).groupBy("dataset").agg(F.count("*").alias("n"))


@query("u02_key_union", f"WITH {CLOUD} SELECT DISTINCT floor(x/2.3)::BIGINT AS k FROM cloud UNION SELECT DISTINCT floor(z/2.3)::BIGINT FROM cloud")
def u02(spark, d):
    c = cloud(spark, d)
    return c.select(F.floor(F.col("x") / 2.3).alias("k")).union(c.select(F.floor(F.col("z") / 2.3))).distinct()


@query("u04_intersection", f"WITH {STEMS} SELECT dataset, stem FROM stems WHERE tree = 'rgb' INTERSECT SELECT dataset, stem FROM stems WHERE tree = 'rgb_orig'")
def u04(spark, d):
    s = stems(spark, d)
    return s.filter("tree = 'rgb'").select("dataset", "stem").intersect(s.filter("tree = 'rgb_orig'").select("dataset", "stem"))


@query("u05_ordered_distinct", f"WITH {OBJECTS} SELECT frame, min(id) AS first FROM obj WHERE frame IS NOT NULL GROUP BY frame")
def u05(spark, d):
    return objects(spark, d).filter("frame is not null").groupBy("frame").agg(F.min("id").alias("first"))


@query("u06_except", f"WITH {STEMS} SELECT dataset, stem FROM stems WHERE tree = 'rgb' EXCEPT SELECT dataset, stem FROM stems WHERE tree = 'depth'")
def u06(spark, d):
    s = stems(spark, d)
    return s.filter("tree = 'rgb'").select("dataset", "stem").subtract(s.filter("tree = 'depth'").select("dataset", "stem"))


@query("u07_replace_subset", f"WITH {CLOUD} SELECT seq, {sr('y', 'y', 4)} FROM cloud WHERE NOT (abs(x - 40) < 10 AND abs(z) < 10) UNION ALL SELECT seq, {sr('y + 1', 'y', 4)} FROM cloud WHERE abs(x - 40) < 10 AND abs(z) < 10")
def u07(spark, d):
    c = cloud(spark, d)
    inside = (F.abs(F.col("x") - 40) < 10) & (F.abs("z") < 10)
    return c.filter(~inside).unionByName(c.filter(inside).withColumn("y", F.col("y") + 1)).select("seq", r6(F.col("y"), "y", 4))


@query("u08_replace_automatic", f"WITH {OBJECTS} SELECT id, CAST(len(list_filter(from_json(obs, '[{{\"frame\":\"VARCHAR\",\"kind\":\"VARCHAR\",\"auto\":\"BOOLEAN\"}}]'), lambda o: NOT o.auto)) + 1 AS BIGINT) AS n FROM obj WHERE obs IS NOT NULL")
def u08(spark, d):
    """Automatic observations of an object replaced by one new one; those set by hand stay."""
    kept = F.filter(F.from_json("obs", "array<struct<frame:string,kind:string,auto:boolean>>"), lambda o: ~o["auto"])
    new = F.array(F.struct(F.lit("new").alias("frame"), F.lit("rect").alias("kind"), F.lit(True).alias("auto")))
    return objects(spark, d).filter("obs is not null").select("id", F.size(F.concat(kept, new)).cast("long").alias("n"))


# ---- relational statements (Q)
@query("q02_objects_of", f"WITH {OBJECTS} SELECT id, label FROM obj WHERE coalesce(dataset, '') = ''")
def q02(spark, d):
    return objects(spark, d).filter(F.coalesce("dataset", F.lit("")) == "").select("id", "label")


@query("q03_object_counts", f"WITH {OBJECTS} SELECT coalesce(dataset, '') AS dataset, count(*) AS n FROM obj GROUP BY 1")
def q03(spark, d):
    return objects(spark, d).groupBy(F.coalesce("dataset", F.lit("")).alias("dataset")).agg(F.count("*").alias("n"))


@query("q07_last_done_job", f"WITH {JOBS} SELECT object_id, max(id) AS id FROM job WHERE status = 'done' AND kind <> 'map' AND object_id > 0 GROUP BY 1")
def q07(spark, d):
    return jobs(spark, d).filter("status = 'done' and kind <> 'map' and object_id > 0").groupBy("object_id").agg(F.max("id").alias("id"))


@query("q11_latest_state", "SELECT id, arg_max(status, {'r': CASE status WHEN 'done' THEN 3 WHEN 'error' THEN 2 WHEN 'running' THEN 1 ELSE 0 END, 's': status}) AS status FROM jobs GROUP BY id")
def q11(spark, d):
    """Updates as an append log: the furthest status that was delivered is the state (also Q09, Q12)."""
    rank = F.when(F.col("status") == "done", 3).when(F.col("status") == "error", 2).when(F.col("status") == "running", 1).otherwise(0)
    return table(spark, d, "jobs").groupBy("id").agg(F.max_by("status", F.struct(rank.alias("r"), F.col("status").alias("s"))).alias("status"))


@query("q13_delete", f"WITH {OBJECTS} SELECT id FROM obj WHERE deleted IS NULL")
def q13(spark, d):
    return objects(spark, d).filter("deleted is null").select("id")


@query("q16_objects3d", f"WITH {OBJECTS} SELECT id, {sr('0.6*greatest(sx, sy, sz)', 'r', 4)} FROM obj WHERE sx IS NOT NULL")
def q16(spark, d):
    return objects(spark, d).filter("sx is not null").select("id", r6(0.6 * F.greatest("sx", "sy", "sz"), "r", 4))


@query("q17_tracks", f"WITH {FRAMES} SELECT name, CASE WHEN name LIKE 'A\\_%' ESCAPE '\\' THEN 'A' ELSE 'B' END AS track, {sr('px', 'px', 7)}, {sr('pz', 'pz', 7)} FROM frames")
def q17(spark, d):
    return frames(spark, d).select("name", F.when(F.col("name").startswith("A_"), "A").otherwise("B").alias("track"), r6(F.col("px"), "px", 7), r6(F.col("pz"), "pz", 7))


QUERIES, ORACLES = query.queries, query.oracles
