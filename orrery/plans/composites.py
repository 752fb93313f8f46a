"""Composite operators: regions to points, layer baking, solids, rasters, packs; and extras the reference does not have."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.operators import fitting, mesh, raster, spatial, temporal
from orrery.plans.binding import CLOUD, DEPTH, FACES, FRAMES, OBJECTS, VERTICES, cloud, depth, faces, frames, objects, vertices
from orrery.plans.projections import ROI, UPRIGHT, _upright, poly_sql, r6, sr
from orrery.plans.registry import Registry
from orrery.plans.relations import STEMS, VIEWS_SQL, stems, views
from orrery.session import materialize, shared_dir, table
from orrery.sources import packs

query = Registry()


@query("g01_roi_cascade", f"WITH {CLOUD}, {UPRIGHT}, {DEPTH}, h AS (SELECT count(*) AS n FROM seen WHERE {poly_sql('ux', 'uy', ROI)}), k AS (SELECT count(*) AS n FROM depth WHERE frame = 1 AND u BETWEEN 15 AND 42 AND v BETWEEN 6 AND 34 AND z BETWEEN 0.05 AND 45) SELECT CASE WHEN h.n >= 300 THEN 'cloud' WHEN k.n >= 40 THEN 'depth' WHEN h.n >= 12 THEN 'cloud' ELSE 'none' END AS source, h.n AS n_cloud, k.n AS n_depth FROM h, k")
def g01(spark, d):
    """Which source of points a region is solved from: the cloud if it holds many, else the depth picture, else the cloud."""
    hits = _upright(spark, d).filter("inside").filter(g.in_polygon(F.col("ux"), F.col("uy"), ROI)).agg(F.count("*").alias("n_cloud"))
    px = depth(spark, d).filter("frame = 1 and u between 15 and 42 and v between 6 and 34 and z between 0.05 and 45").agg(F.count("*").alias("n_depth"))
    both = hits.crossJoin(px)  # one row each
    return both.select(F.when(F.col("n_cloud") >= 300, "cloud").when(F.col("n_depth") >= 40, "depth").when(F.col("n_cloud") >= 12, "cloud").otherwise("none").alias("source"), "n_cloud", "n_depth")


@query("g02_roi_on_depth", f"WITH {DEPTH}, p AS (SELECT * FROM depth WHERE u BETWEEN 15 AND 42 AND v BETWEEN 6 AND 34 AND z > 0.05), q AS (SELECT frame, quantile_cont(z, 0.15) AS zlo FROM p GROUP BY frame), b AS (SELECT p.*, z BETWEEN zlo - 0.2 AND zlo + 0.6 AS hit FROM p JOIN q ON p.frame = q.frame), n AS (SELECT frame, count(*) FILTER (hit) AS k FROM b GROUP BY frame) SELECT b.frame, b.u, b.v FROM b JOIN n ON b.frame = n.frame WHERE hit OR k < 40")
def g02(spark, d):
    p = depth(spark, d).filter("u between 15 and 42 and v between 6 and 34 and z > 0.05")
    return spatial.depth_band(p, "z", ["frame"], least=40).select("frame", "u", "v")


@query("g04_core_hints", f"WITH {CLOUD}, q AS (SELECT dataset, quantile_cont(y, 0.12) AS ylo, median(x) AS mx, median(z) AS mz FROM cloud GROUP BY dataset), r AS (SELECT c.seq, c.dataset, y > ylo AS high, sqrt((x-mx)**2 + (z-mz)**2) AS r FROM cloud c JOIN q ON c.dataset = q.dataset), l AS (SELECT dataset, quantile_cont(r, 0.7) AS lim FROM r GROUP BY dataset) SELECT seq FROM r JOIN l ON r.dataset = l.dataset WHERE high AND r.r <= lim")
def g04(spark, d):
    """The core of each pack: without its lowest 12 and its outermost 30 percent."""
    c = materialize(cloud(spark, d).select("seq", "dataset", "x", "y", "z"), "core")
    q = spatial.quantiles(c, ["dataset"], {"ylo": ("y", 0.12), "mx": ("x", 0.5), "mz": ("z", 0.5)})
    r = c.join(q, "dataset").select("seq", "dataset", (F.col("y") > F.col("ylo")).alias("high"), F.hypot(F.col("x") - F.col("mx"), F.col("z") - F.col("mz")).alias("r"))
    r = materialize(r, "core-ranged")
    lim = spatial.quantiles(r, ["dataset"], {"lim": ("r", 0.7)})
    return r.join(lim, "dataset").filter("high and r <= lim").select("seq")


@query("g08_shape_class")
def g08(spark, d):
    """Thin or compact, from the spread along the principal axes; the long axis turned to its wider end."""
    c = cloud(spark, d)
    axes = fitting.principal_axes(c, ["dataset"])
    shape = F.when((F.sqrt(F.col("values")[1] / F.col("values")[0]) < 0.07) & (F.col("values")[0] > 4 * F.col("values")[1]), "thin").otherwise("compact")
    middle = c.groupBy("dataset").agg(*[F.avg(a).alias("m" + a) for a in "xyz"])
    along = sum(((F.col(a) - F.col("m" + a)) * F.col("axes")[i] for i, a in enumerate("xyz")), F.lit(0.0))
    across = sum(((F.col(a) - F.col("m" + a)) ** 2 for a in "xyz"), F.lit(0.0))
    ends = c.join(axes, "dataset").join(middle, "dataset").withColumn("t", along).withColumn("w", F.sqrt(F.greatest(across - F.col("t") ** 2, F.lit(0.0))))
    wide = ends.groupBy("dataset").agg(F.avg(F.when(F.col("t") > 0, F.col("w"))).alias("up"), F.avg(F.when(F.col("t") <= 0, F.col("w"))).alias("down"))
    return axes.join(wide, "dataset").select("dataset", shape.alias("shape"), (F.col("up") > 1.15 * F.col("down")).alias("flip"), "n")


BAKE = f"""WITH {CLOUD}, {VIEWS_SQL}, {DEPTH}, p AS (SELECT seq, view, 1183.5*(x - ex)/(z - ez) + 612 AS sx, 1183.5*(y - 1.5)/(z - ez) + 512 AS sy, z - ez AS z FROM cloud, views WHERE z - ez > 0.3),
s AS (SELECT *, CAST(floor(sx/8) AS BIGINT) AS gx, CAST(floor(sy/8) AS BIGINT) AS gy FROM p WHERE sx >= 0 AND sx < 1224 AND sy >= 0 AND sy < 1024),
b AS (SELECT view, gx, gy, min(z) AS z FROM s GROUP BY 1, 2, 3), e AS (SELECT a.view, a.gx, a.gy, min(n.z) AS zmin FROM b a JOIN b n ON a.view = n.view AND abs(a.gx - n.gx) <= 1 AND abs(a.gy - n.gy) <= 1 GROUP BY 1, 2, 3),
v AS (SELECT s.seq, s.view, CAST(least(floor(s.sx*64/1224), 63) AS BIGINT) AS u, CAST(least(floor(s.sy*48/1024), 47) AS BIGINT) AS w FROM s JOIN e ON s.view = e.view AND s.gx = e.gx AND s.gy = e.gy WHERE s.z <= e.zmin*1.04 + 0.001)
SELECT v.seq, {sr('median(d.conf)', 'value', 3)}, count(*) AS n_views FROM v JOIN depth d ON d.frame = v.view + 1 AND d.u = v.u AND d.v = v.w GROUP BY v.seq"""


@query("g10_bake_layers", BAKE)
def g10(spark, d):
    """Each point's value as the views see it: projected into all views (J15), hidden ones dropped by a z-buffer (A07, F24),
    pictures sampled (J17), median across views (A08)."""
    z = F.col("z") - F.col("ez")
    p = cloud(spark, d).crossJoin(F.broadcast(views(spark))).filter(z > 0.3).select("seq", "view", z.alias("z"), (1183.5 * (F.col("x") - F.col("ex")) / z + 612).alias("sx"), (1183.5 * (F.col("y") - 1.5) / z + 512).alias("sy"))
    s = p.filter("sx >= 0 and sx < 1224 and sy >= 0 and sy < 1024").withColumn("gx", F.floor(F.col("sx") / 8)).withColumn("gy", F.floor(F.col("sy") / 8))
    front = spatial.z_buffer(s, ["view"], "sx", "sy", "z", 8)
    seen = s.join(front, ["view", "gx", "gy"]).filter(F.col("z") <= F.col("zmin") * 1.04 + 1e-3)
    at = seen.select("seq", (F.col("view") + 1).alias("frame"), F.least(F.floor(F.col("sx") * 64 / 1224), F.lit(63)).alias("u"), F.least(F.floor(F.col("sy") * 48 / 1024), F.lit(47)).alias("v"))
    return at.join(depth(spark, d).select("frame", "u", "v", "conf"), ["frame", "u", "v"]).groupBy("seq").agg(r6(F.median("conf"), "value", 3), F.count("*").alias("n_views"))


N = 24
SOLID = f"""WITH {CLOUD}, b AS (SELECT dataset, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM cloud GROUP BY dataset HAVING max(x) > min(x) AND max(y) > min(y) AND max(z) > min(z)),
o AS (SELECT DISTINCT c.dataset, least(CAST(floor((x-lx)/(hx-lx)*{N}) AS BIGINT), {N - 1}) AS i, least(CAST(floor((y-ly)/(hy-ly)*{N}) AS BIGINT), {N - 1}) AS j, least(CAST(floor((z-lz)/(hz-lz)*{N}) AS BIGINT), {N - 1}) AS k FROM cloud c JOIN b ON c.dataset = b.dataset),
r AS (SELECT unnest(range({N})) AS t), gr AS (SELECT b.dataset, i.t AS i, j.t AS j, k.t AS k, CASE WHEN o.i IS NULL THEN 0 ELSE 1 END AS occ FROM b CROSS JOIN r i CROSS JOIN r j CROSS JOIN r k LEFT JOIN o ON o.dataset = b.dataset AND o.i = i.t AND o.j = j.t AND o.k = k.t),
m AS (SELECT dataset, """ + " + ".join(f"max(occ) OVER (PARTITION BY dataset, {a}, {b} ORDER BY {c}{way})" for a, b, c in (("j", "k", "i"), ("i", "k", "j"), ("i", "j", "k")) for way in ("", " DESC")) + " AS rays FROM gr) SELECT dataset, CAST(count(*) FILTER (rays >= 5) AS BIGINT) AS solid FROM m GROUP BY dataset"


def solid_cells(spark, d):
    """dataset, i, j, k of voxels that at least five of six axis rays meet occupied ones from, on a grid of 24 cells a side."""
    c = cloud(spark, d)
    b = spatial.bounds(c, ["dataset"]).filter("hix > lox and hiy > loy and hiz > loz")
    cell = lambda a, n: F.least(F.floor((F.col(a) - F.col("lo" + a)) / (F.col("hi" + a) - F.col("lo" + a)) * N), F.lit(N - 1)).alias(n)
    occ = c.join(b, "dataset").select("dataset", *[cell(a, n) for a, n in zip("xyz", "ijk")]).distinct().withColumn("occ", F.lit(1))
    grid = b.select("dataset")
    for n in "ijk":
        grid = grid.withColumn(n, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(N - 1).cast("long"))))
    full = grid.join(occ, ["dataset", "i", "j", "k"], "left").withColumn("occ", F.coalesce("occ", F.lit(0)))
    rays = F.lit(0)
    for axis in "ijk":
        line = W.partitionBy("dataset", *[a for a in "ijk" if a != axis])
        for order in (F.col(axis), F.col(axis).desc()):
            rays = rays + F.max("occ").over(line.orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return full.select("dataset", "i", "j", "k", rays.alias("rays"))


@query("g12_solid_voxels", SOLID)
def g12(spark, d):
    return solid_cells(spark, d).groupBy("dataset").agg(F.count(F.when(F.col("rays") >= 5, 1)).alias("solid"))


SIDES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
SURFACE = SOLID[: SOLID.index(" SELECT dataset, CAST(count(*)")].replace("m AS (SELECT dataset, ", "m AS (SELECT dataset, i, j, k, ") + ", s AS (SELECT dataset, i, j, k FROM m WHERE rays >= 5), side(a, b, c) AS (VALUES " + ", ".join(map(str, SIDES)) + ") SELECT s.dataset, count(*) AS n_sides, true AS closed, true AS smoothed FROM s, side WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.dataset = s.dataset AND t.i = s.i + side.a AND t.j = s.j + side.b AND t.k = s.k + side.c) GROUP BY s.dataset"


@query("g12_surface", SURFACE)
def g12s(spark, d):
    """Surface of the solid voxels: the sides that no other solid voxel covers, as squares, and their corners smoothed without
    shrinking. Closed: every edge has an even number of squares. A group is a grid of fixed size."""
    cells = materialize(solid_cells(spark, d).filter("rays >= 5").select("dataset", "i", "j", "k"), "solid")

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        quads, _ = mesh.surface_squares(pdf[["i", "j", "k"]].to_numpy(int))
        edges, n = np.unique(np.sort(np.concatenate([quads[:, [p, (p + 1) % 4]] for p in range(4)]), axis=1), axis=0, return_counts=True)
        corners = mesh.surface_squares(pdf[["i", "j", "k"]].to_numpy(int))[1].astype(float)
        even = mesh.taubin(corners, edges)
        rough = lambda v: float(((v[edges[:, 0]] - v[edges[:, 1]]) ** 2).sum())
        fine = rough(even) < rough(corners) and bool(np.abs(even - corners).max() < 1.5)
        return pd.DataFrame({"dataset": [pdf["dataset"].iloc[0]], "n_sides": [len(quads)], "closed": [bool((n % 2 == 0).all())], "smoothed": [fine]})

    return cells.groupBy("dataset").applyInPandas(check, "dataset string, n_sides long, closed boolean, smoothed boolean")




@query("g20_lean", f"WITH {DEPTH}, p AS (SELECT frame, u, v FROM depth WHERE z < 4), m AS (SELECT frame, covar_pop(u, v) AS uv, var_pop(u) AS uu, var_pop(v) AS vv, count(*) AS n FROM p GROUP BY frame), a AS (SELECT frame, n, degrees(0.5*atan2(2*uv, uu - vv)) AS lean FROM m WHERE n >= 10) SELECT frame, {sr('lean', 'lean', 3)}, abs(lean) BETWEEN 1.5 AND 45 AS turn FROM a")
def g20(spark, d):
    """Lean of the near pixels of a picture, from their second moments."""
    m = depth(spark, d).filter("z < 4").groupBy("frame").agg(F.covar_pop("u", "v").alias("uv"), F.var_pop("u").alias("uu"), F.var_pop("v").alias("vv"), F.count("*").alias("n")).filter("n >= 10")
    lean = F.degrees(0.5 * F.atan2(2 * F.col("uv"), F.col("uu") - F.col("vv")))
    return m.withColumn("lean", lean).select("frame", r6(F.col("lean"), "lean", 3), F.abs("lean").between(1.5, 45).alias("turn"))


@query("g21_local_asset", f"WITH {CLOUD} SELECT {sr('x', 'x', 3)}, {sr('(r/255.0 - 0.5)/0.28209479177387814', 'dc', 3)} FROM cloud WHERE abs(x - 40) <= 12.5 AND abs(y - 1) <= 3.75 AND abs(z) <= 10 AND r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL")
def g21(spark, d):
    near = [F.abs(F.col(c) - m) <= 1.25 * h for c, m, h in (("x", 40, 10), ("y", 1, 3), ("z", 0, 8))]
    a = packs.gaussians(cloud(spark, d).filter(near[0] & near[1] & near[2]).dropna(subset=["r", "g", "b"]), 0.02)
    return a.select(r6(F.col("x").cast("double"), "x", 3), r6(F.col("f_dc_0").cast("double"), "dc", 3))


@query("f27_not_neighbours", f"WITH {FRAMES}, n AS (SELECT dataset, cam, name, row_number() OVER (PARTITION BY dataset, cam ORDER BY ts, name) - 1 AS i FROM frames) SELECT a.name FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.dataset = a.dataset AND b.cam = a.cam AND abs(a.i - b.i) <= 3 AND b.i % 20 = 0)")
def f27(spark, d):
    """Frames that are no near neighbours of a chosen one (every twentieth is chosen)."""
    n = temporal.placed(frames(spark, d).select("dataset", "cam", "name", "ts"), ["dataset", "cam"], "ts", ["ts", "name"]).withColumnRenamed("pos", "i")
    near = n.filter("i % 20 = 0").select("dataset", "cam", F.explode(F.sequence(F.col("i") - 3, F.col("i") + 3)).alias("i"))
    return n.join(near, ["dataset", "cam", "i"], "left_anti").select("name")


MASKS = "m AS (SELECT id, npts % 29 / 29.0 AS s, npts % 2 = 0 AS geo, npts % 13 / 12.0 AS hit, npts % 100 / 100.0 AS cover, npts % 37 / 37.0 AS outside, npts % 11 / 11.0 AS neg, npts % 6 AS n_neg FROM obj WHERE npts IS NOT NULL)"


@query("f30_mask_score", f"WITH {OBJECTS}, {MASKS} SELECT id, {sr('s + (CASE WHEN geo THEN 2.0 ELSE 0.6 END)*hit - 1.5*outside - (CASE WHEN cover > 0.55 THEN 1.5 ELSE 0 END) - 2.0*neg', 'score', 5)} FROM m WHERE NOT (neg > 0.5 AND n_neg >= 3) AND NOT (cover > 0.7 AND outside > 0.25)")
def f30(spark, d):
    """Score of a candidate mask from what it hits and spills; vetoed if most of at least three negatives are inside, or if
    it nearly fills the box and spills far out of it. The measures stand in for a mask's own."""
    n = F.col("npts")
    m = objects(spark, d).filter("npts is not null").select("id", (n % 29 / 29.0).alias("s"), (n % 2 == 0).alias("geo"), (n % 13 / 12.0).alias("hit"), (n % 100 / 100.0).alias("cover"), (n % 37 / 37.0).alias("outside"), (n % 11 / 11.0).alias("neg"), (n % 6).alias("n_neg"))
    kept = m.filter("not (neg > 0.5 and n_neg >= 3) and not (cover > 0.7 and outside > 0.25)")
    worth = F.col("s") + F.when(F.col("geo"), 2.0).otherwise(0.6) * F.col("hit") - 1.5 * F.col("outside") - F.when(F.col("cover") > 0.55, 1.5).otherwise(0.0) - 2.0 * F.col("neg")
    return kept.select("id", r6(worth, "score", 5))


@query("f32_mask_pixels", f"WITH {DEPTH} SELECT a.frame, a.u, a.v FROM depth a WHERE EXISTS (SELECT 1 FROM depth b WHERE b.frame = 2 AND b.u = a.u AND b.v = a.v AND b.conf > 100)")
def f32(spark, d):
    px = depth(spark, d)
    return px.join(px.filter("frame = 2 and conf > 100").select("u", "v"), ["u", "v"], "left_semi").select("frame", "u", "v")


@query("f34_complete_recordings", f"WITH {STEMS} SELECT dataset FROM stems GROUP BY dataset HAVING count(*) FILTER (tree = 'rgb') > 0 AND count(*) FILTER (tree = 'depth') > 0 AND count(*) FILTER (tree = 'layers') > 0")
def f34(spark, d):
    n = [F.count(F.when(F.col("tree") == t, 1)).alias(t) for t in ("rgb", "depth", "layers")]
    return stems(spark, d).groupBy("dataset").agg(*n).filter("rgb > 0 and depth > 0 and layers > 0").select("dataset")


@query("o13_painters_order", f"WITH {FACES}, {VERTICES}, c AS (SELECT f.fid, round((a.x + b.x + c.x)*0.6 + (a.y + b.y + c.y)*0.8, 6) AS far FROM faces f JOIN vertices a ON f.a = a.v JOIN vertices b ON f.b = b.v JOIN vertices c ON f.c = c.v) SELECT fid, row_number() OVER (ORDER BY far DESC, fid) AS nth FROM c")
def o13(spark, d):
    """Faces from far to near along a direction; the global number comes from counts per range of distance."""
    from orrery.operators.spikes import numbered

    joined, v = faces(spark, d), vertices(spark, d)
    for p in "abc":
        joined = joined.join(v.select(F.col("v").alias(p), F.col("x").alias(p + "x"), F.col("y").alias(p + "y")), p)
    far = F.round(sum((F.col(p + "x") for p in "bc"), F.col("ax")) * 0.6 + sum((F.col(p + "y") for p in "bc"), F.col("ay")) * 0.8, 6)
    c = joined.select(F.lit(0).alias("all"), "fid", (-far).alias("near")).withColumn("bucket", F.floor(F.col("near") / 4))
    return numbered(c, ["all"], "bucket", ["near", "fid"]).select("fid", (F.col("pos") + 1).alias("nth"))


@query("s13_bare_track", f"WITH {CLOUD}, b AS (SELECT dataset, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM cloud GROUP BY dataset), k AS (SELECT unnest(range(40)) AS i) SELECT dataset, CAST(i AS INTEGER) AS i, {sr('(lx + hx)/2 + sqrt((hx-lx)**2 + (hy-ly)**2 + (hz-lz)**2)/3*(i*(0.8/39) - 0.4)', 'x', 4)} FROM b, k")
def s13(spark, d):
    return packs.track_of(spatial.bounds(cloud(spark, d), ["dataset"])).select("dataset", "i", r6(F.col("x"), "x", 4))


@query("s14_mesh_round_trip", f"WITH {FACES} SELECT fid, a, b, c FROM faces")
def s14(spark, d):
    path = shared_dir(spark, "mesh")
    packs.write_mesh(vertices(spark, d), faces(spark, d), path)
    return packs.read_mesh(spark, path)[1]


@query("s17_snapshot_round_trip", f"WITH {DEPTH} SELECT frame, count(*) AS n, {sr('sum(z)', 'z', 4)} FROM depth GROUP BY frame")
def s17(spark, d):
    path = shared_dir(spark, "snapshot")
    rows = depth(spark, d).groupBy("frame").agg(F.collect_list("z").alias("depth")).withColumn("unused", F.lit(None).cast("array<double>"))  # a picture a row
    packs.write_snapshot(rows, path)
    return spark.read.parquet(path).select("frame", F.size("depth").cast("long").alias("n"), r6(F.aggregate("depth", F.lit(0.0), lambda s, x: s + x), "z", 4))


@query("s06_unpack_bytes", "WITH h AS (SELECT file_id, max(hex(payload)) AS h FROM street_video WHERE payload IS NOT NULL GROUP BY file_id), w AS (SELECT file_id, h, [('0x' || substr(h, 6*i + 1, 6))::BIGINT FOR i IN range(0, len(h) // 6)] AS w FROM h) SELECT file_id, CAST(2*len(w) AS BIGINT) AS n_px, CAST(coalesce(list_sum([((x >> 16) << 4) + (x & 15) + ((x >> 4) & 4095) FOR x IN w]), 0) AS BIGINT) AS total, CAST((len(h) // 2) % 3 AS BIGINT) AS rest FROM w")
def s06(spark, d):
    """Payloads as packed 12-bit pixels, without Python: each three bytes are a 24-bit word of two pixels; `rest` is what
    bytes at the end are no whole word."""
    h = table(spark, d, "street_video").filter("payload is not null").groupBy("file_id").agg(F.max(F.hex("payload")).alias("h"))
    words = F.transform(F.sequence(F.lit(0), F.floor(F.length("h") / 6).cast("int")), lambda i: F.conv(F.substring("h", i * 6 + 1, F.lit(6)), 16, 10).cast("long"))
    w = h.select("file_id", "h", F.slice(words, F.lit(1), F.floor(F.length("h") / 6).cast("int")).alias("w"))
    pair = lambda x: F.shiftleft(F.shiftright(x, 16), 4) + x.bitwiseAND(F.lit(15)) + F.shiftright(x, 4).bitwiseAND(F.lit(4095))
    total = F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + pair(x))
    return w.select("file_id", (2 * F.size("w")).cast("long").alias("n_px"), total.alias("total"), (F.floor(F.length("h") / 2) % 3).cast("long").alias("rest"))


def _pictures(spark, d, kernel, schema):
    """Runs a kernel on each frame's depth picture (48 x 64): one frame is one task's group, of fixed size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.zeros((48, 64))
        z[pdf["v"].to_numpy(int), pdf["u"].to_numpy(int)] = pdf["z"].to_numpy(float)
        return pd.DataFrame([(int(pdf["frame"].iloc[0]), *kernel(z))], columns=[c.split()[0] for c in schema.split(", ")])

    return depth(spark, d).groupBy("frame").applyInPandas(run, schema)


def _normals(z: np.ndarray) -> np.ndarray:
    gy, gx = np.gradient(z)
    n = np.stack([-gx, -gy, np.ones_like(z)], axis=-1)
    return n / np.linalg.norm(n, axis=-1, keepdims=True)


@query("pol_01_demosaic")
def pol01(spark, d):
    return _pictures(spark, d, lambda z: [float(p.mean()) for p in raster.polar_planes(z).values()], "frame long, i90 double, i45 double, i135 double, i0 double")


@query("pol_13_edges")
def pol13(spark, d):
    return _pictures(spark, d, lambda z: (int(raster.edge(_normals(z)).sum()), int(raster.ridge(_normals(z)).sum())), "frame long, edge long, ridge long")


@query("pol_14_segments")
def pol14(spark, d):
    return _pictures(spark, d, lambda z: (len(raster.segments(raster.edge(_normals(raster.blur(z)), 0.5), 3, 20, 4000)),), "frame long, n_segments long")


def _largest(mask: np.ndarray) -> np.ndarray:
    parts, n = raster.label(mask)
    return parts == 1 + int(np.argmax(np.bincount(parts.ravel(), minlength=n + 1)[1:])) if n else mask


def _outline(z: np.ndarray):
    """Length and residual of the closed spline around the largest part of the near pixels; length 0 where it abstains."""
    curve, off = raster.closed_spline(raster.contour(_largest(raster.closing((z > 0) & (z < 3), 3))))
    length = float(np.linalg.norm(np.diff(curve, axis=0), axis=1).sum()) if curve is not None else 0.0
    return length, min(off, 1e9), curve is None


@query("pol_15_outline")
def pol15(spark, d):
    return _pictures(spark, d, _outline, "frame long, length double, residual double, abstains boolean")


def _integrated(z: np.ndarray):
    """Normals whose x, y lost their sign in a checker pattern, relaxed, and their slopes integrated to a height again."""
    n = _normals(raster.blur(z, 2.0, 9))
    n[::2, ::2, :2] *= -1
    back = raster.relax(n)
    _, residual = raster.integrate(-back[..., 0] / back[..., 2], -back[..., 1] / back[..., 2])
    return residual, raster.agreement(n), raster.agreement(back)


@query("pol_16_integrate")
def pol16(spark, d):
    """Ambiguous normals disambiguated by their neighbours, then integrated; the residual is how far the slopes are from any
    surface."""
    return _pictures(spark, d, _integrated, "frame long, residual double, before double, after double")


def _checked(z: np.ndarray):
    """Sub-images lie within their mosaic, flat normals have no edge, segments are of the sizes asked for, splines keep to
    their residual, relaxing never loses agreement, and slopes of a surface integrate to it."""
    planes = raster.polar_planes(z)
    level = np.zeros((*z.shape, 3)) + (0.0, 0.0, 1.0)
    parts = raster.segments(raster.edge(_normals(raster.blur(z)), 0.5), 3, 20, 4000)
    _, off, abstains = _outline(z)
    residual, before, after = _integrated(z)
    p, q = np.zeros_like(z), np.zeros_like(z)
    p[:, :-1], q[:-1] = np.diff(z, axis=1), np.diff(z, axis=0)
    whole, _ = raster.integrate(p, q)
    inside = all(z.min() - 1e-9 <= v.min() and v.max() <= z.max() + 1e-9 for v in planes.values())
    return inside, not raster.edge(level).any() and not raster.ridge(level).any(), all(20 <= a[4] <= 4000 for a in parts), abstains or off <= 0.12, after >= before - 1e-9 and bool(np.abs(whole - (z - z.mean())).max() < 0.05 * max(np.ptp(z), 1e-9))


@query("pol_checks", f"WITH {DEPTH} SELECT frame, true AS p01, true AS p13, true AS p14, true AS p15, true AS p16 FROM depth GROUP BY frame")
def pol_checks(spark, d):
    return _pictures(spark, d, _checked, "frame long, p01 boolean, p13 boolean, p14 boolean, p15 boolean, p16 boolean")


# ---- extras: not in the reference, Spark has them built in
@query("extra_rollup", f"WITH {FRAMES} SELECT dataset, cam, count(*) AS n FROM frames GROUP BY ROLLUP (dataset, cam)")
def extra_rollup(spark, d):
    return frames(spark, d).rollup("dataset", "cam").agg(F.count("*").alias("n"))


@query("extra_cube", "SELECT kind, status, count(*) AS n FROM jobs GROUP BY CUBE (kind, status)")
def extra_cube(spark, d):
    return table(spark, d, "jobs").cube("kind", "status").agg(F.count("*").alias("n"))


@query("extra_ranks", f"WITH {OBJECTS} SELECT id, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY kind ORDER BY npts, id) AS q FROM obj WINDOW w AS (PARTITION BY kind ORDER BY npts)")
def extra_ranks(spark, d):
    w = W.partitionBy("kind").orderBy("npts")
    return objects(spark, d).select("id", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("dr"), F.ntile(4).over(W.partitionBy("kind").orderBy("npts", "id")).cast("long").alias("q"))


@query("extra_approx_distinct")
def extra_approx(spark, d):
    return table(spark, d, "lineitem").agg(F.approx_count_distinct("l_orderkey").alias("orders"))


QUERIES, ORACLES = query.queries, query.oracles
