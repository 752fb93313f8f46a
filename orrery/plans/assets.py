"""Close-up assets, view rectangles, pose reports, two-ray depths and the products of a recording (G, M, P, A rows)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.operators import assets, fitting, spatial, temporal
from orrery.plans.binding import CLOUD, DEPTH, FRAMES, OBJECTS, cloud, depth, frames, objects
from orrery.plans.kernels import ST, stokes
from orrery.plans.projections import EYE, K, P, Q, ROI, RS, UPRIGHT, XYZ, _upright, poly_sql, r6, sr
from orrery.plans.registry import Registry
from orrery.plans.relations import CHUNKS, LAYERS, SESS, files, sessions
from orrery.session import materialize, table

query = Registry()

# Products of a frame, and those of them that are decoded when first asked for.
PRODUCTS = ["color", "rgb_deglare", "intensity", "nxyz", "n_xy", "n_xz", "nxyz_phys", "nxyz_diffuse", "nxyz_specv2", "edge"]
LIVE = ["nxyz", "n_xy", "n_xz", "nxyz_phys", "nxyz_diffuse", "nxyz_specv2", "edge", "rgb_deglare"]
CATALOG = "cat(product, live) AS (VALUES " + ", ".join(f"('{p}', {str(p in LIVE).lower()})" for p in PRODUCTS) + ")"


def catalog(spark):
    """product, live: ten rows."""
    return spark.createDataFrame([(p, p in LIVE) for p in PRODUCTS], "product string, live boolean")


@query("pol_17_catalog", f"WITH {LAYERS}, {CATALOG}, n AS (SELECT regexp_replace(folder, '^layers/', '') AS product, count(*) AS n FROM stems WHERE tree = 'layers' GROUP BY 1) SELECT product, live, coalesce(n, 0) AS n_files FROM cat LEFT JOIN n USING (product)")
def pol17(spark, d):
    """The catalog of products, with the frames that each is there for."""
    made = files(spark, d).filter("tree_key = 'layers'").select("recording", "product", "frame").distinct().groupBy("product").agg(F.count("*").alias("n"))
    return catalog(spark).join(made, "product", "left").select("product", "live", F.coalesce("n", F.lit(0)).alias("n_files"))


@query("pol_18_batches", f"WITH {LAYERS}, {CATALOG}, l AS (SELECT DISTINCT dataset, stem, regexp_replace(folder, '^layers/', '') AS product FROM stems WHERE tree = 'layers'), r AS (SELECT DISTINCT dataset, stem FROM stems WHERE tree = 'rgb'), n AS (SELECT r.dataset, r.stem, count(c.product) AS have FROM r LEFT JOIN l ON l.dataset = r.dataset AND l.stem = r.stem LEFT JOIN cat c ON c.product = l.product AND c.live GROUP BY 1, 2) SELECT dataset, count(*) AS total, count(*) FILTER (have < {len(LIVE)}) AS todo, CAST(sum({len(LIVE)} - have) AS BIGINT) AS missing FROM n GROUP BY dataset")
def pol18(spark, d):
    """What a batch run over a recording would do: frames, frames with a live product missing, and products missing."""
    f = materialize(files(spark, d).select("recording", "tree_key", "product", "frame").distinct(), "files")
    rgb = f.filter("tree_key = 'rgb'").select("recording", "frame").distinct()
    made = f.filter(F.col("product").isin(LIVE) & (F.col("tree_key") == "layers")).groupBy("recording", "frame").agg(F.count("*").alias("have"))
    lack = len(LIVE) - F.coalesce("have", F.lit(0))
    n = rgb.join(made, ["recording", "frame"], "left").withColumn("lack", lack).groupBy(F.col("recording").alias("dataset"))
    return n.agg(F.count("*").alias("total"), F.count(F.when(F.col("lack") > 0, 1)).alias("todo"), F.sum("lack").cast("long").alias("missing"))


SHOWN = "v AS (SELECT px, dolp, s0, aolp - pi()/2 AS ph FROM a WHERE abs(s2) > 1e-6)"


@query("pol_12_views", f"WITH {ST}, {SHOWN}, t AS (SELECT quantile_cont(s0, 0.995) AS top FROM st) SELECT px, CAST(floor((ph/pi() + 0.5)*255) AS BIGINT) AS angle, CAST(CASE WHEN ph >= 0 THEN floor(least(abs(ph)/(pi()/2), 1)*255) ELSE 0 END AS BIGINT) AS blue, CAST(CASE WHEN ph < 0 THEN floor(least(abs(ph)/(pi()/2), 1)*255) ELSE 0 END AS BIGINT) AS red, CAST(floor(least(dolp*1.5*255, 255) + 1e-9) AS BIGINT) AS degree, CAST(floor(least(greatest(s0/greatest(top, 1e-6)*255, 0), 255) + 1e-9) AS BIGINT) AS grey FROM v, t")
def pol12(spark, d):
    """Display values of a pixel: angle in grey and in two colours, degree, intensity."""
    st = materialize(stokes(spark, d).select("px", "s0", "s2", "dolp", "aolp"), "views")
    top = spatial.quantiles(st, [], {"top": ("s0", 0.995)})  # one row
    ph = F.col("aolp") - math.pi / 2
    m = F.floor(F.least(F.abs(ph) / (math.pi / 2), F.lit(1.0)) * 255)
    grey = F.least(F.greatest(F.col("s0") / F.greatest("top", F.lit(1e-6)) * 255, F.lit(0.0)), F.lit(255.0))
    zero = F.lit(0).cast("long")
    out = st.filter("abs(s2) > 1e-6").crossJoin(F.broadcast(top))
    return out.select("px", F.floor((ph / math.pi + 0.5) * 255).alias("angle"), F.when(ph >= 0, m).otherwise(zero).alias("blue"), F.when(ph < 0, m).otherwise(zero).alias("red"), F.floor(F.least(F.col("dolp") * 1.5 * 255, F.lit(255.0)) + 1e-9).alias("degree"), F.floor(grey + 1e-9).alias("grey"))


# ---- M
RAYS = f"""r AS (SELECT name, dataset, cam, ts, px, py, pz, {RS[2][0]} AS ax, {RS[2][1]} AS ay, {RS[2][2]} AS az FROM frames),
p AS (SELECT *, lead(px) OVER w AS ox, lead(py) OVER w AS oy, lead(pz) OVER w AS oz, lead(ax) OVER w AS jx, lead(ay) OVER w AS jy, lead(az) OVER w AS jz FROM r WINDOW w AS (PARTITION BY dataset, cam ORDER BY ts, name)),
b AS (SELECT *, sqrt((px-ox)**2 + (py-oy)**2 + (pz-oz)**2) AS len FROM p WHERE jx IS NOT NULL),
u AS (SELECT name, ax, ay, az, 0.96*jx + 0.28*jz AS jx, jy, -0.28*jx + 0.96*jz AS jz, (px-ox)/len AS bx, (py-oy)/len AS by_, (pz-oz)/len AS bz FROM b WHERE len > 1e-9),
d AS (SELECT *, jx*jx + jy*jy + jz*jz AS a11, -(jx*ax + jy*ay + jz*az) AS a12, ax*ax + ay*ay + az*az AS a22, jx*bx + jy*by_ + jz*bz AS b1, -(ax*bx + ay*by_ + az*bz) AS b2, by_*az - bz*ay AS nx, bz*ax - bx*az AS ny, bx*ay - by_*ax AS nz FROM u),
z AS (SELECT *, a11*a22 - a12*a12 AS det FROM d)"""


@query("m10_two_rays", f"WITH {FRAMES}, {RAYS} SELECT name, {sr('(b1*a22 - a12*b2)/det', 'zj', 3)}, {sr('(a11*b2 - a12*b1)/det', 'zi', 3)}, {sr('abs(jx*nx + jy*ny + jz*nz)/(sqrt(nx*nx + ny*ny + nz*nz)*sqrt(a11) + 1e-12)', 'epipolar', 4)}, {sr('degrees(acos(least(greatest(-a12/sqrt(a11*a22), -1), 1)))', 'parallax', 3)} FROM z WHERE det > 0.01")
def m10(spark, d):
    """Depths along a frame's ray and a turned ray of the next one, in units of their distance, with the measures that decide
    whether the pair counts (epipolar below 0.005, parallax above 1 degree)."""
    f = g.rotation_of(Q)[2]
    r = frames(spark, d).select("name", "dataset", "cam", "ts", "px", "py", "pz", *[c.alias("a" + n) for c, n in zip(f, "xyz")])
    near = temporal.beside(r, ["dataset", "cam"], "ts", ["ts", "name"], {**{"o" + n: ("p" + n, 1) for n in "xyz"}, **{"k" + n: ("a" + n, 1) for n in "xyz"}}).filter("kx is not null")
    gap = g.minus(g.vec("p"), g.vec("o"))
    near = near.withColumn("len", g.norm(gap)).filter("len > 1e-9")
    a, b = g.vec("a"), [c / F.col("len") for c in gap]
    j = [0.96 * F.col("kx") + 0.28 * F.col("kz"), F.col("ky"), -0.28 * F.col("kx") + 0.96 * F.col("kz")]
    u = near.select("name", *[c.alias("a" + n) for c, n in zip(a, "xyz")], *[c.alias("b" + n) for c, n in zip(b, "xyz")], *[c.alias("j" + n) for c, n in zip(j, "xyz")])
    a, b, j = g.vec("a"), g.vec("b"), g.vec("j")
    n = g.cross(b, a)
    m = u.select("name", g.dot(j, j).alias("a11"), (-g.dot(j, a)).alias("a12"), g.dot(a, a).alias("a22"), g.dot(j, b).alias("b1"), (-g.dot(a, b)).alias("b2"), (F.abs(g.dot(j, n)) / (g.norm(n) * g.norm(j) + 1e-12)).alias("ep"))
    m = m.withColumn("det", F.expr("a11*a22 - a12*a12")).filter("det > 0.01")
    return m.select("name", r6(F.expr("(b1*a22 - a12*b2)/det"), "zj", 3), r6(F.expr("(a11*b2 - a12*b1)/det"), "zi", 3), r6(F.col("ep"), "epipolar", 4), r6(F.degrees(F.acos(F.least(F.greatest(-F.col("a12") / F.sqrt(F.col("a11") * F.col("a22")), F.lit(-1.0)), F.lit(1.0)))), "parallax", 3))


@query("m12_nearest_reading", f"""WITH {CLOUD}, c AS (SELECT seq, nr/127.5 - 1 AS x, ng/127.5 - 1 AS y, nb/127.5 - 1 AS z, 10.0 - x AS px, 1.5 - y AS py, -30.0 - z AS pz FROM cloud WHERE nr IS NOT NULL AND ng IS NOT NULL AND nb IS NOT NULL),
k AS (SELECT seq, unnest([{{'s': round(x*px + y*py + z*pz, 6), 'k': 0, 'a': x, 'b': y}}, {{'s': round(-x*px - y*py + z*pz, 6), 'k': -1, 'a': -x, 'b': -y}}, {{'s': round(-y*px + x*py + z*pz, 6), 'k': -2, 'a': -y, 'b': x}}, {{'s': round(y*px - x*py + z*pz, 6), 'k': -3, 'a': y, 'b': -x}}]) AS o, z FROM c)
SELECT seq, {sr('max(o).a', 'nx', 5)}, {sr('max(o).b', 'ny', 5)}, {sr('max(z)', 'nz', 5)} FROM k GROUP BY seq""")
def m12(spark, d):
    """The normal itself: of its four readings (as it is, turned in its plane by 180 and by 90 degrees either way) the one
    nearest to a prior, here the way to the fixed camera; of equal ones the first."""
    x, y, z = (F.col(c) / 127.5 - 1 for c in ("nr", "ng", "nb"))
    p = g.minus(g.lits(EYE.values()), XYZ)
    read = lambda k, a, b: F.struct(F.round(a * p[0] + b * p[1] + z * p[2], 6).alias("s"), F.lit(-k).alias("k"), a.alias("a"), b.alias("b"))
    best = F.array_max(F.array(read(0, x, y), read(1, -x, -y), read(2, -y, x), read(3, y, -x)))
    return cloud(spark, d).dropna(subset=["nr", "ng", "nb"]).withColumn("o", best).select("seq", r6(F.col("o.a"), "nx", 5), r6(F.col("o.b"), "ny", 5), r6(z, "nz", 5))


# ---- A36: the pose report
REPORT = f"""{SESS}, hole AS (SELECT dataset, cam, max(session) AS holes FROM s GROUP BY 1, 2), way AS (SELECT dataset, cam, sqrt((px - lag(px) OVER w)**2 + (py - lag(py) OVER w)**2 + (pz - lag(pz) OVER w)**2) AS step FROM frames WINDOW w AS (PARTITION BY dataset, cam ORDER BY ts, name)),
len AS (SELECT dataset, cam, count(*) AS n_frames, coalesce(sum(step), 0) AS path FROM way GROUP BY 1, 2), seam AS (SELECT rtrim(trim(coalesce(dataset, '')), '/') AS dataset, cam, median(centre_gap_med) AS gap, median(rot_spread_deg) AS spread FROM (SELECT DISTINCT * FROM poses_report) WHERE centre_gap_med > 0 AND centre_gap_med < 1e4 GROUP BY 1, 2)"""


@query("a36_pose_report_full", REPORT + f" SELECT len.dataset, len.cam, n_frames, {sr('path', 'path_len', 2)}, CAST(holes AS BIGINT) AS time_holes, {sr('gap', 'seam_gap', 6)}, {sr('spread', 'seam_spread', 6)} FROM len JOIN hole ON len.dataset = hole.dataset AND len.cam = hole.cam LEFT JOIN seam ON len.dataset = seam.dataset AND len.cam = seam.cam")
def a36(spark, d):
    """Per camera of a recording: frames, length of its path, holes in time, and medians over its seams."""
    from orrery.functions.names import recording

    by = ["dataset", "cam"]
    near = temporal.beside(frames(spark, d), by, "ts", ["ts", "name"], {"b" + c: (c, -1) for c in ("px", "py", "pz")})
    step = F.sqrt(sum(((F.col(c) - F.col("b" + c)) ** 2 for c in ("px", "py", "pz")), F.lit(0.0)))
    path = near.groupBy(*by).agg(F.count("*").alias("n_frames"), F.coalesce(F.sum(step), F.lit(0.0)).alias("path"))
    holes = sessions(spark, d).groupBy(*by).agg(F.max("session").cast("long").alias("time_holes"))
    seams = table(spark, d, "poses_report").distinct().filter("centre_gap_med > 0 and centre_gap_med < 1e4").withColumn("dataset", recording(F.col("dataset")))
    seam = seams.groupBy(*by).agg(F.median("centre_gap_med").alias("gap"), F.median("rot_spread_deg").alias("spread"))
    return path.join(holes, by).join(seam, by, "left").select(*by, "n_frames", r6(F.col("path"), "path_len", 2), "time_holes", r6(F.col("gap"), "seam_gap", 6), r6(F.col("spread"), "seam_spread", 6))


# ---- G
SMALL = [(480.0, 560.0), (540.0, 560.0), (540.0, 620.0), (480.0, 620.0)]
#: The ray through the middle of the small region: in the upright picture (510, 590), on the sensor (590, 513).
RAY = [(590 - K["cx"]) / K["fx"], (513 - K["cy"]) / K["fy"], 1.0]
RAY_T = f"((x - 10)*{RAY[0]:.17e} + (y - 1.5)*{RAY[1]:.17e} + (z + 30))/sqrt({RAY[0]:.17e}*{RAY[0]:.17e} + {RAY[1]:.17e}*{RAY[1]:.17e} + 1)"


def _cascade(cloud_n, ray_n, depth_n, small: bool):
    ray = F.when(cloud_n >= 300, "cloud").when(F.lit(small) & (ray_n >= 20), "ray")
    return ray.when(depth_n >= 40, "depth").when(cloud_n >= 12, "cloud").otherwise("none")


@query("g01_sources_of_regions", f"WITH {CLOUD}, {UPRIGHT}, {DEPTH}, h AS (SELECT count(*) FILTER ({poly_sql('ux', 'uy', ROI)}) AS big, count(*) FILTER ({poly_sql('ux', 'uy', SMALL)}) AS small FROM seen), t AS (SELECT {RAY_T} AS t, (x-10)**2 + (y-1.5)**2 + (z+30)**2 AS d2 FROM cloud), c AS (SELECT count(*) AS ray FROM t WHERE t > 0.3 AND sqrt(greatest(d2 - t*t, 0))/t < 0.012), k AS (SELECT count(*) FILTER (u BETWEEN 15 AND 42 AND v BETWEEN 6 AND 34) AS big, count(*) FILTER (u BETWEEN 29 AND 32 AND v BETWEEN 22 AND 25) AS small FROM depth WHERE frame = 1 AND z BETWEEN 0.05 AND 45) SELECT 'big' AS region, CASE WHEN h.big >= 300 THEN 'cloud' WHEN k.big >= 40 THEN 'depth' WHEN h.big >= 12 THEN 'cloud' ELSE 'none' END AS source, h.big AS n_cloud, ray AS n_ray, k.big AS n_depth FROM h, c, k UNION ALL SELECT 'small', CASE WHEN h.small >= 300 THEN 'cloud' WHEN ray >= 20 THEN 'ray' WHEN k.small >= 40 THEN 'depth' WHEN h.small >= 12 THEN 'cloud' ELSE 'none' END, h.small, ray, k.small FROM h, c, k")
def g01(spark, d):
    """What a region is solved from: the cloud if it holds many points; for a small region the cone around its ray; the
    depth picture; else the few points of the cloud."""
    seen = _upright(spark, d).filter("inside")
    within = lambda roi: F.count(F.when(g.in_polygon(F.col("ux"), F.col("uy"), roi), 1))
    h = seen.agg(within(ROI).alias("big"), within(SMALL).alias("small"))
    v = g.minus(XYZ, g.lits(EYE.values()))
    t = sum((c * r for c, r in zip(v, RAY)), F.lit(0.0)) / math.sqrt(sum(r * r for r in RAY))
    cone = cloud(spark, d).select(t.alias("t"), g.dot(v, v).alias("d2")).filter("t > 0.3").filter(F.sqrt(F.greatest(F.col("d2") - F.col("t") ** 2, F.lit(0.0))) / F.col("t") < 0.012).agg(F.count("*").alias("n_ray"))
    px = depth(spark, d).filter("frame = 1 and z between 0.05 and 45")
    k = px.agg(F.count(F.when(F.expr("u between 15 and 42 and v between 6 and 34"), 1)).alias("d_big"), F.count(F.when(F.expr("u between 29 and 32 and v between 22 and 25"), 1)).alias("d_small"))
    one = materialize(h.crossJoin(cone).crossJoin(k), "regions")  # one row each
    rows = [one.select(F.lit(n).alias("region"), _cascade(F.col(n), F.col("n_ray"), F.col("d_" + n), n == "small").alias("source"), F.col(n).alias("n_cloud"), "n_ray", F.col("d_" + n).alias("n_depth")) for n in ("big", "small")]
    return rows[0].union(rows[1])


CORNERS = "p AS (SELECT id, pts::DOUBLE[][] AS c FROM obj WHERE kind = 'rect' AND pts IS NOT NULL), b AS (SELECT id, least(c[1][1], c[2][1]) AS x0, greatest(c[1][1], c[2][1]) AS x1, least(c[1][2], c[2][2]) AS y0, greatest(c[1][2], c[2][2]) AS y1 FROM p)"
EDGES = [("x0 - 0.12*(x1 - x0)", 1024), ("y0 - 0.12*(y1 - y0)", 1224), ("x1 + 0.12*(x1 - x0)", 1024), ("y1 + 0.12*(y1 - y0)", 1224)]


@query("g18_view_rect", f"WITH {OBJECTS}, {CORNERS}, r AS (SELECT id, " + ", ".join(f"CAST(floor(least(greatest({e}, 0), {size})) AS BIGINT) AS {n}" for (e, size), n in zip(EDGES, ("l", "t", "r", "b"))) + f" FROM b) SELECT id, l, t, r, b, {sr('least(1.0, 560.0/greatest(r - l, b - t))', 'scale', 5)} FROM r WHERE r > l AND b > t")
def g18(spark, d):
    """Rectangle of a view of an object: its outline and 12 %, within the upright picture, and the scale to at most 560 pixels."""
    c = F.from_json("pts", "array<array<double>>")
    b = objects(spark, d).filter("kind = 'rect' and pts is not null").select("id", c.alias("c"))
    b = b.select("id", *[f(F.col("c")[0][i], F.col("c")[1][i]).alias(n) for n, f, i in (("x0", F.least, 0), ("x1", F.greatest, 0), ("y0", F.least, 1), ("y1", F.greatest, 1))])
    r = b.select("id", *[F.floor(F.least(F.greatest(F.expr(e.replace("0.12", "0.12D")), F.lit(0.0)), F.lit(float(size)))).alias(n) for (e, size), n in zip(EDGES, ("l", "t", "r", "b"))]).filter("r > l and b > t")
    return r.select("*", r6(F.least(F.lit(1.0), 560.0 / F.greatest(F.col("r") - F.col("l"), F.col("b") - F.col("t"))), "scale", 5))


FRAME = f"""WITH {CLOUD}, m AS (SELECT dataset, 0.5*atan2(2*covar_pop(x, z), var_pop(x) - var_pop(z)) AS th FROM cloud GROUP BY dataset), r AS (SELECT seq, c.dataset, x*cos(th) + z*sin(th) AS a, y AS b, z*cos(th) - x*sin(th) AS c FROM cloud c JOIN m ON c.dataset = m.dataset),
q AS (SELECT dataset, """ + ", ".join(f"(quantile_cont({n}, 0.01) + quantile_cont({n}, 0.99))/2 AS m{n}, quantile_cont({n}, 0.995) - quantile_cont({n}, 0.005) AS e{n}" for n in "abc") + " FROM r GROUP BY dataset)"


@query("g09_splat_frame", FRAME + " SELECT seq, " + ", ".join(sr(f"({n} - m{n})/greatest(ea, eb, ec, 1e-6)", m, 4) for n, m in zip("abc", "xyz")) + " FROM r JOIN q ON r.dataset = q.dataset")
def g09(spark, d):
    """Packs as close-ups: long horizontal axis left to right, centred between their 1st and 99th percentiles, the largest
    extent between the 0.5th and the 99.5th scaled to 1."""
    s = assets.close_up(cloud(spark, d).select("seq", "dataset", "x", "y", "z"), ["dataset"])
    return s.select("seq", *[r6(F.col(c), c, 4) for c in "xyz"])


@query("g09_splat_checks", f"WITH {CLOUD} SELECT dataset, count(*) AS n, 0 AS out_of_order, 0 AS pale FROM cloud GROUP BY dataset")
def g09s(spark, d):
    """Splats of close-ups, one of every point, numbered large and opaque first, with normals as colours: order and colours as
    they must be."""
    s = materialize(assets.splats_of(cloud(spark, d).dropna(subset=["x", "y", "z"]), ["dataset"]), "splats")
    return assets.splat_faults(s, ["dataset"])


QUERIES, ORACLES = query.queries, query.oracles
