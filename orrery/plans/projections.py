"""Projections, filters and scalar functions (F, M, X rows of the inventory)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.functions import names as n
from orrery.operators import spatial, temporal
from orrery.plans.binding import CLOUD, DEPTH, FRAMES, INTRINSICS, OBJECTS, PIXELS, cloud, depth, frames, objects, pixels
from orrery.plans.registry import Registry
from orrery.session import table

query = Registry()
K = INTRINSICS
Q = g.Later("q", "wxyz")
P = g.Later("p")
XYZ = g.Later("")
#: A fixed camera of the sample recording, behind the cloud and looking along z.
EYE = {"px": 10.0, "py": 1.5, "pz": -30.0}
#: A fixed region of interest in the upright picture.
ROI = [(300.0, 200.0), (800.0, 260.0), (900.0, 900.0), (420.0, 1000.0)]


#: A fixed turn about the vertical, of boxes.
TURN = [[0.8, 0.0, 0.6], [0.0, 1.0, 0.0], [-0.6, 0.0, 0.8]]


def r6(c, name, places=6):
    return (F.round(c, places) + F.lit(0.0)).alias(name)


def rot_sql(w="qw", x="qx", y="qy", z="qz"):
    return [[f"(1 - 2*({y}*{y} + {z}*{z}))", f"(2*({x}*{y} - {w}*{z}))", f"(2*({x}*{z} + {w}*{y}))"], [f"(2*({x}*{y} + {w}*{z}))", f"(1 - 2*({x}*{x} + {z}*{z}))", f"(2*({y}*{z} - {w}*{x}))"], [f"(2*({x}*{z} - {w}*{y}))", f"(2*({y}*{z} + {w}*{x}))", f"(1 - 2*({x}*{x} + {y}*{y}))"]]


RS = rot_sql()


def sr(e, name, places=6):
    return f"round({e}, {places}) + 0.0 AS {name}"


@query("f01_quat_to_rot", f"WITH {FRAMES} SELECT name, " + ", ".join(sr(RS[i][j], f"r{i}{j}") for i in range(3) for j in range(3)) + " FROM frames")
def f01(spark, d):
    r = g.rotation_of(Q)
    return frames(spark, d).select("name", *[r6(r[i][j], f"r{i}{j}") for i in range(3) for j in range(3)])


@query("f02_rot_to_quat", f"WITH {FRAMES} SELECT name, " + ", ".join(sr(f"CASE WHEN qw < 0 THEN -{c} ELSE {c} END", c, 4) for c in ("qw", "qx", "qy", "qz")) + " FROM frames WHERE abs(qw) > 0.001")
def f02(spark, d):
    q = g.quaternion_of(g.rotation_of(Q))
    return frames(spark, d).filter(F.abs("qw") > 0.001).select("name", *[r6(c, a, 4) for c, a in zip(q, ("qw", "qx", "qy", "qz"))])


CAM = [f"({RS[i][0]}*(10.0 - px) + {RS[i][1]}*(1.5 - py) + {RS[i][2]}*(30.0 - pz))" for i in range(3)]


def _seen(spark, d):
    cam = g.to_camera(g.lits((10.0, 1.5, 30.0)), P, Q)
    return frames(spark, d).select("name", *[c.alias(a) for c, a in zip(cam, ("cx", "cy", "cz"))])


@query("f03_world_to_pixel", f"WITH {FRAMES}, c AS (SELECT name, {CAM[0]} AS cx, {CAM[1]} AS cy, {CAM[2]} AS cz FROM frames) SELECT name, {sr('1183.5*cx/cz + 612.0', 'sx', 3)}, {sr('1183.5*cy/cz + 512.0', 'sy', 3)}, {sr('cz', 'z')} FROM c WHERE cz > 0.001 AND cz < 1e9")
def f03(spark, d):
    sx, sy = g.project(g.vec("c"), K)
    return _seen(spark, d).filter((F.col("cz") > 1e-3) & (F.col("cz") < 1e9)).select("name", r6(sx, "sx", 3), r6(sy, "sy", 3), r6(F.col("cz"), "z"))


@query("f05_project_upright", f"WITH {CLOUD}, c AS (SELECT seq, 1183.5*(x - 10.0)/(z + 30.0) + 612.0 AS sx, 1183.5*(y - 1.5)/(z + 30.0) + 512.0 AS sy, z + 30.0 AS z FROM cloud WHERE z + 30.0 > 0.3) SELECT seq, {sr('1023 - sy', 'ux', 4)}, {sr('sx', 'uy', 4)}, {sr('z', 'z')}, (sx >= 0 AND sx < 1224 AND sy >= 0 AND sy < 1024) AS inside FROM c")
def f05(spark, d):
    return _upright(spark, d).select("seq", r6(F.col("ux"), "ux", 4), r6(F.col("uy"), "uy", 4), r6(F.col("z"), "z"), "inside")


def _upright(spark, d):
    """Cloud in the upright picture of the fixed camera (also F04)."""
    eye = g.lits(EYE.values())
    cam = g.minus(XYZ, eye)
    sx, sy = g.project(cam, K)
    seen = cloud(spark, d).withColumn("_z", cam[2]).filter("_z > 0.3").select("seq", "dataset", *[F.col(c).alias("w" + c) for c in "xyz"], F.col("_z").alias("z"), sx.alias("sx"), sy.alias("sy"))
    ux, uy = g.upright(F.col("sx"), F.col("sy"), K["h"])
    inside = (F.col("sx") >= 0) & (F.col("sx") < K["w"]) & (F.col("sy") >= 0) & (F.col("sy") < K["h"])
    return seen.withColumn("ux", ux).withColumn("uy", uy).withColumn("inside", inside)


UNP = [f"({RS[0][i]}*rx + {RS[1][i]}*ry + {RS[2][i]}*z)" for i in range(3)]
UNPROJECT = f"""rays AS (SELECT frame, u, v, z, conf, (u * 19 + 0.5 - 612.0)/1183.5*z AS rx, (v * 21 + 0.5 - 512.0)/1183.5*z AS ry,
cos(frame*0.05) AS qw, 0.0 AS qx, sin(frame*0.05) AS qy, 0.0 AS qz FROM depth)"""


def unprojected(spark, d):
    """Depth pixels as world points; frame f looks along yaw 0.1 f from place (f / 10, 0, 0)."""
    half = F.col("frame") * 0.05
    q = [F.cos(half), F.lit(0.0), F.sin(half), F.lit(0.0)]
    p = g.unproject(F.col("u") * 19, F.col("v") * 21, F.col("z"), K, q, [F.col("frame") / 10, F.lit(0.0), F.lit(0.0)], 0.5)
    return depth(spark, d).select("frame", "u", "v", "z", "conf", *[c.alias(a) for c, a in zip(p, ("wx", "wy", "wz"))])


@query("f06_unproject", f"WITH {DEPTH}, {UNPROJECT} SELECT frame, u, v, {sr(UNP[0] + ' + frame/10.0', 'wx', 4)}, {sr(UNP[1], 'wy', 4)}, {sr(UNP[2], 'wz', 4)} FROM rays")
def f06(spark, d):
    return unprojected(spark, d).select("frame", "u", "v", *[r6(F.col(c), c, 4) for c in ("wx", "wy", "wz")])


@query("f07_similarity", f"WITH {CLOUD} SELECT seq, {sr('1.7*(0.8*x - 0.6*y) + 1.0', 'x', 5)}, {sr('1.7*(0.6*x + 0.8*y) - 2.0', 'y', 5)}, {sr('1.7*z + 0.5', 'z', 5)} FROM cloud")
def f07(spark, d):
    out = g.similarity(XYZ, 1.7, [[0.8, -0.6, 0.0], [0.6, 0.8, 0.0], [0.0, 0.0, 1.0]], [1.0, -2.0, 0.5])
    return cloud(spark, d).select("seq", *[r6(c, a, 5) for c, a in zip(out, "xyz")])


@query("f08_asset_chain", f"WITH {CLOUD}, a AS (SELECT seq, 1.7*(0.8*x - 0.6*y) + 1.0 AS ax, 1.7*(0.6*x + 0.8*y) - 2.0 AS ay, 1.7*z + 0.5 AS az FROM cloud), w AS (SELECT *, 0.4*(0.28*ax + 0.96*az) - 3.0 AS wx, 0.4*ay + 1.25 AS wy, 0.4*(-0.96*ax + 0.28*az) + 7.0 AS wz FROM a) SELECT seq, " + ", ".join(sr(c, c, 4) for c in ("ax", "ay", "az", "wx", "wy", "wz")) + ", " + ", ".join(sr(e, n, 4) for e, n in (("(0.28*(wx + 3.0) - 0.96*(wz - 7.0))/0.4", "bx"), ("(wy - 1.25)/0.4", "by"), ("(0.96*(wx + 3.0) + 0.28*(wz - 7.0))/0.4", "bz"))) + " FROM w")
def f08(spark, d):
    """Close-up to asset (a), asset to world (w), and world back to the asset by the inverse (b): two similarities in a chain."""
    up = cloud(spark, d).select("seq", *[c.alias("a" + n) for c, n in zip(g.similarity(XYZ, 1.7, [[0.8, -0.6, 0.0], [0.6, 0.8, 0.0], [0.0, 0.0, 1.0]], [1.0, -2.0, 0.5]), "xyz")])
    s, r, t = 0.4, [[0.28, 0.0, 0.96], [0.0, 1.0, 0.0], [-0.96, 0.0, 0.28]], [-3.0, 1.25, 7.0]
    world = up.select("*", *[c.alias("w" + n) for c, n in zip(g.similarity(g.vec("a"), s, r, t), "xyz")])
    back = [sum((F.lit(r[j][i]) * (F.col("w" + n) - t[j]) for j, n in enumerate("xyz")), F.lit(0.0)) / s for i in range(3)]
    return world.select("seq", *[r6(F.col(c), c, 4) for c in ("ax", "ay", "az", "wx", "wy", "wz")], *[r6(c, "b" + n, 4) for c, n in zip(back, "xyz")])


@query("f09_roi_polygon", f"WITH {OBJECTS}, p AS (SELECT id, kind, pts::DOUBLE[][] AS c FROM obj WHERE kind = 'circle' AND pts IS NOT NULL), k AS (SELECT id, c, unnest(range(40)) AS i FROM p) SELECT id, CAST(i AS INTEGER) AS i, {sr('c[1][1] + sqrt((c[2][1]-c[1][1])**2 + (c[2][2]-c[1][2])**2) * cos(2*pi()*i/40)', 'x', 3)}, {sr('c[1][2] + sqrt((c[2][1]-c[1][1])**2 + (c[2][2]-c[1][2])**2) * sin(2*pi()*i/40)', 'y', 3)} FROM k")
def f09(spark, d):
    o = objects(spark, d).filter("kind = 'circle' and pts is not null").select("id", F.from_json("pts", "array<array<double>>").alias("c"))
    c, e = F.col("c")[0], F.col("c")[1]
    radius = F.hypot(e[0] - c[0], e[1] - c[1])
    k = o.select("id", c.alias("m"), radius.alias("r"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("i"))
    turn = F.col("i") * (2 * math.pi) / 40
    return k.select("id", "i", r6(F.col("m")[0] + F.col("r") * F.cos(turn), "x", 3), r6(F.col("m")[1] + F.col("r") * F.sin(turn), "y", 3))


def poly_sql(x, y, corners):
    hits = [f"CAST((({ay} > {y}) <> ({by} > {y})) AND ({x} < ({bx - ax}) * ({y} - {ay}) / ({by - ay} + 1e-12) + {ax}) AS INTEGER)" for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]])]
    return "(" + " + ".join(hits) + ") % 2 = 1"


UPRIGHT = "up AS (SELECT seq, x, y, z AS wz, z + 30.0 AS z, 1023 - (1183.5*(y - 1.5)/(z + 30.0) + 512.0) AS ux, 1183.5*(x - 10.0)/(z + 30.0) + 612.0 AS uy FROM cloud WHERE z + 30.0 > 0.3), seen AS (SELECT * FROM up WHERE uy >= 0 AND uy < 1224 AND 1023 - ux >= 0 AND 1023 - ux < 1024)"


@query("f10_point_in_polygon", f"WITH {CLOUD}, {UPRIGHT} SELECT seq FROM seen WHERE {poly_sql('ux', 'uy', ROI)}")
def f10(spark, d):
    return _upright(spark, d).filter("inside").filter(g.in_polygon(F.col("ux"), F.col("uy"), ROI)).select("seq")


@query("f11_depth_range", f"WITH {DEPTH} SELECT frame, u, v FROM depth WHERE z > 0.02 AND z < 7.5")
def f11(spark, d):
    return depth(spark, d).filter("z > 0.02 and z < 7.5").select("frame", "u", "v")


@query("f12_confidence", f"WITH {DEPTH} SELECT frame, u, v FROM depth WHERE conf >= 40 AND conf > (SELECT quantile_cont(conf, 0.15) FROM depth WHERE z > 0)")
def f12(spark, d):
    px = depth(spark, d)
    low = px.filter("z > 0").agg(F.percentile("conf", 0.15).alias("low"))  # one row
    return px.crossJoin(F.broadcast(low)).filter("conf >= 40 and conf > low").select("frame", "u", "v")


NEXT = [("u", "v", "lag", 0, -1), ("u", "v", "lead", 63, 1), ("v", "u", "lag", 0, -1), ("v", "u", "lead", 47, 1)]
EDGE = "e AS (SELECT *, greatest(" + ", ".join(f"CASE WHEN {a} = {end} THEN 0 WHEN {f}({a}) OVER {a}w = {a} + {step} THEN abs(z - {f}(z) OVER {a}w) ELSE 1e9 END" for a, _, f, end, step in NEXT) + ") AS jump FROM depth WINDOW uw AS (PARTITION BY frame, v ORDER BY u), vw AS (PARTITION BY frame, u ORDER BY v))"


@query("f13_depth_edge", f"WITH {DEPTH}, {EDGE} SELECT frame, u, v, {sr('least(jump, 999)', 'jump', 4)}, NOT (jump < 0.05*z) AS edge FROM e")
def f13(spark, d):
    """Largest step in depth to a pixel's four neighbours, and whether it is an edge: 5 % of the depth or more. A neighbour
    without depth counts as an edge, a neighbour outside the picture does not."""
    from pyspark.sql import Window as W

    gaps = []
    for a, other, f, end, step in NEXT:
        w, side = W.partitionBy("frame", other).orderBy(a), getattr(F, f)
        gaps.append(F.when(F.col(a) == end, 0.0).when(side(a).over(w) == F.col(a) + step, F.abs(F.col("z") - side("z").over(w))).otherwise(1e9))
    e = depth(spark, d).select("frame", "u", "v", "z", F.greatest(*gaps).alias("jump"))
    return e.select("frame", "u", "v", r6(F.least("jump", F.lit(999.0)), "jump", 4), (~(F.col("jump") < 0.05 * F.col("z"))).alias("edge"))


@query("f14_vignette", f"WITH {DEPTH} SELECT frame, u, v FROM depth WHERE sqrt((u - 32)**2 + (v - 24)**2) < 0.85 * 40")
def f14(spark, d):
    return depth(spark, d).filter(F.hypot(F.col("u") - 32, F.col("v") - 24) < 0.85 * math.hypot(32, 24)).select("frame", "u", "v")


@query("f15_grid_subsample", f"WITH {DEPTH} SELECT frame, u, v FROM depth WHERE u % 3 = 0 AND v % 3 = 0")
def f15(spark, d):
    return depth(spark, d).filter("u % 3 = 0 and v % 3 = 0").select("frame", "u", "v")


@query("f16_box_filter", f"WITH {CLOUD}, h AS (SELECT seq, dataset FROM cloud WHERE abs(x - 40) <= 1.25*(0.8*10 + 0.6*8) AND abs(y - 1) <= 3.75 AND abs(z) <= 1.25*(0.6*10 + 0.8*8)) SELECT seq, count(*) OVER (PARTITION BY dataset) >= 500 AS enough FROM h")
def f16(spark, d):
    """Points in the axis box around a turned one: half sides |R| half, times 1.25; `enough` says whether a pack has the 500
    points that a local asset needs."""
    half = [0.8 * 10 + 0.6 * 8, 3.0, 0.6 * 10 + 0.8 * 8]
    near = [F.abs(F.col(c) - m) <= 1.25 * h for c, m, h in zip("xyz", (40, 1, 0), half)]
    hits = cloud(spark, d).filter(near[0] & near[1] & near[2]).select("seq", "dataset")
    n = hits.groupBy("dataset").agg((F.count("*") >= 500).alias("enough"))
    return hits.join(n, "dataset").select("seq", "enough")


@query("f17_cut_out", f"WITH {CLOUD} SELECT seq FROM cloud WHERE NOT (abs(0.8*(x-40) + 0.6*(z-2)) <= 5*1.15+0.02 AND abs(y-1) <= 2*1.15+0.02 AND abs(-0.6*(x-40) + 0.8*(z-2)) <= 3*1.15+0.02)")
def f17(spark, d):
    dx, dy, dz = F.col("x") - 40, F.col("y") - 1, F.col("z") - 2
    local = [(0.8 * dx + 0.6 * dz, 5), (dy, 2), (-0.6 * dx + 0.8 * dz, 3)]
    inside = [F.abs(c) <= h * 1.15 + 0.02 for c, h in local]
    return cloud(spark, d).filter(~(inside[0] & inside[1] & inside[2])).select("seq")


@query("f18_ray_cone", f"WITH {CLOUD}, m AS (SELECT dataset, avg(x) - 10 AS mx, avg(y) - 1.5 AS my, avg(z) + 30 AS mz FROM cloud GROUP BY dataset), c AS (SELECT seq, c.dataset, ((x - 10)*mx + (y - 1.5)*my + (z + 30)*mz)/sqrt(mx*mx + my*my + mz*mz) AS t, (x-10)**2 + (y-1.5)**2 + (z+30)**2 AS d2 FROM cloud c JOIN m ON c.dataset = m.dataset), h AS (SELECT * FROM c WHERE t > 0.3 AND sqrt(greatest(d2 - t*t, 0)) / t < 0.012), n AS (SELECT dataset, count(*) AS n, quantile_cont(t, 0.1) AS lo FROM h GROUP BY dataset), b AS (SELECT h.*, n, t BETWEEN lo - 0.15 AND lo + 0.9 AS near FROM h JOIN n ON h.dataset = n.dataset), k AS (SELECT *, count(*) FILTER (near) OVER (PARTITION BY dataset) AS band FROM b) SELECT seq, {sr('t', 't', 4)}, n >= 20 AS enough FROM k WHERE near OR band < 20")
def f18(spark, d):
    """Points within 0.012 of the ray from the camera to the middle of each pack, nearest depth cluster along the ray where
    that holds 20; `enough` says whether the ray met the 20 points it takes."""
    middle = cloud(spark, d).groupBy("dataset").agg(*[(F.avg(c) - e).alias("m" + c) for c, e in zip("xyz", EYE.values())])
    v, m = g.minus(XYZ, g.lits(EYE.values())), g.vec("m")
    hits = cloud(spark, d).join(middle, "dataset").select("seq", "dataset", (g.dot(v, m) / g.norm(m)).alias("t"), g.dot(v, v).alias("d2")).filter("t > 0.3")
    hits = hits.filter(F.sqrt(F.greatest(F.col("d2") - F.col("t") ** 2, F.lit(0.0))) / F.col("t") < 0.012)
    band = spatial.depth_band(hits, "t", ["dataset"], 0.1, 0.15, 0.9, 20)
    n = hits.groupBy("dataset").agg((F.count("*") >= 20).alias("enough"))
    return band.join(n, "dataset").select("seq", r6(F.col("t"), "t", 4), "enough")


@query("f19_opacity", f"WITH {CLOUD} SELECT seq, {sr('1/(1+exp(-(r-100)/50.0))', 'alpha')} FROM cloud WHERE r IS NOT NULL AND 1/(1+exp(-(r-100)/50.0)) > 0.35")
def f19(spark, d):
    a = 1 / (1 + F.exp(-(F.col("r") - 100) / 50.0))
    return cloud(spark, d).filter(a > 0.35).select("seq", r6(a, "alpha"))


@query("f20_sh_to_rgb", f"WITH {CLOUD} SELECT seq, CAST(floor(least(greatest((x/30)*0.28209479 + 0.5, 0), 1)*255) AS INTEGER) AS red FROM cloud")
def f20(spark, d):
    return cloud(spark, d).select("seq", g.clip_byte(F.least(F.greatest(F.col("x") / 30 * 0.28209479 + 0.5, F.lit(0.0)), F.lit(1.0)) * 255).alias("red"))


@query("f21_sanitize", "SELECT seq, round(max(CASE WHEN x::VARCHAR IN ('nan', 'inf', '-inf') OR x < 0 THEN 0 ELSE x::DOUBLE END), 5) AS x FROM street_pack GROUP BY seq")
def f21(spark, d):
    x = F.col("x").cast("double")
    bad = F.isnan(x) | (F.abs(x) == float("inf")) | (x < 0)
    return table(spark, d, "street_pack").groupBy("seq").agg(F.round(F.max(F.when(bad, 0.0).otherwise(x)), 5).alias("x"))


@query("f23_observers", f"WITH {FRAMES}, {CLOUD}, s AS (SELECT dataset, (min(x) + max(x))/2 AS ox, (min(y) + max(y))/2 AS oy, (min(z) + max(z))/2 AS oz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS extent FROM cloud GROUP BY dataset), f AS (SELECT name, extent, px - ox AS dx, py - oy AS dy, pz - oz AS dz, {RS[2][0]} AS fx, {RS[2][1]} AS fy, {RS[2][2]} AS fz FROM frames JOIN s ON frames.dataset = s.dataset), g AS (SELECT name, extent, sqrt(dx*dx+dy*dy+dz*dz) AS dist, -(fx*dx+fy*dy+fz*dz) AS along FROM f) SELECT name, {sr('dist', 'dist', 3)} FROM g WHERE dist > 0 AND along / dist > 0.85 AND dist < 1.5*extent")
def f23(spark, d):
    """Frames that look at the middle of their scene from no farther than 1.5 times its extent."""
    b = spatial.bounds(cloud(spark, d), ["dataset"])
    scene = b.select("dataset", *[((F.col("lo" + c) + F.col("hi" + c)) / 2).alias("o" + c) for c in "xyz"], F.greatest(*[F.col("hi" + c) - F.col("lo" + c) for c in "xyz"]).alias("extent"))
    away, forward = g.minus(P, g.vec("o")), g.rotation_of(Q)[2]
    o = frames(spark, d).join(scene, "dataset").select("name", "extent", g.norm(away).alias("dist"), (-g.dot(forward, away)).alias("along"))
    return o.filter("dist > 0 and along / dist > 0.85 and dist < 1.5 * extent").select("name", r6(F.col("dist"), "dist", 3))


@query("f25_small_or_thin", f"WITH {OBJECTS} SELECT id, (list_sort([sx, sy, sz])[1]*3.41 < 0.8 OR list_sort([sx, sy, sz])[3]*3.41 < 2.0) AS small FROM obj WHERE sx IS NOT NULL AND sy IS NOT NULL AND sz IS NOT NULL")
def f25(spark, d):
    dims = F.sort_array(F.array("sx", "sy", "sz"))
    return objects(spark, d).dropna(subset=["sx", "sy", "sz"]).select("id", ((dims[0] * 3.41 < 0.8) | (dims[2] * 3.41 < 2.0)).alias("small"))


@query("f26_time_local", f"WITH {FRAMES} SELECT a.name AS name, count(*) AS near FROM frames a JOIN frames b ON a.dataset = b.dataset AND a.cam = b.cam AND a.name <> b.name AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 8000000 GROUP BY a.name")
def f26(spark, d):
    """Frames of the same camera within 8 s; the range join is an equi join on 8-second bins, neighbours included."""
    f = frames(spark, d).select("dataset", "cam", "name", F.unix_micros("ts").alias("t"))
    a = f.withColumn("bin", F.floor(F.col("t") / 8_000_000))
    b = f.select("dataset", "cam", F.col("name").alias("other"), F.col("t").alias("u"), F.explode(F.sequence(F.floor(F.col("t") / 8_000_000) - 1, F.floor(F.col("t") / 8_000_000) + 1)).alias("bin"))
    return a.join(b, ["dataset", "cam", "bin"]).filter("name <> other and abs(t - u) <= 8000000").groupBy("name").agg(F.count("*").alias("near"))


@query("f28_edge_padding", f"WITH {OBJECTS}, p AS (SELECT id, pts::DOUBLE[][] AS c FROM obj WHERE kind = 'rect' AND pts IS NOT NULL), b AS (SELECT id, least(c[1][1], c[2][1]) AS x0, greatest(c[1][1], c[2][1]) AS x1 FROM p) SELECT id, {sr('greatest(4, 0.04*(x1 - x0))', 'pad', 4)} FROM b WHERE x0 >= greatest(4, 0.04*(x1-x0)) AND x1 <= 1024 - greatest(4, 0.04*(x1-x0))")
def f28(spark, d):
    c = F.from_json("pts", "array<array<double>>")
    b = objects(spark, d).filter("kind = 'rect' and pts is not null").select("id", c.alias("c")).select("id", F.least(F.col("c")[0][0], F.col("c")[1][0]).alias("x0"), F.greatest(F.col("c")[0][0], F.col("c")[1][0]).alias("x1"))
    b = b.withColumn("pad", F.greatest(F.lit(4.0), 0.04 * (F.col("x1") - F.col("x0"))))
    return b.filter("x0 >= pad and x1 <= 1024 - pad").select("id", r6(F.col("pad"), "pad", 4))


@query("f36_box_corners", f"WITH {OBJECTS}, s AS (SELECT unnest([-1, 1]) AS k) SELECT id, {sr('cx + 0.8*a.k*sx/2 + 0.6*c.k*sz/2', 'x', 6)}, {sr('cy + b.k*sy/2', 'y', 6)}, {sr('cz - 0.6*a.k*sx/2 + 0.8*c.k*sz/2', 'z', 6)} FROM obj, s a, s b, s c WHERE sx IS NOT NULL")
def f36(spark, d):
    corners = g.box_corners(g.vec("c"), TURN, g.vec("s"))
    return objects(spark, d).filter("sx is not null").select("id", F.explode(corners).alias("k")).select("id", *[r6(F.col(f"k.{c}"), c, 6) for c in "xyz"])


@query("f29_box_in_frame", f"""WITH {OBJECTS}, s AS (SELECT unnest([-1, 1]) AS k), k AS (SELECT id, cx + 0.8*a.k*sx/2 + 0.6*c.k*sz/2 - 10 AS x, cy + b.k*sy/2 - 1.5 AS y, cz - 0.6*a.k*sx/2 + 0.8*c.k*sz/2 + 150 AS z FROM obj, s a, s b, s c WHERE sx IS NOT NULL),
b AS (SELECT id, min(z) AS zmin, min(1183.5*x/z + 612) AS u0, max(1183.5*x/z + 612) AS u1, min(1183.5*y/z + 512) AS v0, max(1183.5*y/z + 512) AS v1 FROM k GROUP BY id),
o AS (SELECT *, greatest(least(u1, 1224) - greatest(u0, 0), 0) * greatest(least(v1, 1024) - greatest(v0, 0), 0) / ((u1 - u0) * (v1 - v0)) AS share FROM b WHERE zmin > 0.001 AND u1 > u0 AND v1 > v0)
SELECT id, {sr('share', 'share', 4)} FROM o WHERE share >= 0.6""")
def f29(spark, d):
    at = g.minus(g.vec("c"), g.lits((10.0, 1.5, -150.0)))
    k = objects(spark, d).filter("sx is not null").select("id", g.box_corners(at, TURN, g.vec("s")).alias("k"))
    u = F.transform("k", lambda p: K["fx"] * p["x"] / p["z"] + K["cx"])
    v = F.transform("k", lambda p: K["fy"] * p["y"] / p["z"] + K["cy"])
    b = k.filter(F.forall("k", lambda p: p["z"] > 1e-3)).select("id", F.array_min(u).alias("u0"), F.array_max(u).alias("u1"), F.array_min(v).alias("v0"), F.array_max(v).alias("v1")).filter("u1 > u0 and v1 > v0")
    inside = lambda lo, hi, size: F.greatest(F.least(F.col(hi), F.lit(float(size))) - F.greatest(F.col(lo), F.lit(0.0)), F.lit(0.0))
    share = inside("u0", "u1", K["w"]) * inside("v0", "v1", K["h"]) / ((F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0")))
    return b.withColumn("share", share).filter("share >= 0.6").select("id", r6(F.col("share"), "share", 4))


@query("f35_generic_label", f"WITH {OBJECTS} SELECT id, (trim(coalesce(label, '')) = '' OR label = '?' OR regexp_matches(label, '^[Rr][0-9]+$')) AS generic FROM obj")
def f35(spark, d):
    label = F.coalesce("label", F.lit(""))
    return objects(spark, d).select("id", ((F.trim(label) == "") | (label == "?") | label.rlike("^[Rr][0-9]+$")).alias("generic"))


@query("f37_camera_axes", f"WITH {FRAMES} SELECT name, {sr(RS[2][0], 'fx')}, {sr(RS[2][1], 'fy')}, {sr(RS[2][2], 'fz')}, {sr('px', 'px', 7)} FROM frames")
def f37(spark, d):
    f = g.rotation_of(Q)[2]
    return frames(spark, d).select("name", *[r6(c, a) for c, a in zip(f, ("fx", "fy", "fz"))], r6(F.col("px"), "px", 7))


# names (X)
@query("x01_capture_time", f"WITH {FRAMES} SELECT name, epoch_us(ts) AS us FROM frames")
def x01(spark, d):
    return frames(spark, d).select("name", F.unix_micros("ts").alias("us"))


@query("x02_seconds_of_day", f"WITH {FRAMES} SELECT name, {sr('extract(hour FROM ts)*3600 + extract(minute FROM ts)*60 + extract(second FROM ts) + (extract(microsecond FROM ts) % 1000000)/1e6', 'sod', 5)} FROM frames")
def x02(spark, d):
    pat = r"_(\d{2})_(\d{2})_(\d{2})_(\d{6})(?:_|\.|$)"
    part = lambda i: F.regexp_extract("name", pat, i).cast("double")
    return frames(spark, d).select("name", r6(part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1e6, "sod", 5))


@query("x03_frame_number", f"WITH {FRAMES} SELECT name, regexp_replace(regexp_replace(name, '[^0-9]', '', 'g'), '^0+', '') AS num FROM frames")
def x03(spark, d):
    return frames(spark, d).select("name", F.coalesce(F.regexp_replace("name", r"\D", ""), F.lit("0")).cast("decimal(38,0)").cast("string").alias("num"))


@query("x04_stem_camera", r"SELECT file_id, regexp_extract(path, '([^/\\]*?)(\.[^./\\]*)?$', 1) AS stem, upper(regexp_extract(path, '([^/\\]*)$', 1)[1]) AS cam FROM street_video")
def x04(spark, d):
    t = table(spark, d, "street_video")
    return t.select("file_id", F.regexp_extract("path", r"([^/\\]*?)(\.[^./\\]*)?$", 1).alias("stem"), F.upper(F.substring(F.regexp_extract("path", r"([^/\\]*)$", 1), 1, 1)).alias("cam"))


@query("x07_safe_name", "SELECT file_id, regexp_replace(path, '[^A-Za-z0-9_-]', '', 'g') AS safe FROM street_video")
def x07(spark, d):
    return table(spark, d, "street_video").select("file_id", F.regexp_replace("path", "[^A-Za-z0-9_-]", "").alias("safe"))


@query("x09_hex_colour", f"WITH {CLOUD} SELECT seq, printf('#%02x%02x%02x', r, g, b) AS hex FROM cloud WHERE r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL")
def x09(spark, d):
    return cloud(spark, d).dropna(subset=["r", "g", "b"]).select("seq", F.format_string("#%02x%02x%02x", "r", "g", "b").alias("hex"))


@query("x10_short_label", f"WITH {FRAMES} SELECT name, substring(name, 15, 8) AS label FROM frames")
def x10(spark, d):
    return frames(spark, d).select("name", F.substring("name", 15, 8).alias("label"))


# vector and rotation mathematics (M)
@query("m01_bearing", f"WITH {FRAMES} SELECT name, {sr('atan2(px, pz)', 'bearing')} FROM frames")
def m01(spark, d):
    return frames(spark, d).select("name", r6(g.bearing(F.col("px"), F.col("pz")), "bearing"))


@query("m02_angle_difference", f"WITH {FRAMES}, a AS (SELECT name, atan2(px, pz) - 3.0 + pi() AS v FROM frames) SELECT name, {sr('abs(v - 2*pi()*floor(v/(2*pi())) - pi())', 'delta')} FROM a")
def m02(spark, d):
    return frames(spark, d).select("name", r6(g.angle_between(g.bearing(F.col("px"), F.col("pz")), F.lit(3.0)), "delta"))


@query("m03_rotation_angle", f"WITH {FRAMES} SELECT name, {sr('acos(least(greatest((' + RS[0][0] + ' + ' + RS[1][1] + ' + ' + RS[2][2] + ' - 1)/2, -1), 1))', 'angle', 4)} FROM frames")
def m03(spark, d):
    return frames(spark, d).select("name", r6(g.angle_of(g.rotation_of(Q)), "angle", 4))


PAIR = f"pair AS (SELECT name, qw, qx, qy, qz, lead(qw) OVER w AS kw, lead(qx) OVER w AS kx, lead(qy) OVER w AS ky, lead(qz) OVER w AS kz FROM frames WINDOW w AS (PARTITION BY dataset, cam ORDER BY ts, name))"
SL = "s AS (SELECT *, qw*kw+qx*kx+qy*ky+qz*kz AS d0 FROM pair WHERE kw IS NOT NULL), t AS (SELECT *, CASE WHEN d0 < 0 THEN -1 ELSE 1 END AS sg, least(abs(d0), 1.0) AS dd FROM s), u AS (SELECT *, CASE WHEN dd > 0.9995 THEN 0.7 ELSE sin(0.7*acos(dd))/sin(acos(dd)) END AS wa, CASE WHEN dd > 0.9995 THEN 0.3 ELSE sin(0.3*acos(dd))/sin(acos(dd)) END AS wb FROM t), v AS (SELECT name, " + ", ".join(f"wa*q{c} + wb*sg*k{c} AS m{c}" for c in "wxyz") + " FROM u)"


def _pairs(spark, d):
    near = temporal.beside(frames(spark, d), ["dataset", "cam"], "ts", ["ts", "name"], {"k" + c: ("q" + c, 1) for c in "wxyz"})
    return near.select("name", *["q" + c for c in "wxyz"], *["k" + c for c in "wxyz"]).filter("kw is not null")


@query("m04_slerp", f"WITH {FRAMES}, {PAIR}, {SL} SELECT name, " + ", ".join(sr(f"m{c}/sqrt(mw*mw+mx*mx+my*my+mz*mz)", f"m{c}", 4) for c in "wxyz") + " FROM v")
def m04(spark, d):
    q = g.slerp(Q, g.vec("k", "wxyz"), F.lit(0.3))
    return _pairs(spark, d).select("name", *[r6(c, f"m{a}", 4) for c, a in zip(q, "wxyz")])


@query("m05_cross_unit", f"WITH {FRAMES}, c AS (SELECT name, pz AS cx, -px AS cz, sqrt(pz*pz + px*px) AS n FROM frames) SELECT name, {sr('cx/n', 'ux')}, {sr('cz/n', 'uz')} FROM c WHERE n > 0")
def m05(spark, d):
    u = g.unit(g.cross(g.lits((0.0, 1.0, 0.0)), P))
    return frames(spark, d).filter(F.hypot("px", "pz") > 0).select("name", r6(u[0], "ux"), r6(u[2], "uz"))


@query("m06_quaternion_product", f"WITH {FRAMES}, {PAIR} SELECT name, {sr('qw*kw - qx*kx - qy*ky - qz*kz', 'w', 5)}, {sr('qw*kx + qx*kw + qy*kz - qz*ky', 'x', 5)} FROM pair WHERE kw IS NOT NULL")
def m06(spark, d):
    p = g.quaternion_product(Q, g.vec("k", "wxyz"))
    return _pairs(spark, d).select("name", r6(p[0], "w", 5), r6(p[1], "x", 5))


@query("m07_sector", f"WITH {FRAMES} SELECT name, CAST(floor((atan2(px, pz) + pi())/(2*pi())*8) AS INTEGER) % 8 AS sector FROM frames")
def m07(spark, d):
    return frames(spark, d).select("name", g.sector(g.bearing(F.col("px"), F.col("pz")), 8).alias("sector"))


@query("m08_yaw_pitch", f"WITH {FRAMES} SELECT name, {sr(f'degrees(atan2({RS[2][0]}, {RS[2][2]}))', 'yaw', 4)}, {sr(f'degrees(asin(least(greatest({RS[2][1]}, -1), 1)))', 'pitch', 4)} FROM frames")
def m08(spark, d):
    f = g.rotation_of(Q)[2]
    return frames(spark, d).select("name", r6(F.degrees(F.atan2(f[0], f[2])), "yaw", 4), r6(F.degrees(F.asin(F.least(F.greatest(f[1], F.lit(-1.0)), F.lit(1.0)))), "pitch", 4))


@query("m09_fov", f"SELECT DISTINCT pack_id, {sr('degrees(2*atan(w/(2*fx)))', 'fov', 5)} FROM poses")
def m09(spark, d):
    return table(spark, d, "poses").select("pack_id", r6(g.fov_degrees(F.col("w"), F.col("fx")), "fov", 5)).distinct()


@query("m11_normal_decode", f"WITH {CLOUD} SELECT seq, {sr('nr/255.0*2 - 1', 'nx')}, CAST(floor((nr/255.0*2 - 1)*127.5 + 127.5 + 0.001) AS INTEGER) AS again FROM cloud WHERE nr IS NOT NULL")
def m11(spark, d):
    nx = F.col("nr") / 255.0 * 2 - 1
    return cloud(spark, d).filter("nr is not null").select("seq", r6(nx, "nx"), F.floor(nx * 127.5 + 127.5 + 0.001).cast("int").alias("again"))


@query("m12_disambiguate_normal", f"""WITH {CLOUD}, c AS (SELECT seq, (nr/127.5 - 1) AS x, (ng/127.5 - 1) AS y, (nb/127.5 - 1) AS z FROM cloud WHERE nr IS NOT NULL AND ng IS NOT NULL AND nb IS NOT NULL),
k AS (SELECT seq, unnest([{{'s': 0.6*x + 0.8*z, 'k': 0}}, {{'s': -0.6*x + 0.8*z, 'k': -1}}, {{'s': 0.6*y + 0.8*z, 'k': -2}}, {{'s': -0.6*y + 0.8*z, 'k': -3}}]) AS o FROM c)
SELECT seq, {sr('max(o.s)', 'best', 5)} FROM k GROUP BY seq""")
def m12(spark, d):
    """Of the four readings of an ambiguous normal the one nearest to the prior (0.6, 0, 0.8)."""
    x, y, z = (F.col(c) / 127.5 - 1 for c in ("nr", "ng", "nb"))
    o = F.array_max(F.array(*[F.struct((0.6 * a + 0.8 * z).alias("s"), F.lit(-k).alias("k")) for k, a in enumerate((x, -x, y, -y))]))
    return cloud(spark, d).dropna(subset=["nr", "ng", "nb"]).select("seq", r6(o["s"], "best", 5))


@query("m13_percentile_stretch", f"WITH {PIXELS}, s AS (SELECT quantile_cont(i0, 0.02) AS lo, quantile_cont(i0, 0.98) AS hi FROM pixels) SELECT px, {sr('least(greatest((i0 - lo)/(hi - lo), 0), 1)', 'v', 5)} FROM pixels, s")
def m13(spark, d):
    px = pixels(spark, d)
    s = px.agg(F.percentile("i0", 0.02).alias("lo"), F.percentile("i0", 0.98).alias("hi"))  # one row
    v = F.least(F.greatest((F.col("i0") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0))
    return px.crossJoin(F.broadcast(s)).select("px", r6(v, "v", 5))


@query("m14_exposure_gain", f"WITH {PIXELS} SELECT px, {sr('least(110/greatest(i0/16, 1e-6), 3)', 'gain', 5)} FROM pixels")
def m14(spark, d):
    return pixels(spark, d).select("px", r6(F.least(110 / F.greatest(F.col("i0") / 16, F.lit(1e-6)), F.lit(3.0)), "gain", 5))


@query("m15_splat_covariance", f"WITH {FRAMES} SELECT name, {sr(' + '.join(f'({RS[0][k]}*{s}*{RS[0][k]}*{s})' for k, s in enumerate((0.5, 0.25, 0.1))), 'c00', 5)}, {sr(' + '.join(f'({RS[0][k]}*{s}*{RS[1][k]}*{s})' for k, s in enumerate((0.5, 0.25, 0.1))), 'c01', 5)} FROM frames")
def m15(spark, d):
    r, s = g.rotation_of(Q), (0.5, 0.25, 0.1)
    cov = lambda i, j: sum((r[i][k] * s[k] * r[j][k] * s[k] for k in range(3)), F.lit(0.0))
    return frames(spark, d).select("name", r6(cov(0, 0), "c00", 5), r6(cov(0, 1), "c01", 5))


@query("m17_voxel_key", f"WITH {CLOUD} SELECT seq, ((CAST(floor(x/0.37) AS BIGINT) + 1048576) << 42) | ((CAST(floor(y/0.37) AS BIGINT) + 1048576) << 21) | (CAST(floor(z/0.37) AS BIGINT) + 1048576) AS key FROM cloud")
def m17(spark, d):
    return cloud(spark, d).select("seq", g.voxel_key(XYZ, 0.37).alias("key"))


@query("m10_triangulate", f"""WITH {FRAMES}, p AS (SELECT name, px, pz, {RS[2][0]} AS dx, {RS[2][2]} AS dz, lead(px) OVER w AS ex, lead(pz) OVER w AS ez FROM frames WINDOW w AS (PARTITION BY dataset, cam ORDER BY ts, name)),
s AS (SELECT *, 0.28*dx - 0.96*dz AS gx, 0.96*dx + 0.28*dz AS gz FROM p WHERE ex IS NOT NULL), t AS (SELECT *, dx*gz - dz*gx AS det FROM s)
SELECT name, {sr('px + ((ex - px)*gz - (ez - pz)*gx)/det*dx', 'x', 3)}, {sr('pz + ((ex - px)*gz - (ez - pz)*gx)/det*dz', 'z', 3)} FROM t WHERE abs(det) > 0.2""")
def m10(spark, d):
    """Where the ray of a frame and a turned ray of the next one cross in plan; null where they are nearly parallel."""
    f = g.rotation_of(Q)[2]
    near = temporal.beside(frames(spark, d), ["dataset", "cam"], "ts", ["ts", "name"], {"ex": ("px", 1), "ez": ("pz", 1)})
    s = near.select("name", "px", "pz", f[0].alias("dx"), f[2].alias("dz"), "ex", "ez").filter("ex is not null")
    s = s.withColumn("gx", 0.28 * F.col("dx") - 0.96 * F.col("dz")).withColumn("gz", 0.96 * F.col("dx") + 0.28 * F.col("dz")).withColumn("det", F.expr("dx*gz - dz*gx")).filter("abs(det) > 0.2")
    t = F.expr("((ex - px)*gz - (ez - pz)*gx)/det")
    return s.select("name", r6(F.col("px") + t * F.col("dx"), "x", 3), r6(F.col("pz") + t * F.col("dz"), "z", 3))


QUERIES, ORACLES = query.queries, query.oracles
