"""Polarization algebra (P), mesh and graph operators (A30-A33, J21, G13-G17), map building (G22)."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.functions import polar
from orrery.operators import mesh, spatial, temporal
from orrery.plans.binding import CLOUD, DEPTH, FACES, FRAMES, OBJECTS, PIXELS, VERTICES, cloud, depth, faces, frames, objects, pixels, vertices
from orrery.plans.projections import UNP, UNPROJECT, r6, sr, unprojected
from orrery.plans.registry import Registry
from orrery.session import materialize

query = Registry()
ST = f"{PIXELS}, st AS (SELECT px, i0, i90, i0 + i90 AS s0, i0 - i90 AS s1, i45 - i135 AS s2 FROM pixels), d AS (SELECT *, least(greatest(sqrt(s1*s1 + s2*s2)/greatest(s0, 1e-9), 0), 1) AS dolp, 0.5*atan2(s2, s1) AS theta FROM st), a AS (SELECT *, CASE WHEN theta < 0 THEN theta + pi() ELSE theta END AS aolp FROM d)"


def stokes(spark, d):
    s = polar.stokes(*[F.col(c) for c in ("i0", "i45", "i90", "i135")])
    st = pixels(spark, d).select("px", "i0", "i90", *[c.alias(n) for c, n in zip(s, ("s0", "s1", "s2"))])
    return st.withColumn("dolp", polar.dolp(F.col("s0"), F.col("s1"), F.col("s2"))).withColumn("aolp", polar.aolp(F.col("s1"), F.col("s2")))


@query("pol_02_stokes", f"WITH {ST} SELECT px, {sr('s0', 's0', 4)}, {sr('s1', 's1', 4)}, {sr('s2', 's2', 4)} FROM st")
def pol02(spark, d):
    return stokes(spark, d).select("px", *[r6(F.col(c), c, 4) for c in ("s0", "s1", "s2")])


@query("pol_03_dolp", f"WITH {ST} SELECT px, {sr('dolp', 'dolp')}, {sr('least(greatest((sqrt(s1*s1 + s2*s2)/greatest(s0, 1e-9) - 0.02)*1.5, 0), 1)', 'gained')} FROM d")
def pol03(spark, d):
    return stokes(spark, d).select("px", r6(F.col("dolp"), "dolp"), r6(polar.dolp(F.col("s0"), F.col("s1"), F.col("s2"), 0.02, 1.5), "gained"))


@query("pol_04_aolp", f"WITH {ST} SELECT px, {sr('theta', 'theta', 5)}, CAST(floor(aolp/pi()*255) AS BIGINT) AS shown FROM a WHERE abs(s2) > 1e-6")
def pol04(spark, d):
    return stokes(spark, d).filter("abs(s2) > 1e-6").select("px", r6(polar.theta(F.col("s1"), F.col("s2")), "theta", 5), F.floor(F.col("aolp") / math.pi * 255).alias("shown"))


@query("pol_05_colour", f"WITH {ST}, w AS (SELECT avg(i0) AS m0, avg(i90) AS m1, quantile_cont(s0, 0.995) AS top FROM st) SELECT px, {sr('pow(least(greatest(i0*((m0 + m1)/2/m0)/top, 0), 1), 1/1.8)', 'v', 5)} FROM st, w")
def pol05(spark, d):
    st = stokes(spark, d)
    w = st.agg(F.avg("i0").alias("m0"), F.avg("i90").alias("m1"), F.percentile("s0", 0.995).alias("top"))  # one row
    return st.crossJoin(F.broadcast(w)).select("px", r6(polar.gamma(F.col("i0") * ((F.col("m0") + F.col("m1")) / 2 / F.col("m0")) / F.col("top")), "v", 5))


@query("pol_06_fixed_colour", f"WITH {ST} SELECT px, {sr('(1.6*i0 - 0.4*i90)*greatest(1 - 0.8*dolp, 0.35)', 'v', 3)} FROM d")
def pol06(spark, d):
    return stokes(spark, d).select("px", r6((1.6 * F.col("i0") - 0.4 * F.col("i90")) * polar.attenuation(F.col("dolp")), "v", 3))


@query("pol_07_deglare", f"WITH {ST} SELECT px, {sr('s0*greatest(1 - 0.8*dolp, 0.35)', 'deglared', 4)}, {sr('s0*(1 - greatest(1 - 0.8*dolp, 0.35))', 'glare', 4)} FROM d")
def pol07(spark, d):
    k = polar.attenuation(F.col("dolp"))
    return stokes(spark, d).select("px", r6(F.col("s0") * k, "deglared", 4), r6(F.col("s0") * (1 - k), "glare", 4))


PN = "n AS (SELECT *, least(greatest(dolp/0.05, 0), 1)*(pi()/2)*0.9 AS tilt FROM a)"


@query("pol_08_pseudo_normals", f"WITH {ST}, {PN} SELECT px, {sr('sin(tilt)*cos(aolp)', 'nx', 5)}, {sr('cos(tilt)', 'nz', 5)} FROM n")
def pol08(spark, d):
    n = polar.pseudo_normal(F.col("dolp"), F.col("aolp"))
    return stokes(spark, d).select("px", r6(n[0], "nx", 5), r6(n[2], "nz", 5))


def fres(z):
    return f"(1.5 - 1/1.5)**2*sin({z})**2/(2 + 2*1.5*1.5 - (1.5 + 1/1.5)**2*sin({z})**2 + 4*cos({z})*sqrt(1.5*1.5 - sin({z})**2))"


@query("pol_09_physical_normals", f"WITH {ST}, lut AS (SELECT i, {fres('(i/900.0*(pi()/2))')} AS v FROM range(901) AS t(i)), q AS (SELECT px, least(dolp, 0.38) AS d FROM a), k AS (SELECT DISTINCT d FROM q), c AS (SELECT d, (SELECT count(*) FROM lut WHERE v < d) AS n FROM k) SELECT q.px, {sr('cos(least(c.n, 900)/900.0*(pi()/2))', 'nz', 5)} FROM q JOIN c ON q.d = c.d")
def pol09(spark, d):
    z = polar.zenith_of(F.least(F.col("dolp"), F.lit(0.38)))
    return stokes(spark, d).select("px", r6(F.cos(z), "nz", 5))


@query("pol_10_fresnel_forms", f"WITH {ST} SELECT px, {sr(fres('(dolp*1.5)'), 'diffuse')}, {sr('2*sin(dolp*1.2)**2*cos(dolp*1.2)*sqrt(2.25 - sin(dolp*1.2)**2)/(2.25 - sin(dolp*1.2)**2 - 2.25*sin(dolp*1.2)**2 + 2*sin(dolp*1.2)**4)', 'specular', 5)} FROM d WHERE dolp < 0.5")
def pol10(spark, d):
    return stokes(spark, d).filter("dolp < 0.5").select("px", r6(polar.fresnel_diffuse(F.col("dolp") * 1.5), "diffuse"), r6(polar.fresnel_specular(F.col("dolp") * 1.2), "specular", 5))


@query("pol_11_encode_normal", f"WITH {ST}, {PN} SELECT px, CAST(floor(least(greatest(abs(cos(tilt))*0.5 + 0.5, 0), 1)*255) AS INTEGER) AS blue, CAST(floor(least(greatest(sin(tilt)*cos(aolp)*0.5 + 0.5, 0), 1)*255 + 1e-6) AS INTEGER) AS red FROM n")
def pol11(spark, d):
    n = polar.pseudo_normal(F.col("dolp"), F.col("aolp"))
    return stokes(spark, d).select("px", polar.encode_normal(n)[0].alias("blue"), F.floor(polar.clip(n[0] * 0.5 + 0.5) * 255 + 1e-6).cast("int").alias("red"))


@query("pol_12_hsv_view", f"WITH {ST}, h AS (SELECT px, dolp, (5 + aolp/pi()*6) - 6*floor((5 + aolp/pi()*6)/6) AS k FROM a WHERE abs(s2) > 1e-6) SELECT px, {sr('1 - dolp*greatest(0, least(least(k, 4 - k), 1))', 'red', 5)} FROM h")
def pol12(spark, d):
    red = polar.hsv(F.col("aolp") / math.pi, F.col("dolp"), F.lit(1.0))[0]
    return stokes(spark, d).filter("abs(s2) > 1e-6").select("px", r6(red, "red", 5))


# ---- meshes and graphs
@query("j21_adjacency", f"WITH {FACES}, e AS (SELECT fid, least(a, b) AS u, greatest(a, b) AS v FROM faces UNION ALL SELECT fid, least(b, c), greatest(b, c) FROM faces UNION ALL SELECT fid, least(c, a), greatest(c, a) FROM faces) SELECT x.fid AS f, y.fid AS g, x.u, x.v FROM e x JOIN e y ON x.u = y.u AND x.v = y.v AND x.fid < y.fid")
def j21(spark, d):
    return mesh.adjacency(faces(spark, d))


NORM = f"""{FACES}, {VERTICES}, p AS (SELECT f.fid, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, c.x - a.x AS vx, c.y - a.y AS vy, c.z - a.z AS vz FROM faces f JOIN vertices a ON f.a = a.v JOIN vertices b ON f.b = b.v JOIN vertices c ON f.c = c.v),
m AS (SELECT fid, uy*vz - uz*vy AS x, uz*vx - ux*vz AS y, ux*vy - uy*vx AS z FROM p), fn AS (SELECT fid, x/sqrt(x*x+y*y+z*z) AS nx, y/sqrt(x*x+y*y+z*z) AS ny, z/sqrt(x*x+y*y+z*z) AS nz, sqrt(x*x+y*y+z*z)/2 AS area FROM m WHERE x*x+y*y+z*z > 0)"""
ADJ = "e AS (SELECT fid, least(a, b) AS u, greatest(a, b) AS v FROM faces UNION ALL SELECT fid, least(b, c), greatest(b, c) FROM faces UNION ALL SELECT fid, least(c, a), greatest(c, a) FROM faces), adj AS (SELECT x.fid AS f, y.fid AS g FROM e x JOIN e y ON x.u = y.u AND x.v = y.v AND x.fid < y.fid), fc AS (SELECT adj.f, adj.g, p.nx*q.nx + p.ny*q.ny + p.nz*q.nz AS cos FROM adj JOIN fn p ON adj.f = p.fid JOIN fn q ON adj.g = q.fid)"


def normals(spark, d):
    return mesh.face_normals(faces(spark, d), vertices(spark, d))


@query("g14_creases", f"WITH {NORM}, {ADJ} SELECT f, g, {sr('cos', 'cos', 5)} FROM fc WHERE cos < cos(radians(35))")
def g14(spark, d):
    """Edges with a dihedral angle above 35 degrees (G14's predicate; F33 tests the sign the same way)."""
    return mesh.facing(mesh.adjacency(faces(spark, d)), normals(spark, d)).filter(F.col("cos") < math.cos(math.radians(35))).select("f", "g", r6(F.col("cos"), "cos", 5))


@query("g14_crease_edges", f"WITH {NORM}, e AS (SELECT fid, least(a, b) AS u, greatest(a, b) AS v FROM faces UNION ALL SELECT fid, least(b, c), greatest(b, c) FROM faces UNION ALL SELECT fid, least(c, a), greatest(c, a) FROM faces), n AS (SELECT u, v, count(*) AS k, min(fid) AS f, max(fid) AS g FROM e GROUP BY 1, 2), t AS (SELECT n.u, n.v, round(degrees(acos(least(greatest(p.nx*q.nx + p.ny*q.ny + p.nz*q.nz, -1), 1))), 6) AS angle FROM n JOIN fn p ON p.fid = n.f JOIN fn q ON q.fid = n.g WHERE k = 2), lim AS (SELECT CASE WHEN count(*) FILTER (angle > 35) < 300 THEN greatest(12, quantile_cont(angle, 0.97)) ELSE 35 END AS lim FROM t) SELECT u, v, angle FROM t, lim WHERE angle > lim UNION ALL SELECT u, v, NULL FROM n WHERE k = 1")
def g14e(spark, d):
    """Crease edges of the mesh: borders, and edges with an angle above 35 degrees or, where these are fewer than 300, above
    the 97th percentile of all angles, 12 degrees at least."""
    e = mesh.edges_of(faces(spark, d)).groupBy("u", "v").agg(F.count("*").alias("k"), F.min("fid").alias("f"), F.max("fid").alias("g"))
    e = materialize(e, "edges")
    cos = mesh.facing(e.filter("k = 2"), normals(spark, d))
    t = materialize(cos.select("u", "v", F.round(F.degrees(F.acos(F.least(F.greatest("cos", F.lit(-1.0)), F.lit(1.0)))), 6).alias("angle")), "angles")
    usual = spatial.quantiles(t, [], {"p97": ("angle", 0.97)})
    lim = t.agg(F.count(F.when(F.col("angle") > 35, 1)).alias("n")).crossJoin(usual).select(F.when(F.col("n") < 300, F.greatest(F.lit(12.0), "p97")).otherwise(35.0).alias("lim"))  # one row
    sharp = t.crossJoin(F.broadcast(lim)).filter("angle > lim").select("u", "v", "angle")
    return sharp.unionByName(e.filter("k = 1").select("u", "v", F.lit(None).cast("double").alias("angle")))


@query("f33_contour_edges", f"WITH {NORM}, {ADJ} SELECT adj.f, adj.g FROM adj JOIN fn p ON adj.f = p.fid JOIN fn q ON adj.g = q.fid WHERE (0.6*p.nx + 0.2*p.nz > 0) <> (0.6*q.nx + 0.2*q.nz > 0)")
def f33(spark, d):
    side = normals(spark, d).select("fid", (0.6 * F.col("nx") + 0.2 * F.col("nz") > 0).alias("front"))
    adj = mesh.adjacency(faces(spark, d))
    both = adj.join(side.select(F.col("fid").alias("f"), F.col("front").alias("p")), "f").join(side.select(F.col("fid").alias("g"), F.col("front").alias("q")), "g")
    return both.filter("p <> q").select("f", "g")




BANDS = f"{FACES}, band AS (SELECT fid, ((fid // 2) // 50 + 3) // 7 AS b FROM faces), n AS (SELECT min(fid) AS component, count(*) AS n FROM band GROUP BY b)"


@query("a30_components", f"WITH {BANDS} SELECT component, n, CAST(row_number() OVER (ORDER BY n DESC, component) AS INTEGER) AS rank FROM n WHERE n >= 0.02 * (SELECT sum(n) FROM n)")
def a30(spark, d):
    """Connected parts of the mesh; parts of at least 2 % of the faces are kept, largest first (O11)."""
    f = faces(spark, d)
    return mesh.large_components(mesh.components(f, mesh.adjacency(f), "fid", ("f", "g")), 0.02)


@query("g13_checks", f"WITH {FACES} SELECT count(*) AS n_faces, 0 AS crossed, 0 AS not_least FROM faces")
def g13c(spark, d):
    """Regions hold all faces, no smooth edge leads out of one, and each is named after its least face."""
    f, r = faces(spark, d), materialize(g13(spark, d), "regions")
    smooth = mesh.facing(mesh.adjacency(f), normals(spark, d)).filter(F.col("cos") > math.cos(math.radians(30))).select("f", "g")
    one, two = r.select(F.col("fid").alias("f"), F.col("component").alias("p")), r.select(F.col("fid").alias("g"), F.col("component").alias("q"))
    crossed = smooth.join(one, "f").join(two, "g").agg(F.count(F.when(F.col("p") != F.col("q"), 1)).alias("crossed"))
    least = r.groupBy("component").agg(F.min("fid").alias("low")).agg(F.count(F.when(F.col("low") != F.col("component"), 1)).alias("not_least"))
    return r.agg(F.count("*").alias("n_faces")).crossJoin(crossed).crossJoin(least)  # one row each


@query("a31_checks", f"WITH {FACES} SELECT count(*) AS n_faces, 0 AS torn, true AS fewer FROM faces")
def a31c(spark, d):
    """Merging keeps all faces, puts whole regions together, and leaves no more segments than there were."""
    before = materialize(g13(spark, d), "regions")
    after = mesh.merge_small(before, mesh.adjacency(faces(spark, d)), "fid", 0.012)
    both = materialize(before.join(after.select("fid", F.col("component").alias("into")), "fid"), "merged")
    torn = both.groupBy("component").agg(F.count_distinct("into").alias("k")).agg(F.count(F.when(F.col("k") > 1, 1)).alias("torn"))
    n = both.agg(F.count("*").alias("n_faces"), (F.count_distinct("into") <= F.count_distinct("component")).alias("fewer"))
    return n.crossJoin(torn)  # one row each


@query("g13_region_growing")
def g13(spark, d):
    """Regions of faces whose dihedral angles stay below 30 degrees: components of the filtered edges."""
    f = faces(spark, d)
    smooth = mesh.facing(mesh.adjacency(f), normals(spark, d)).filter(F.col("cos") > math.cos(math.radians(30)))
    return mesh.components(f, smooth, "fid", ("f", "g"))


@query("a31_segment_merge")
def a31(spark, d):
    f = faces(spark, d)
    return mesh.merge_small(g13(spark, d), mesh.adjacency(f), "fid", 0.012)


EXPL = f"{NORM}, s AS (SELECT f.fid, CAST(f.a % 7 AS BIGINT) AS seg, (a.x + b.x + c.x)/3 AS x, (a.y + b.y + c.y)/3 AS y FROM faces f JOIN vertices a ON f.a = a.v JOIN vertices b ON f.b = b.v JOIN vertices c ON f.c = c.v), c AS (SELECT seg, avg(x) AS cx, avg(y) AS cy FROM s GROUP BY seg), t AS (SELECT avg(x) AS tx, avg(y) AS ty FROM s)"


@query("a32_explode_segments", f"WITH {EXPL} SELECT seg, {sr('(cx - tx)/sqrt((cx-tx)**2 + (cy-ty)**2)*0.16', 'dx', 4)} FROM c, t WHERE (cx-tx)**2 + (cy-ty)**2 > 1e-12")
def a32(spark, d):
    f, v = faces(spark, d), vertices(spark, d)
    joined = f
    for p in "abc":
        joined = joined.join(v.select(F.col("v").alias(p), F.col("x").alias(p + "x"), F.col("y").alias(p + "y")), p)
    s = joined.select((F.col("a") % 7).alias("seg"), ((F.col("ax") + F.col("bx") + F.col("cx")) / 3).alias("x"), ((F.col("ay") + F.col("by") + F.col("cy")) / 3).alias("y"))
    c, t = s.groupBy("seg").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")), s.agg(F.avg("x").alias("tx"), F.avg("y").alias("ty"))
    away = c.crossJoin(F.broadcast(t)).withColumn("r", F.hypot(F.col("cx") - F.col("tx"), F.col("cy") - F.col("ty"))).filter("r*r > 1e-12")
    return away.select("seg", r6((F.col("cx") - F.col("tx")) / F.col("r") * 0.16, "dx", 4))


@query("a33_majority", f"WITH {FACES}, v AS (SELECT fid, a % 3 AS s FROM faces UNION ALL SELECT fid, b % 3 FROM faces UNION ALL SELECT fid, c % 3 FROM faces), n AS (SELECT fid, s, count(*) AS n FROM v GROUP BY 1, 2) SELECT fid, arg_min(s, -n*10 + s) AS s FROM n GROUP BY fid")
def a33(spark, d):
    votes = faces(spark, d).select("fid", F.explode(F.array(F.col("a") % 3, F.col("b") % 3, F.col("c") % 3)).alias("s"))
    return mesh.majority(votes, "fid", "s")


@query("g16_cut_geometry", f"WITH {FACES} SELECT fid, unnest([0, 1, 2]) AS corner, unnest([a, b, c]) AS v FROM faces")
def g16(spark, d):
    return faces(spark, d).select("fid", F.posexplode(F.array("a", "b", "c")).alias("corner", "v"))


@query("g17_floor_grid", f"WITH {CLOUD}, b AS (SELECT dataset, CAST(floor(min(x)/5) AS BIGINT) AS lo, CAST(floor(max(x)/5) AS BIGINT) AS hi FROM cloud GROUP BY dataset) SELECT dataset, unnest(range(lo, hi + 1))*5 AS x FROM b")
def g17(spark, d):
    b = cloud(spark, d).groupBy("dataset").agg(F.floor(F.min("x") / 5).alias("lo"), F.floor(F.max("x") / 5).alias("hi"))
    return b.select("dataset", F.explode(F.sequence("lo", "hi")).alias("i")).select("dataset", (F.col("i") * 5).alias("x"))


# ---- map building
MAP = f"WITH {DEPTH}, {UNPROJECT}, w AS (SELECT rays.frame, rays.u, rays.v, rays.z, {UNP[0]} + rays.frame/10.0 AS x, {UNP[1]} AS y, {UNP[2]} AS wz FROM rays WHERE rays.z > 0.02 AND rays.z < 15 AND rays.conf >= 40 AND sqrt((rays.u - 32)**2 + (rays.v - 24)**2) < 0.85*40)"
COARSE = "floor(x/0.51), floor(y/0.51), floor(wz/0.51)"


def map_points(spark, d):
    """Depth pixels of all frames as world points, one per fine voxel, nearest views only (G22, G23, A01-A03)."""
    px = unprojected(spark, d).filter("z > 0.02 and z < 15 and conf >= 40").filter(F.hypot(F.col("u") - 32, F.col("v") - 24) < 0.85 * 40)
    pts = px.select("frame", "u", "v", "z", F.col("wx").alias("x"), F.col("wy").alias("y"), F.col("wz"))
    return spatial.near_views(pts.select("frame", "u", "v", F.col("z").alias("depth"), "x", "y", F.col("wz").alias("z")), 0.51, "depth")


@query("g22_map_from_depth", MAP + f", k AS (SELECT *, min(z) OVER (PARTITION BY {COARSE}) AS zmin FROM w), n AS (SELECT * FROM k WHERE z <= greatest(1.6*zmin, zmin + 0.15)) SELECT min(frame*10000 + u*100 + v) AS seq FROM n GROUP BY floor(x/0.17), floor(y/0.17), floor(wz/0.17)")
def g22(spark, d):
    near = map_points(spark, d).withColumn("seq", F.col("frame") * 10000 + F.col("u") * 100 + F.col("v"))
    return spatial.first_per_voxel(near.select("seq", "x", "y", "z"), 0.17).select("seq")


@query("g26_up_axis", f"WITH {FRAMES} SELECT dataset, {sr('median(2*(qx*qy - qw*qz))', 'ux', 5)}, {sr('median(1 - 2*(qx*qx + qz*qz))', 'uy', 5)} FROM frames GROUP BY dataset")
def g26(spark, d):
    r = g.rotation_of(g.vec("q", "wxyz"))
    return frames(spark, d).groupBy("dataset").agg(r6(F.median(r[0][1]), "ux", 5), r6(F.median(r[1][1]), "uy", 5))


@query("g27_looking", f"WITH {FRAMES}, s AS (SELECT dataset, cam, 2*(qx*qz - qw*qy) AS fx, 1 - 2*(qx*qx + qy*qy) AS fz, lead(px) OVER w - lag(px) OVER w AS dx, lead(pz) OVER w - lag(pz) OVER w AS dz FROM frames WINDOW w AS (PARTITION BY dataset, cam ORDER BY ts, name)), m AS (SELECT dataset, cam, median((fx*dx + fz*dz)/sqrt(dx*dx + dz*dz)) AS v FROM s WHERE dx*dx + dz*dz > 0.0625 GROUP BY 1, 2) SELECT dataset, cam, CASE WHEN v > 0.5 THEN 'forward' WHEN v < -0.5 THEN 'back' ELSE 'side' END AS looks FROM m WHERE abs(abs(v) - 0.5) > 1e-6")
def g27(spark, d):
    """Which way a camera looks: its viewing direction against the direction that it moves in."""
    near = temporal.beside(frames(spark, d), ["dataset", "cam"], "ts", ["ts", "name"], {f"{n}_{c}": (c, o) for c in ("px", "pz") for n, o in (("after", 1), ("before", -1))})
    f = g.rotation_of(g.vec("q", "wxyz"))[2]
    s = near.select("dataset", "cam", f[0].alias("fx"), f[2].alias("fz"), *[(F.col("after_" + c) - F.col("before_" + c)).alias(n) for c, n in (("px", "dx"), ("pz", "dz"))])
    m = s.filter("dx*dx + dz*dz > 0.0625").groupBy("dataset", "cam").agg(F.median(F.expr("(fx*dx + fz*dz)/sqrt(dx*dx + dz*dz)")).alias("v"))
    return m.filter("abs(abs(v) - 0.5) > 1e-6").select("dataset", "cam", F.when(F.col("v") > 0.5, "forward").when(F.col("v") < -0.5, "back").otherwise("side").alias("looks"))


@query("g28_depth_write", f"WITH {DEPTH} SELECT frame, u, v, CASE WHEN z*1.1 >= 65.535 OR z <= 0 THEN 0 ELSE CAST(floor(z*1.1*1000 + 1e-6) AS BIGINT) END AS d FROM depth")
def g28(spark, d):
    scaled = F.col("z") * 1.1
    return depth(spark, d).select("frame", "u", "v", F.when((scaled >= 65.535) | (F.col("z") <= 0), F.lit(0)).otherwise(F.floor(scaled * 1000 + 1e-6)).alias("d"))


@query("g18_view_crop", f"WITH {OBJECTS}, p AS (SELECT id, pts::DOUBLE[][] AS c FROM obj WHERE kind = 'rect' AND pts IS NOT NULL), b AS (SELECT id, least(c[1][1], c[2][1]) AS x0, greatest(c[1][1], c[2][1]) AS x1 FROM p) SELECT id, {sr('greatest(x0 - 0.12*(x1 - x0), 0)', 'left', 4)}, {sr('least(560/((x1 - x0)*1.24), 1)', 'scale', 4)} FROM b WHERE x1 > x0")
def g18(spark, d):
    c = F.from_json("pts", "array<array<double>>")
    b = objects(spark, d).filter("kind = 'rect' and pts is not null").select("id", c.alias("c")).select("id", F.least(F.col("c")[0][0], F.col("c")[1][0]).alias("x0"), F.greatest(F.col("c")[0][0], F.col("c")[1][0]).alias("x1")).filter("x1 > x0")
    size = F.col("x1") - F.col("x0")
    return b.select("id", r6(F.greatest(F.col("x0") - 0.12 * size, F.lit(0.0)), "left", 4), r6(F.least(560 / (size * 1.24), F.lit(1.0)), "scale", 4))


QUERIES, ORACLES = query.queries, query.oracles
