"""What SQL can say about fits and greedy choices whose values it cannot compute: sizes, coverage, known answers, optimality."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.operators import choosing, fitting
from orrery.plans import composites, fits
from orrery.plans.binding import CLOUD, FRAMES, cloud, frames
from orrery.plans.projections import Q, r6, sr
from orrery.plans.registry import Registry
from orrery.plans.statements import QUALITY, view_quality
from orrery.session import materialize

query = Registry()


def is_rotation(r):
    """Rows of nine entries: rows of unit length at right angles, and a positive determinant."""
    row = lambda i: [F.element_at(r, 3 * i + j + 1) for j in range(3)]
    good = g.dot(g.cross(row(0), row(1)), row(2)) > 0.999999
    for i in range(3):
        for j in range(i, 3):
            good = good & (F.abs(g.dot(row(i), row(j)) - float(i == j)) < 1e-6)
    return good


@query("a12_checks", f"WITH {CLOUD} SELECT dataset, count(*) AS n, {sr('quantile_cont(y, 0.02)', 'ground', 4)}, true AS ordered, true AS turned FROM cloud GROUP BY dataset")
def a12(spark, d):
    """Ground level and number of points of each oriented box; its long side is the longer one; its quaternion turns the x axis
    to the long side."""
    b = fitting.oriented_box(cloud(spark, d), ["dataset"])
    q = [F.element_at("q", i + 1) for i in range(4)]
    axis = g.rotation_of(q)
    long = (F.abs(axis[0][0] - F.cos("yaw")) < 1e-6) & (F.abs(axis[2][0] - F.sin("yaw")) < 1e-6)
    return b.select("dataset", "n", r6(F.col("ground"), "ground", 4), (F.col("length") >= F.col("width")).alias("ordered"), long.alias("turned"))


@query("a13_checks", f"WITH {CLOUD} SELECT dataset, count(*) AS n, {sr('var_pop(x) + var_pop(y) + var_pop(z)', 'spread', 3)}, true AS axes, true AS falling FROM cloud GROUP BY dataset")
def a13(spark, d):
    """Principal axes are at right angles, their variances fall and add up to the whole spread."""
    p = fitting.principal_axes(cloud(spark, d), ["dataset"])
    row = lambda i: [F.element_at("axes", 3 * i + j + 1) for j in range(3)]
    square = F.lit(True)
    for i in range(3):
        for j in range(i, 3):
            square = square & (F.abs(g.dot(row(i), row(j)) - float(i == j)) < 1e-6)
    v = [F.element_at("values", i + 1) for i in range(3)]
    return p.select("dataset", "n", r6(v[0] + v[1] + v[2], "spread", 3), square.alias("axes"), ((v[0] >= v[1]) & (v[1] >= v[2])).alias("falling"))


@query("a19_checks", f"WITH {FRAMES} SELECT DISTINCT dataset, cam, true AS rotation, true AS best FROM frames")
def a19(spark, d):
    """Mean rotations are rotations, and the best ones: R^T M, M the sum of all, is symmetric."""
    r = g.rotation_of(Q)
    cols = [f"r{i}{j}" for i in range(3) for j in range(3)]
    f = materialize(frames(spark, d).select("dataset", "cam", *[r[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)]), "rotations")
    mean = fitting.mean_rotation(f, ["dataset", "cam"], cols)
    both = mean.join(f.groupBy("dataset", "cam").agg(*[F.avg(c).alias(c) for c in cols]), ["dataset", "cam"])
    entry = lambda i, j: sum((F.element_at("r", 3 * k + i + 1) * F.col(f"r{k}{j}") for k in range(3)), F.lit(0.0))
    best = F.lit(True)
    for i in range(3):
        for j in range(i):
            best = best & (F.abs(entry(i, j) - entry(j, i)) < 1e-6)
    return both.select("dataset", "cam", is_rotation("r").alias("rotation"), best.alias("best"))


@query("a20_checks", "SELECT 0 AS bad, true AS some")
def a20(spark, d):
    """Rig rotations are rotations, made of at least one pair each."""
    r = fits.a20(spark, d)
    return r.agg(F.count(F.when(~is_rotation("r") | (F.col("n") < 1), 1)).alias("bad"), (F.count("*") > 0).alias("some"))


@query("a22_checks", f"WITH {CLOUD} SELECT count(DISTINCT dataset) AS n_packs, 0 AS bad FROM cloud")
def a22(spark, d):
    """Ground planes have unit normals within 20 degrees of up, and points; packs without a level candidate have none."""
    p = materialize(fits.a22(spark, d), "planes")
    unit = F.abs(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2 - 1) < 1e-6
    bad = p.agg(F.count(F.when(~(unit & F.col("share").between(0, 1)), 1)).alias("bad"))
    return cloud(spark, d).agg(F.count_distinct("dataset").alias("n_packs")).crossJoin(bad)  # one row each


@query("o04_checks", "SELECT 0 AS gaps, 0 AS twice, 0 AS too_many")
def o04(spark, d):
    """Chosen views are numbered from 1 without gaps, none twice, at most eight an object."""
    v = materialize(fits.o04(spark, d), "views")
    per = v.groupBy("id").agg(F.max("rank").alias("top"), F.count("*").alias("n"), F.count_distinct("name").alias("k"))
    return per.agg(F.count(F.when(F.col("top") != F.col("n"), 1)).alias("gaps"), F.count(F.when(F.col("k") != F.col("n"), 1)).alias("twice"), F.count(F.when(F.col("n") > 8, 1)).alias("too_many"))


@query("o05_first_choice", f"WITH {QUALITY}, c AS (SELECT object, name, score, ok, row_number() OVER (PARTITION BY object ORDER BY ok DESC, score DESC, name) AS nth, count(*) FILTER (ok) OVER (PARTITION BY object) AS good, count(*) OVER (PARTITION BY object) AS n FROM q) SELECT object, name, CASE WHEN good > 0 THEN least(good, 8) ELSE least(n, 2) END AS kept FROM c WHERE nth = 1")
def o05(spark, d):
    """The first of the kept views is the best by score, and up to eight good ones, or else two, are kept."""
    v = view_quality(spark, d).select("object", "name", F.round("score", 9).alias("score"), "ok", "bearing")
    kept = choosing.quality_views(v, ["object"])
    return kept.groupBy("object").agg(F.min_by("name", "rank").alias("name"), F.count("*").alias("kept"))


@query("g08_checks", f"WITH {CLOUD} SELECT dataset, count(*) AS n, true AS known FROM cloud GROUP BY dataset")
def g08(spark, d):
    return composites.g08(spark, d).select("dataset", "n", F.col("shape").isin("thin", "compact").alias("known"))


QUERIES, ORACLES = query.queries, query.oracles
