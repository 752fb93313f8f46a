"""The tables as the domain sees them, in Spark and in SQL: cloud, frames, depth pixels, samples, objects, jobs, mesh.

Every view reads its whole table. `depth` folds lineitem into 64 pictures of 64 x 48 places (smallest depth of a place), and
`faces` turns parts into a mesh with holes; all other views have all rows, each once. Doubles are compared after rounding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.names import camera, capture_time, recording
from orrery.operators.orphans import seconds
from orrery.session import table

#: Compared as text: the file's statistics leave NaN out, and a filter on numbers is skipped on their strength.
FINITE = "x::VARCHAR <> 'nan' AND y::VARCHAR <> 'nan' AND z::VARCHAR <> 'nan'"


def cloud(spark: SparkSession, d: str) -> DataFrame:
    """seq, dataset, x, y, z (double), r, g, b, nr, ng, nb: the points of street_pack with finite coordinates."""
    t = table(spark, d, "street_pack")
    xyz = [F.col(c).cast("double").alias(c) for c in "xyz"]
    ok = ~(F.isnan("x") | F.isnan("y") | F.isnan("z"))
    return t.filter(ok).select("seq", recording(F.col("dataset")).alias("dataset"), *xyz, "r", "g", "b", "nr", "ng", "nb").dropDuplicates(["seq"])


CLOUD = f"""cloud AS (SELECT DISTINCT ON (seq) seq, rtrim(trim(coalesce(dataset, '')), '/') AS dataset, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z,
r, g, b, nr, ng, nb FROM street_pack WHERE {FINITE})"""


def frames(spark: SparkSession, d: str) -> DataFrame:
    """name, dataset, cam, ts, px, py, pz, qw, qx, qy, qz (unit): entries of poses with a time and a finite position."""
    t = table(spark, d, "poses").select(recording(F.col("dataset")).alias("dataset"), F.explode("frames").alias("f"))
    n, p, q = F.col("f.name"), F.col("f.p"), F.col("f.q")
    norm = F.sqrt(sum((q[i] * q[i] for i in range(4)), F.lit(0.0)))
    cols = [n.alias("name"), "dataset", camera(n).alias("cam"), capture_time(n).alias("ts")]
    cols += [p[i].alias(c) for i, c in enumerate(("px", "py", "pz"))] + [(q[i] / norm).alias(c) for i, c in enumerate(("qw", "qx", "qy", "qz"))]
    ok = ~(F.isnan("px") | F.isnan("py") | F.isnan("pz")) & (F.abs("px") + F.abs("py") + F.abs("pz") <= 3000)
    return t.filter(p.isNotNull() & q.isNotNull()).select(*cols).filter(F.col("ts").isNotNull() & ok).dropDuplicates(["name"])


FRAMES = r"""frames0 AS (SELECT rtrim(trim(coalesce(dataset, '')), '/') AS dataset, unnest(frames) AS f FROM poses),
frames1 AS (SELECT f.name AS name, dataset, upper(f.name[1]) AS cam,
  try_strptime(regexp_extract(f.name, '^[A-Za-z]_(\d{4}_\d{2}_\d{2}_\d{2}_\d{2}_\d{2}_\d{6})', 1), '%Y_%m_%d_%H_%M_%S_%f') AS ts,
  f.p[1] AS px, f.p[2] AS py, f.p[3] AS pz, sqrt(f.q[1]*f.q[1] + f.q[2]*f.q[2] + f.q[3]*f.q[3] + f.q[4]*f.q[4]) AS qn, f.q AS q
  FROM frames0 WHERE f.p IS NOT NULL AND f.q IS NOT NULL),
frames AS (SELECT DISTINCT ON (name) name, dataset, cam, ts, px, py, pz, q[1]/qn AS qw, q[2]/qn AS qx, q[3]/qn AS qy, q[4]/qn AS qz
  FROM frames1 WHERE ts IS NOT NULL AND NOT isnan(px) AND NOT isnan(py) AND NOT isnan(pz) AND abs(px) + abs(py) + abs(pz) <= 3000)"""


def depth(spark: SparkSession, d: str) -> DataFrame:
    """frame, u, v, z, conf: one depth pixel per place, from lineitem (smallest z and largest confidence of a place)."""
    t = table(spark, d, "lineitem")
    px = t.select((F.col("l_orderkey") % 64).alias("frame"), (F.col("l_partkey") % 64).alias("u"), (F.col("l_suppkey") % 48).alias("v"), (F.col("l_quantity").cast("double") / 5).alias("z"), F.round(F.col("l_discount").cast("double") * 2550).cast("int").alias("conf"))
    return px.groupBy("frame", "u", "v").agg(F.min("z").alias("z"), F.max("conf").alias("conf"))


DEPTH = """depth AS (SELECT l_orderkey % 64 AS frame, l_partkey % 64 AS u, l_suppkey % 48 AS v, min(l_quantity::DOUBLE / 5) AS z,
max(CAST(round(l_discount::DOUBLE * 2550) AS INTEGER)) AS conf FROM lineitem GROUP BY 1, 2, 3)"""


def samples(spark: SparkSession, d: str) -> DataFrame:
    """vertex, view, value: what each view saw at a vertex, from lineitem."""
    t = table(spark, d, "lineitem")
    return t.select(F.col("l_partkey").alias("vertex"), F.col("l_suppkey").alias("view"), F.col("l_extendedprice").cast("double").alias("value"))


SAMPLES = "samples AS (SELECT l_partkey AS vertex, l_suppkey AS view, l_extendedprice::DOUBLE AS value FROM lineitem)"


def objects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "objects").dropDuplicates(["id"])


OBJECTS = "obj AS (SELECT DISTINCT ON (id) * FROM objects)"


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """One row per job id: of several deliveries the one whose status is last in the alphabet; created in seconds."""
    t = table(spark, d, "jobs")
    return t.groupBy("id").agg(F.max("status").alias("status"), F.max("object_id").alias("object_id"), F.max("kind").alias("kind"), F.max(seconds(F.col("created"))).alias("created"), F.max("hidden").alias("hidden"))


JOBS = "job AS (SELECT id, max(status) AS status, max(object_id) AS object_id, max(kind) AS kind, max(CASE WHEN abs(created) > 1e11 THEN created / 1000 ELSE created END) AS created, max(hidden) AS hidden FROM jobs GROUP BY id)"


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """px, i0, i45, i90, i135 in 0..4095: intensities behind four polarizers, from lineitem."""
    t = table(spark, d, "lineitem")
    px = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("px")
    i = [F.col("l_quantity").cast("double") * 80, F.col("l_extendedprice").cast("double") % 4096, F.col("l_discount").cast("double") * 4000 + F.col("l_quantity").cast("double"), F.col("l_tax").cast("double") * 5000 + F.col("l_linenumber")]
    return t.select(px, *[c.alias(n) for c, n in zip(i, ("i0", "i45", "i90", "i135"))]).groupBy("px").agg(*[F.min(n).alias(n) for n in ("i0", "i45", "i90", "i135")])


PIXELS = """pixels AS (SELECT l_orderkey * 8 + l_linenumber AS px, min(l_quantity::DOUBLE * 80) AS i0, min(l_extendedprice::DOUBLE % 4096) AS i45,
min(l_discount::DOUBLE * 4000 + l_quantity::DOUBLE) AS i90, min(l_tax::DOUBLE * 5000 + l_linenumber) AS i135 FROM lineitem GROUP BY 1)"""


def faces(spark: SparkSession, d: str) -> DataFrame:
    """fid, a, b, c: a grid mesh over parts, 50 vertices wide, two triangles a cell; cells of every seventh row missing."""
    n = F.col("p_partkey")
    cell = table(spark, d, "part").select(n.alias("v")).filter((F.col("v") % 50 != 0) & (F.floor(F.col("v") / 50) % 7 != 3))
    tri = F.array(F.struct((F.col("v") * 2).alias("fid"), F.col("v").alias("a"), (F.col("v") + 1).alias("b"), (F.col("v") + 50).alias("c")), F.struct((F.col("v") * 2 + 1).alias("fid"), (F.col("v") + 1).alias("a"), (F.col("v") + 51).alias("b"), (F.col("v") + 50).alias("c")))
    return cell.select(F.explode(tri).alias("t")).select("t.*")


FACES = """cell AS (SELECT p_partkey AS v FROM part WHERE p_partkey % 50 <> 0 AND (p_partkey // 50) % 7 <> 3),
faces AS (SELECT v * 2 AS fid, v AS a, v + 1 AS b, v + 50 AS c FROM cell UNION ALL SELECT v * 2 + 1, v + 1, v + 51, v + 50 FROM cell)"""


def vertices(spark: SparkSession, d: str) -> DataFrame:
    """v, x, y, z: a height field over the grid of `faces`, all vertices that a face can name."""
    v = F.explode(F.array(*[F.col("p_partkey") + k for k in (0, 1, 50, 51)]))
    t = table(spark, d, "part").select(v.alias("v")).distinct()
    return t.select("v", (F.col("v") % 50).cast("double").alias("x"), F.floor(F.col("v") / 50).cast("double").alias("y"), ((F.col("v") * 37 % 11) / 4.0).alias("z"))


VERTICES = """vertices AS (SELECT v, (v % 50)::DOUBLE AS x, (v // 50)::DOUBLE AS y, (v * 37 % 11) / 4.0::DOUBLE AS z FROM
(SELECT DISTINCT p_partkey + unnest([0, 1, 50, 51]) AS v FROM part))"""

#: Camera of the sample scene (focal lengths, centre, size).
INTRINSICS = {"fx": 1183.5, "fy": 1183.5, "cx": 612.0, "cy": 512.0, "w": 1224, "h": 1024}
