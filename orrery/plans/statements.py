"""Statements on the relational tables (Q), files of recordings (S), orientation and half floats (M), view quality (A34, F31)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators import choosing
from orrery.operators.orphans import seconds
from orrery.plans.binding import CLOUD, DEPTH, FRAMES, JOBS, OBJECTS, cloud, depth, frames, jobs, objects
from orrery.plans.projections import UPRIGHT, _upright, r6, sr
from orrery.plans.registry import Registry
from orrery.plans.relations import VIEWS_SQL, views
from orrery.session import materialize, shared_dir, table
from orrery.sources import images, packs, points, sqlite

query = Registry()

# The relational tables of a scene, with the columns that were added to them later.
TABLES = {
    "objects": "id bigint, label string, frame string, cam string, kind string, pts string, cx double, cy double, cz double, sx double, sy double, sz double, npts bigint, created double, pose string, obs string, dataset string, deleted double",
    "jobs": "id bigint, object_id bigint, kind string, status string, detail string, created double, hidden int",
}


def create_tables(spark, folder: str) -> dict[str, str]:
    """Empty tables of a new scene; creating them again changes nothing."""
    paths = {name: f"{folder}/{name}" for name in TABLES}
    for name, ddl in TABLES.items():
        spark.createDataFrame([], ddl).write.mode("ignore").parquet(paths[name])
    return paths


def columns_sql(name: str) -> str:
    return f"SELECT '{name}' AS tab, column_name AS col FROM (DESCRIBE {name})"


@query("q01_create_tables", " UNION ALL ".join(columns_sql(n) for n in TABLES))
def q01(spark, d):
    """Tables created twice, then filled from the recording's: columns of what is read back."""
    paths = create_tables(spark, shared_dir(spark, "scene"))
    out = None
    for name, path in paths.items():
        create_tables(spark, path.rsplit("/", 1)[0])
        table(spark, d, name).write.mode("append").parquet(path)
        cols = spark.createDataFrame([(name, c) for c in spark.read.schema(TABLES[name]).parquet(path).columns], "tab string, col string")
        out = cols if out is None else out.union(cols)
    return out


FIRST = "SELECT min(id) FROM objects WHERE obs IS NOT NULL"


@query("q04_object_by_id", f"WITH {OBJECTS} SELECT id, label, kind, frame FROM obj WHERE id = ({FIRST})")
def q04(spark, d):
    first = table(spark, d, "objects").filter("obs is not null").agg(F.min("id").alias("id"))  # one row
    return objects(spark, d).join(F.broadcast(first), "id").select("id", "label", "kind", "frame")


@query("q05_observations_by_id", f"WITH {OBJECTS}, o AS (SELECT id, unnest(from_json(obs, '[{{\"frame\":\"VARCHAR\",\"kind\":\"VARCHAR\",\"auto\":\"BOOLEAN\"}}]')) AS o FROM obj WHERE obs IS NOT NULL) SELECT id, o.frame AS frame, o.kind AS kind, o.auto AS auto FROM o")
def q05(spark, d):
    """The observations of every object, as the statement by id reads those of one."""
    o = objects(spark, d).filter("obs is not null").select("id", F.explode(F.from_json("obs", "array<struct<frame:string,kind:string,auto:boolean>>")).alias("o"))
    return o.select("id", "o.frame", "o.kind", "o.auto")


@query("q06_jobs_newest_first", f"WITH {JOBS} SELECT id, kind, status, row_number() OVER (ORDER BY id DESC) AS nth FROM job")
def q06(spark, d):
    """All jobs, newest first; the number comes from counts per range of ids, so that no task sorts them all."""
    from orrery.operators.spikes import numbered

    j = jobs(spark, d).select(F.lit(0).alias("all"), "id", "kind", "status", (-F.col("id")).alias("back")).withColumn("bucket", F.floor(F.col("back") / 65_536))
    return numbered(j, ["all"], "bucket", ["back"]).select("id", "kind", "status", (F.col("pos") + 1).cast("long").alias("nth"))


@query("q08_object_of_job", f"WITH {JOBS}, {OBJECTS} SELECT j.id AS job_id, o.id AS object_id, o.label, o.frame FROM job j JOIN obj o ON o.id = j.object_id")
def q08(spark, d):
    o = objects(spark, d).select(F.col("id").alias("object_id"), "label", "frame")
    return jobs(spark, d).select(F.col("id").alias("job_id"), "object_id").join(o, "object_id").select("job_id", "object_id", "label", "frame")


@query("q09_insert_jobs", "SELECT kind, count(*) + 2 AS n, max(id) + 2 AS last FROM jobs WHERE kind IN ('reconstruct', 'map', 'poses') GROUP BY kind")
def q09(spark, d):
    """Two jobs of each kind appended after the newest of their kind."""
    paths = create_tables(spark, shared_dir(spark, "scene"))
    known = table(spark, d, "jobs").filter("kind in ('reconstruct', 'map', 'poses')")
    known.select(*[F.col(c).cast(t) for c, t in (x.split() for x in TABLES["jobs"].split(", "))]).write.mode("append").parquet(paths["jobs"])
    top = known.groupBy("kind").agg(F.max("id").alias("top"))
    new = top.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("more")).select((F.col("top") + F.col("more")).alias("id"), F.lit(0).cast("long").alias("object_id"), "kind", F.lit("queued").alias("status"), F.lit(None).cast("string").alias("detail"), F.lit(0.0).alias("created"), F.lit(0).alias("hidden"))
    new.write.mode("append").parquet(paths["jobs"])
    return spark.read.schema(TABLES["jobs"]).parquet(paths["jobs"]).groupBy("kind").agg(F.count("*").alias("n"), F.max("id").alias("last"))


@query("q10_insert_objects", f"WITH {OBJECTS} SELECT kind, count(*) AS n FROM (SELECT kind FROM obj UNION ALL SELECT kind FROM obj WHERE label = '') GROUP BY kind")
def q10(spark, d):
    """Objects inserted, and those without a label inserted once more under new ids."""
    paths = create_tables(spark, shared_dir(spark, "scene"))
    o = objects(spark, d).select(*[c.split()[0] for c in TABLES["objects"].split(", ")])
    o.write.mode("append").parquet(paths["objects"])
    top = o.agg(F.max("id").alias("top"))  # one row
    o.filter("label = ''").crossJoin(F.broadcast(top)).withColumn("id", F.col("id") + F.col("top")).drop("top").write.mode("append").parquet(paths["objects"])
    return spark.read.schema(TABLES["objects"]).parquet(paths["objects"]).groupBy("kind").agg(F.count("*").alias("n"))


@query("q12_update_observations", f"WITH {OBJECTS} SELECT id, CASE WHEN id % 3 = 0 THEN 'turned' ELSE pose END AS pose, CASE WHEN id % 5 = 0 THEN '[]' ELSE obs END AS obs FROM obj")
def q12(spark, d):
    """Poses and observations set anew, as rows of a log; the newest value of each column that was set is the state."""
    base = objects(spark, d).select("id", "pose", "obs")
    log = base.select("id", "pose", "obs", F.lit(0).alias("at"), F.lit(True).alias("sets_pose"), F.lit(True).alias("sets_obs"))
    log = log.union(base.filter("id % 3 = 0").select("id", F.lit("turned"), F.lit(None).cast("string"), F.lit(1), F.lit(True), F.lit(False)))
    log = log.union(base.filter("id % 5 = 0").select("id", F.lit(None).cast("string"), F.lit("[]"), F.lit(2), F.lit(False), F.lit(True)))
    newest = lambda c: F.max_by(c, F.when(F.col("sets_" + c), F.col("at"))).alias(c)
    return log.groupBy("id").agg(newest("pose"), newest("obs"))


@query("q13_hidden_jobs", f"WITH {OBJECTS}, {JOBS} SELECT j.id, CASE WHEN o.deleted IS NOT NULL AND j.status IN ('done', 'error') THEN 1 ELSE coalesce(j.hidden, 0) END AS hidden FROM job j LEFT JOIN obj o ON o.id = j.object_id")
def q13h(spark, d):
    """What deleting objects does to their jobs: finished ones are hidden."""
    gone = objects(spark, d).filter("deleted is not null").select(F.col("id").alias("object_id"), F.lit(1).alias("gone"))
    hide = F.col("gone").isNotNull() & F.col("status").isin("done", "error")
    return jobs(spark, d).join(gone, "object_id", "left").select("id", F.when(hide, 1).otherwise(F.coalesce("hidden", F.lit(0))).alias("hidden"))


# ---- files of a recording (S)
def _write_files(spark, rows) -> str:
    """A few small files (path below a new shared folder, bytes), written through the file system of that folder."""
    root = shared_dir(spark, "files")
    for path, content in rows:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{path}")
        out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
        out.write(bytearray(content))
        out.close()
    return root


RAWS = [("raw/A_2026_06_01_10_00_00_000000.raw12", b"a" * 96), ("raw/sub/B_2026_06_01_10_00_01_000000.raw", b"b" * 96), ("raw/C_none.raw", b"c" * 96), ("raw/A_2026_06_01_10_00_02_000000.raw", b"d" * 95), ("A_2026_06_01_10_00_03_000000.raw", b"e" * 96), ("raw/notes.txt", b"f")]
RAWS_SQL = "raws(path, n) AS (VALUES " + ", ".join(f"('{p}', {len(c)}::BIGINT)" for p, c in RAWS) + ")"


@query("s01_raw_folder", f"WITH {RAWS_SQL} SELECT regexp_extract(path, '([^/]*)$', 1) AS name, n AS length FROM raws WHERE path LIKE 'raw/%' AND regexp_matches(path, '\\.raw(12)?$')")
def s01(spark, d):
    """The raw folder of a recording: its `raw`, if there is one, and only raw files."""
    return images.raw_frames(spark, _write_files(spark, RAWS)).select("name", "length")


@query("s03_accepted_frames", f"WITH {RAWS_SQL} SELECT regexp_extract(path, '([^/]*)$', 1) AS name, upper(regexp_extract(path, '([^/]*)$', 1)[1]) AS cam FROM raws WHERE path LIKE 'raw/%' AND regexp_matches(path, '\\.raw(12)?$') AND n = 96 AND regexp_matches(path, '_(\\d{{4}})_(\\d{{2}})_(\\d{{2}})_(\\d{{2}})_(\\d{{2}})_(\\d{{2}})_(\\d{{6}})')")
def s03(spark, d):
    """Frames of the right size with a time in their name, from all folders below."""
    return images.accepted(images.raw_frames(spark, _write_files(spark, RAWS)), 96).select("name", "cam")


@query("s05_archive_slices", "SELECT 's' || i AS name, CASE WHEN i < 9 THEN repeat(chr(97 + i), 10) END AS content FROM (SELECT unnest(range(10))::INTEGER AS i)")
def s05(spark, d):
    """Byte ranges read out of an archive by an index; the last one reaches beyond the end."""
    root = _write_files(spark, [("a.tar", b"".join(bytes([97 + i]) * 10 for i in range(9)))])
    index = spark.createDataFrame([(f"s{i}", f"{root}/a.tar", 10 * i, 10) for i in range(10)], "name string, tar string, offset long, size long")
    return images.slices(index).select("name", F.col("content").cast("string").alias("content"))


@query("s07_depth_pictures", f"WITH {DEPTH} SELECT frame, count(*) AS n, {sr('sum(floor(z*1000 + 0.5)/1000)', 'z', 3)} FROM depth GROUP BY frame")
def s07(spark, d):
    """Depth as 16-bit pictures, written and read again: thousandths, 0 for no depth."""
    import numpy as np
    import pandas as pd

    def draw(pdf):
        z = np.zeros((48, 64))
        z[pdf["v"].to_numpy(int), pdf["u"].to_numpy(int)] = np.floor(pdf["z"].to_numpy(float) * 1000 + 0.5)
        return pd.DataFrame({"frame": [str(pdf["frame"].iloc[0])], "content": [images.write_png16(z)]})

    pictures = materialize(depth(spark, d).groupBy("frame").applyInPandas(draw, "frame string, content binary"), "pictures")
    px = images.depth_pixels(pictures)
    return px.groupBy(F.col("frame").cast("long").alias("frame")).agg(F.count("*").alias("n"), r6(F.sum("z"), "z", 3))


@query("s09_ply_by_header", f"WITH {CLOUD} SELECT {sr('x', 'x', 4)}, CAST(seq % 1000 AS INTEGER) AS tag, CAST(coalesce(r, 0) AS INTEGER) AS r FROM cloud")
def s09(spark, d):
    """A PLY file with other fields than usual: names and types come from its header."""
    points.register(spark)
    path = shared_dir(spark, "ply")
    c = cloud(spark, d).select(F.col("x"), (F.col("seq") % 1000).cast("int").alias("tag"), F.coalesce("r", F.lit(0)).cast("smallint").alias("r"))
    c.write.format("ply").mode("append").save(path)
    back = spark.read.format("ply").load(path)
    return back.select(r6(F.col("x"), "x", 4), "tag", F.col("r").cast("int").alias("r"))


@query("s10_gaussian_ply", f"WITH {CLOUD} SELECT {sr('x', 'x', 3)}, {sr('(r/255.0 - 0.5)/0.28209479177387814', 'dc', 3)}, 3.0 AS opacity, {sr('ln(0.02)', 'scale', 4)}, 1.0 AS rot FROM cloud WHERE r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL")
def s10(spark, d):
    """Points as gaussians in a PLY file, read again."""
    points.register(spark)
    path = shared_dir(spark, "ply")
    packs.gaussians(cloud(spark, d).dropna(subset=["r", "g", "b"]), 0.02).write.format("ply").mode("append").save(path)
    back = spark.read.format("ply").load(path)
    dbl = lambda c: F.col(c).cast("double")
    return back.select(r6(dbl("x"), "x", 3), r6(dbl("f_dc_0"), "dc", 3), dbl("opacity").alias("opacity"), r6(dbl("scale_0"), "scale", 4), dbl("rot_0").alias("rot"))


@query("s16_sqlite_round_trip", "SELECT id, object_id, kind, status FROM jobs")
def s16(spark, d):
    """Jobs written into SQLite files, a file a task, and read again."""
    path = shared_dir(spark, "sqlite")
    sqlite.write(table(spark, d, "jobs").select("id", "object_id", "kind", "status"), path, "jobs")
    return sqlite.read(spark, path, "jobs", "id long, object_id long, kind string, status string")


@query("s26_mounts", f"WITH {FRAMES}, s AS (SELECT cam, name, CASE CAST(substring(name, 20, 2) AS INTEGER) % 3 WHEN 0 THEN 0 WHEN 1 THEN 180 END AS deg FROM frames), f AS (SELECT cam, arg_min(deg, name) FILTER (deg IS NOT NULL) AS deg FROM s GROUP BY cam) SELECT cam, CASE WHEN deg IS NULL THEN 3 WHEN deg = 0 THEN 0 ELSE 2 END AS quarter_turns FROM f")
def s26(spark, d):
    """How each camera is mounted, from its first session that states a rotation; the seconds in a name stand for the statement."""
    digit = F.substring("name", 20, 2).cast("int") % 3
    s = frames(spark, d).select("cam", "name", F.when(digit == 0, 0).when(digit == 1, 180).alias("rotation_deg"))
    return images.mounts(s)


@query("s27_camera_overlap", f"WITH {FRAMES}, c AS (SELECT dataset, cam, min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM frames GROUP BY 1, 2) SELECT a.dataset, greatest(least(a.hi, b.hi) - greatest(a.lo, b.lo), 0) AS overlap_us FROM c a JOIN c b ON a.dataset = b.dataset AND a.cam = 'A' AND b.cam = 'B'")
def s27(spark, d):
    """How long cameras A and B of a recording ran together."""
    t = F.unix_micros("ts")
    side = lambda cam: frames(spark, d).filter(F.col("cam") == cam).groupBy("dataset").agg(F.min(t).alias("lo" + cam), F.max(t).alias("hi" + cam))
    both = side("A").join(side("B"), "dataset")
    return both.select("dataset", F.greatest(F.least("hiA", "hiB") - F.greatest("loA", "loB"), F.lit(0).cast("long")).alias("overlap_us"))


# ---- orientation, half floats (M)
@query("m18_orient", f"WITH {DEPTH}, k AS (SELECT *, (frame % 4 + 1) % 4 AS k FROM depth) SELECT frame, CASE k WHEN 0 THEN u WHEN 1 THEN v WHEN 2 THEN 63 - u ELSE 47 - v END AS u, CASE k WHEN 0 THEN v WHEN 1 THEN 63 - u WHEN 2 THEN 47 - v ELSE u END AS v, ((90*(frame % 4) + 180) % 360) - 180 AS roll, {sr('z', 'z', 4)} FROM k")
def m18(spark, d):
    """Pictures turned by quarter turns from how their camera is mounted (frame % 4): places move, values stay; and the roll."""
    up = F.col("frame") % 4
    k, u, v = (up + 1) % 4, F.col("u"), F.col("v")
    nu = F.when(k == 0, u).when(k == 1, v).when(k == 2, 63 - u).otherwise(47 - v)
    nv = F.when(k == 0, v).when(k == 1, 63 - u).when(k == 2, 47 - v).otherwise(u)
    return depth(spark, d).select("frame", nu.alias("u"), nv.alias("v"), ((90 * up + 180) % 360 - 180).alias("roll"), r6(F.col("z"), "z", 4))


HALF_E = "CAST(floor(log2(abs(x)) + 1e-12) AS INTEGER)"


@query("m16_half_float", f"WITH {CLOUD}, e0 AS (SELECT seq, x::FLOAT::DOUBLE AS x FROM cloud), e1 AS (SELECT seq, x, CASE WHEN x = 0 THEN -200 WHEN power(2.0::DOUBLE, {HALF_E}) > abs(x) THEN {HALF_E} - 1 WHEN power(2.0::DOUBLE, {HALF_E} + 1) <= abs(x) THEN {HALF_E} + 1 ELSE {HALF_E} END AS e FROM e0) SELECT seq, CAST((CASE WHEN x < 0 THEN 32768 ELSE 0 END) + CASE WHEN e < -25 THEN 0 WHEN e < -14 THEN floor(abs(x)*16777216) WHEN e > 15 THEN 31744 ELSE (e + 15)*1024 + floor((abs(x)/power(2.0::DOUBLE, e) - 1)*1024) END AS INTEGER) AS half FROM e1")
def m16(spark, d):
    """Bits of the half-precision number below a coordinate: truncated, subnormals kept, infinite beyond the range."""
    x = F.col("x")
    guess = F.floor(F.log2(F.abs(x)) + 1e-12).cast("int")
    e0 = cloud(spark, d).select("seq", F.col("x").cast("float").cast("double").alias("x")).withColumn("g", guess)
    e = F.when(x == 0, -200).when(F.pow(F.lit(2.0), "g") > F.abs(x), F.col("g") - 1).when(F.pow(F.lit(2.0), F.col("g") + 1) <= F.abs(x), F.col("g") + 1).otherwise(F.col("g"))
    mantissa = F.floor((F.abs(x) / F.pow(F.lit(2.0), "e") - 1) * 1024)
    size = F.when(F.col("e") < -25, 0).when(F.col("e") < -14, F.floor(F.abs(x) * 16777216)).when(F.col("e") > 15, 31744).otherwise((F.col("e") + 15) * 1024 + mantissa)
    return e0.withColumn("e", e).select("seq", (F.when(x < 0, 32768).otherwise(0) + size).cast("int").alias("half"))


# ---- what views see of points, and which views are kept (F22, F24, F31, A34)
@query("f22_depth_visibility", f"WITH {CLOUD}, {VIEWS_SQL}, {DEPTH}, p AS (SELECT seq, dataset, view, 1183.5*(x - ex)/(z - ez) + 612 AS sx, 1183.5*(y - 1.5)/(z - ez) + 512 AS sy, (z - ez)/20 AS z FROM cloud, views WHERE z - ez > 0.3), s AS (SELECT *, CAST(least(floor(sx*64/1224), 63) AS BIGINT) AS u, CAST(least(floor(sy*48/1024), 47) AS BIGINT) AS v FROM p WHERE sx >= 0 AND sx < 1224 AND sy >= 0 AND sy < 1024) SELECT s.dataset, s.view, {sr('avg(CASE WHEN abs(d.z - s.z)/greatest(s.z, 0.001) < 0.25 THEN 1.0 ELSE 0.0 END)', 'vis', 5)}, count(*) AS n FROM s JOIN depth d ON d.frame = s.view + 1 AND d.u = s.u AND d.v = s.v WHERE d.z > 0 GROUP BY 1, 2 HAVING count(*) >= 5")
def f22(spark, d):
    """How many of a pack's points each view sees where its depth picture says they are, to a quarter of their depth; nothing
    where fewer than five fall on depth. The cloud's depths are brought to the scale of the pictures (1 : 20)."""
    z = F.col("z") - F.col("ez")
    p = cloud(spark, d).crossJoin(F.broadcast(views(spark))).filter(z > 0.3).select("dataset", "view", (z / 20).alias("zi"), (1183.5 * (F.col("x") - F.col("ex")) / z + 612).alias("sx"), (1183.5 * (F.col("y") - 1.5) / z + 512).alias("sy"))
    s = p.filter("sx >= 0 and sx < 1224 and sy >= 0 and sy < 1024").select("dataset", "view", (F.col("view") + 1).alias("frame"), "zi", F.least(F.floor(F.col("sx") * 64 / 1224), F.lit(63)).alias("u"), F.least(F.floor(F.col("sy") * 48 / 1024), F.lit(47)).alias("v"))
    hit = s.join(depth(spark, d).filter("z > 0").select("frame", "u", "v", F.col("z").alias("zd")), ["frame", "u", "v"])
    near = F.when(F.abs(F.col("zd") - F.col("zi")) / F.greatest("zi", F.lit(1e-3)) < 0.25, 1.0).otherwise(0.0)
    return hit.groupBy("dataset", "view").agg(F.avg(near).alias("s"), F.count("*").alias("n")).filter("n >= 5").select("dataset", "view", r6(F.col("s"), "vis", 5), "n")


@query("f24_facing_visible", f"WITH {CLOUD}, {UPRIGHT}, n AS (SELECT s.seq, s.dataset, s.z, s.sx, s.sy, ((c.nr/127.5 - 1)*(s.x - 10) + (c.ng/127.5 - 1)*(s.y - 1.5) + (c.nb/127.5 - 1)*s.z)/sqrt((s.x - 10)**2 + (s.y - 1.5)**2 + s.z**2) AS facing FROM (SELECT seen.*, cloud.dataset, uy AS sx, 1023 - ux AS sy FROM seen JOIN cloud USING (seq)) s JOIN cloud c ON c.seq = s.seq WHERE c.nr IS NOT NULL AND c.ng IS NOT NULL AND c.nb IS NOT NULL), k AS (SELECT *, floor(sx/2) AS gx, floor(sy/2) AS gy FROM n WHERE facing < 0.15), b AS (SELECT gx, gy, min(z) AS z FROM k GROUP BY 1, 2), e AS (SELECT a.gx, a.gy, min(n.z) AS zmin FROM b a JOIN b n ON abs(a.gx - n.gx) <= 1 AND abs(a.gy - n.gy) <= 1 GROUP BY 1, 2) SELECT seq FROM k JOIN e ON k.gx = e.gx AND k.gy = e.gy WHERE z <= zmin*1.04 + 0.001")
def f24(spark, d):
    """Points that face the camera (n v < 0.15) and that no nearer point hides."""
    from orrery.operators import spatial

    c = cloud(spark, d).dropna(subset=["nr", "ng", "nb"]).select("seq", *[(F.col(a) / 127.5 - 1).alias(a) for a in ("nr", "ng", "nb")])
    s = _upright(spark, d).filter("inside").join(c, "seq")
    ray = [F.col("wx") - 10, F.col("wy") - 1.5, F.col("z")]
    facing = sum((F.col(a) * v for a, v in zip(("nr", "ng", "nb"), ray)), F.lit(0.0)) / F.sqrt(sum((v * v for v in ray), F.lit(0.0)))
    k = s.withColumn("facing", facing).filter("facing < 0.15").withColumn("gx", F.floor(F.col("sx") / 2)).withColumn("gy", F.floor(F.col("sy") / 2)).select("seq", "sx", "sy", "z", "gx", "gy")
    front = spatial.z_buffer(k, [], "sx", "sy", "z", 2)
    return k.join(front, ["gx", "gy"]).filter(F.col("z") <= F.col("zmin") * 1.04 + 1e-3).select("seq")


#: Candidate views of objects and their measures, from lineitem: an order is an object, a part a view of it.
VIEW = """view AS (SELECT l_orderkey AS object, l_partkey AS name, 0.3 + max(l_tax)::DOUBLE*8 AS solidity, max(l_extendedprice)::DOUBLE/100 AS sharp, CAST(max(l_linenumber) - 1 AS BIGINT) AS ncc,
0.6 + max(l_quantity)::DOUBLE/50 AS aspect, 0.2 + max(l_discount)::DOUBLE*4 AS fill, max(l_extendedprice)::DOUBLE AS orig_px, max(l_returnflag) = 'R' AS manual, CAST(l_partkey % 360 AS DOUBLE) AS bearing FROM lineitem GROUP BY 1, 2)"""
QUALITY = f"""{VIEW}, med AS (SELECT object, median(solidity) AS ms, median(sharp) AS mh, median(aspect) AS ma, median(fill) AS mf FROM view GROUP BY object),
rel AS (SELECT v.*, solidity/greatest(ms, 1e-6) AS rs, sharp/greatest(CASE WHEN mh = 0 THEN 1 ELSE mh END, 1e-6) AS rh, aspect/greatest(CASE WHEN ma = 0 THEN 1 ELSE ma END, 1e-6) AS ra, fill/greatest(CASE WHEN mf = 0 THEN 1 ELSE mf END, 1e-6) AS rf FROM view v JOIN med USING (object)),
q AS (SELECT *, rs >= 0.75 AND rh >= 0.35 AND ncc <= 3 AND ra BETWEEN 1/1.8 AND 1.8 AND rf BETWEEN 1/1.8 AND 1.8 AS ok, least(rs, 1.2)*sqrt(least(rh, 1.5))*sqrt(orig_px)*(CASE WHEN manual THEN 1.15 ELSE 1 END) AS score FROM rel)"""


def view_table(spark, d):
    t = table(spark, d, "lineitem")
    dbl = lambda c: F.max(F.col(c).cast("double"))
    return t.groupBy(F.col("l_orderkey").alias("object"), F.col("l_partkey").alias("name")).agg((0.3 + dbl("l_tax") * 8).alias("solidity"), (dbl("l_extendedprice") / 100).alias("sharp"), (F.max("l_linenumber") - 1).cast("long").alias("ncc"), (0.6 + dbl("l_quantity") / 50).alias("aspect"), (0.2 + dbl("l_discount") * 4).alias("fill"), dbl("l_extendedprice").alias("orig_px"), (F.max("l_returnflag") == "R").alias("manual")).withColumn("bearing", (F.col("name") % 360).cast("double"))


def view_quality(spark, d):
    return choosing.view_quality(view_table(spark, d), ["object"])


@query("f31_view_keep", f"WITH {QUALITY} SELECT object, name, ok FROM q")
def f31(spark, d):
    """Which views agree with their set: solidity, sharpness, pieces, aspect and fill against the set's medians."""
    return view_quality(spark, d).select("object", "name", "ok")


@query("a34_view_scores", f"WITH {QUALITY} SELECT object, name, {sr('rs', 'rel_sol', 4)}, {sr('rh', 'rel_sharp', 4)}, {sr('score', 'score', 3)} FROM q")
def a34(spark, d):
    """Measures of views relative to the medians of their set, and the score."""
    return view_quality(spark, d).select("object", "name", r6(F.col("rel_sol"), "rel_sol", 4), r6(F.col("rel_sharp"), "rel_sharp", 4), r6(F.col("score"), "score", 3))


QUERIES, ORACLES = query.queries, query.oracles
