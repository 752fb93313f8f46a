"""Queries of the data-quality operators: compaction (p1), implausible readings (p2), orphan references (p3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.names import camera, capture_time, recording
from orrery.operators import compaction, orphans, spikes
from orrery.session import table


def _compacted(spark: SparkSession, d: str) -> compaction.Compaction:
    return compaction.compact(table(spark, d, "street_video"), max_small_files=0)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return compaction.copy_pairs(_compacted(spark, d).copies)


def p1_compaction(spark: SparkSession, d: str) -> DataFrame:
    """What compaction made of each recording and tree: files before and after, records, bytes."""
    done = _compacted(spark, d)
    per = done.records(spark).withColumn("_file", F.input_file_name()).groupBy("recording", "tree_key")
    out = per.agg(F.count("*").alias("n_records"), F.count_distinct("_file").alias("n_out_files"))
    return done.plan.select("recording", "tree_key", "n_files", "n_small").join(out, ["recording", "tree_key"])


#: Small files a partition may hold before p1_twice rewrites it.
LIMIT = 40


def p1_twice(spark: SparkSession, d: str) -> DataFrame:
    """Records per partition after two runs with a real limit: one when the rgb tree alone was there, one with all trees.

    Partitions with at most LIMIT small files are left alone, and the second run rewrites only what the first did not.
    """
    files = table(spark, d, "street_video")
    tree = compaction.identify(files.select("file_id", "dataset", "tree", "path"))
    rgb = files.join(tree.filter("tree_key = 'rgb'").select("file_id").distinct(), "file_id", "left_semi")
    first = compaction.compact(rgb, max_small_files=LIMIT)
    rest = files.join(tree.filter("tree_key <> 'rgb'").select("file_id").distinct(), "file_id", "left_semi")
    second = compaction.compact(rest, first.lake, max_small_files=LIMIT)
    per = second.records(spark).groupBy("recording", "tree_key").agg(F.count("*").alias("n_records"))
    return per


def pose_entries(spark: SparkSession, d: str) -> DataFrame:
    """recording, cam, name, ts, p: one row per entry of a pose pack."""
    packs = table(spark, d, "poses").select(recording(F.col("dataset")).alias("recording"), F.explode("frames").alias("f"))
    name = F.col("f.name")
    return packs.select("recording", camera(name).alias("cam"), name.alias("name"), capture_time(name).alias("ts"), F.col("f.p").alias("p"))


def p2_poses(spark: SparkSession, d: str) -> DataFrame:
    return spikes.flag_track(pose_entries(spark, d))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    seams = table(spark, d, "poses_report").withColumn("recording", recording(F.col("dataset"))).withColumn("ts", F.col("built"))
    return spikes.flag_readings(seams, "seam_id", "centre_gap_med", ["run_no", "chunk"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    poses = p2_poses(spark, d).select(F.lit("poses").alias("tab"), F.col("name").alias("rec_key"))
    report = p2_report(spark, d).select(F.lit("poses_report").alias("tab"), F.col("seam_id").cast("string").alias("rec_key"))
    return poses.unionByName(report)


def _orphan_jobs(spark: SparkSession, d: str) -> DataFrame:
    sec = lambda c: orphans.seconds(F.col(c))
    jobs = table(spark, d, "jobs").filter("object_id <> 0").select("id", F.col("object_id").alias("key"), sec("created").alias("at"))
    objects = table(spark, d, "objects").select(F.col("id").alias("key"), sec("created").alias("created"), sec("deleted").alias("deleted"))
    return orphans.orphans(jobs, objects)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphan_jobs(spark, d).select(F.col("id").alias("job_id")).distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphan_jobs(spark, d).dropDuplicates(["id"]), "jobs").select("tab", "day", "n_orphans", "n_keys")


P3_ORPHANS = """
WITH j AS (SELECT DISTINCT id, object_id, CASE WHEN abs(created) > 1e11 THEN created / 1000 ELSE created END AS t
           FROM jobs WHERE object_id <> 0),
o AS (SELECT DISTINCT id, CASE WHEN abs(created) > 1e11 THEN created / 1000 ELSE created END AS c,
             CASE WHEN abs(deleted) > 1e11 THEN deleted / 1000 ELSE deleted END AS x FROM objects),
orphan AS (SELECT * FROM j WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.id = j.object_id AND o.c <= j.t AND (o.x IS NULL OR o.x > j.t)))
"""

P1_IDENT = r"""
WITH c AS (SELECT file_id, payload, rtrim(trim(dataset), '/') AS rec,
  regexp_replace(regexp_replace(regexp_replace(lower(replace(path, '%5F', '_')), '[\\/]+', '/', 'g'), '^(\./|/)+', ''), '^street_video/', '') AS q FROM street_video),
k AS (SELECT file_id, payload, rec, regexp_replace(regexp_replace(q, '[^/]*$', ''), '/+$', '') AS folder,
  regexp_replace(regexp_replace(q, '^.*/', ''), '(\s+|\.(jpe?g|png|bak)|_copy| \([0-9]+\))+$', '') AS frame FROM c)
"""

P2_REPORT = """
WITH s AS (SELECT seam_id, rtrim(trim(coalesce(dataset, '')), '/') AS recording, coalesce(cam, '') AS cam, run_no, chunk, min(centre_gap_med) AS v
  FROM poses_report WHERE centre_gap_med IS NOT NULL AND seam_id IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
q AS (SELECT recording, cam, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.5) AS med, quantile_disc(v, 0.75) AS q3 FROM s WHERE isfinite(v) GROUP BY 1, 2),
o AS (SELECT *, CASE WHEN lag(v) OVER w = v THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY recording, cam ORDER BY run_no, chunk, seam_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY recording, cam ORDER BY run_no, chunk, seam_id) AS run FROM o),
l AS (SELECT *, count(*) OVER (PARTITION BY recording, cam, run) AS len FROM g),
r AS (SELECT l.recording, l.cam, seam_id, v AS centre_gap_med, concat_ws(',', CASE WHEN NOT isfinite(v) OR v < 0 THEN 'impossible' END,
  CASE WHEN isfinite(v) AND v > 5 * med THEN 'fence' END, CASE WHEN len >= 5 AND NOT isnan(v) THEN 'stuck' END) AS reason, q3 + 3 * (q3 - q1) AS outer_fence
  FROM l JOIN q ON l.recording = q.recording AND l.cam = q.cam)
"""

#: The rule written out on whole sequences: running median, line between the calm entries around, runs of equal components.
P2_POSES = r"""
WITH e0 AS (SELECT rtrim(trim(coalesce(dataset, '')), '/') AS recording, unnest(frames) AS f FROM poses),
e1 AS (SELECT recording, f.name AS name, coalesce(upper(f.name[1]), '') AS cam, f.p AS p,
  try_strptime(regexp_extract(f.name, '^[A-Za-z]_(\d{4}_\d{2}_\d{2}_\d{2}_\d{2}_\d{2}_\d{6})', 1), '%Y_%m_%d_%H_%M_%S_%f') AS ts FROM e0 WHERE f.p IS NOT NULL),
e AS (SELECT DISTINCT ON (recording, cam, name) * FROM e1 WHERE ts IS NOT NULL ORDER BY recording, cam, name, p),
c AS (SELECT recording, cam, name, ts, coalesce(p[1], 'nan'::DOUBLE) AS x, coalesce(p[2], 'nan'::DOUBLE) AS y, coalesce(p[3], 'nan'::DOUBLE) AS z FROM e),
n AS (SELECT *, abs(x) <= 3000 AND abs(y) <= 3000 AND abs(z) <= 3000 AS good, row_number() OVER (PARTITION BY recording, cam ORDER BY ts, name) AS pos FROM c),
st AS (SELECT recording, cam, sqrt((x - lag(x) OVER h)**2 + (y - lag(y) OVER h)**2 + (z - lag(z) OVER h)**2) AS step, good AND lag(good) OVER h AS ok
  FROM n WINDOW h AS (PARTITION BY recording, cam, date_trunc('hour', ts) ORDER BY ts, name)),
u AS (SELECT recording, cam, quantile_disc(step, 0.5) AS usual FROM st WHERE ok GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY recording, cam ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY recording, cam) AS m FROM n WHERE good),
w AS (SELECT a.recording, a.cam, a.i, median(b.x) AS mx, median(b.y) AS my, median(b.z) AS mz FROM k a, (SELECT unnest(range(-5, 6)) AS o) t, k b
  WHERE abs(o) <= (a.m - 1) // 2 AND b.recording = a.recording AND b.cam = a.cam AND b.i = CASE WHEN abs(a.i + o) > a.m - 1 THEN 2 * (a.m - 1) - abs(a.i + o) ELSE abs(a.i + o) END GROUP BY 1, 2, 3),
s AS (SELECT k.*, usual, sqrt((x - mx)**2 + (y - my)**2 + (z - mz)**2) >= 5 * usual AS suspect FROM k JOIN w ON k.recording = w.recording AND k.cam = w.cam AND k.i = w.i JOIN u ON u.recording = k.recording AND u.cam = k.cam WHERE m >= 3 AND usual > 0),
b AS (SELECT *, max(CASE WHEN NOT suspect THEN i END) OVER (PARTITION BY recording, cam ORDER BY i) AS ia, min(CASE WHEN NOT suspect THEN i END) OVER (PARTITION BY recording, cam ORDER BY i DESC) AS ib FROM s),
d AS (SELECT b.recording, b.cam, b.name, b.usual, sqrt((b.x - p.x - t*(q.x - p.x))**2 + (b.y - p.y - t*(q.y - p.y))**2 + (b.z - p.z - t*(q.z - p.z))**2) AS away,
  sqrt((q.x - p.x)**2 + (q.y - p.y)**2 + (q.z - p.z)**2) AS apart, ib - ia - 1 AS together
  FROM (SELECT b.*, (epoch_us(b.ts) - epoch_us(p.ts)) / greatest(epoch_us(q.ts) - epoch_us(p.ts), 1e-3)::DOUBLE AS t FROM b JOIN k p ON p.recording = b.recording AND p.cam = b.cam AND p.i = ia JOIN k q ON q.recording = b.recording AND q.cam = b.cam AND q.i = ib WHERE suspect) b
  JOIN k p ON p.recording = b.recording AND p.cam = b.cam AND p.i = ia JOIN k q ON q.recording = b.recording AND q.cam = b.cam AND q.i = ib),
off_track AS (SELECT recording, cam, name FROM d WHERE away >= 10 * usual AND apart < greatest(away, 20 * usual) AND together <= 10),
axes AS (SELECT recording, cam, name, pos, unnest([{'a': 1, 'v': x}, {'a': 2, 'v': y}, {'a': 3, 'v': z}]) AS o FROM n),
cut AS (SELECT recording, cam, name, pos, o.a AS a, o.v AS v, CASE WHEN lag(o.v) OVER r = o.v AND NOT isnan(o.v) THEN 0 ELSE 1 END AS new FROM axes WINDOW r AS (PARTITION BY recording, cam, o.a ORDER BY pos)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY recording, cam, a ORDER BY pos) AS run FROM cut),
stuck AS (SELECT DISTINCT recording, cam, name FROM (SELECT *, count(*) OVER (PARTITION BY recording, cam, a, run) AS len FROM runs) WHERE len >= 5),
f AS (SELECT n.recording, n.cam, n.name, concat_ws(',', CASE WHEN NOT coalesce(good, false) THEN 'impossible' END, CASE WHEN o.name IS NOT NULL THEN 'off_track' END, CASE WHEN k.name IS NOT NULL THEN 'stuck' END) AS reason
  FROM n LEFT JOIN off_track o ON n.recording = o.recording AND n.cam = o.cam AND n.name = o.name LEFT JOIN stuck k ON n.recording = k.recording AND n.cam = k.cam AND n.name = k.name)
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_compaction": p1_compaction,
    "p1_twice": p1_twice,
    "p2_found": p2_found,
    "p2_poses": p2_poses,
    "p2_report": p2_report,
    "p3_found": p3_found,
    "p3_report": p3_report,
}

ORACLES = {
    "p1_found": P1_IDENT
    + """SELECT a.file_id AS file_a, b.file_id AS file_b FROM k a JOIN k b
ON a.rec = b.rec AND a.folder = b.folder AND a.frame = b.frame AND a.payload = b.payload AND a.file_id < b.file_id""",
    "p1_compaction": P1_IDENT
    + """, t AS (SELECT rec AS recording, split_part(folder, '/', 1) AS tree_key, folder, frame, payload FROM k),
n AS (SELECT recording, tree_key, count(*) AS n_files, sum(octet_length(payload) + 64) AS b FROM t GROUP BY 1, 2),
r AS (SELECT recording, tree_key, count(*) AS n_records FROM (SELECT DISTINCT recording, tree_key, folder, frame, payload FROM t) GROUP BY 1, 2)
SELECT n.recording, n.tree_key, n_files, n_files AS n_small, n_records, CAST(ceil(b / 134217728.0) AS BIGINT) AS n_out_files FROM n JOIN r ON n.recording = r.recording AND n.tree_key = r.tree_key""",
    "p1_twice": P1_IDENT
    + """, t AS (SELECT rec AS recording, split_part(folder, '/', 1) AS tree_key, folder, frame, payload FROM k),
big AS (SELECT recording, tree_key FROM t GROUP BY 1, 2 HAVING count(*) > 40)
SELECT recording, tree_key, count(*) AS n_records FROM (SELECT DISTINCT t.* FROM t JOIN big USING (recording, tree_key)) GROUP BY 1, 2""",
    "p2_report": P2_REPORT + "SELECT * FROM r WHERE reason <> ''",
    "p2_poses": P2_POSES + "SELECT * FROM f WHERE reason <> ''",
    "p2_found": P2_POSES + ", " + P2_REPORT.split("WITH ", 1)[1].replace("s AS", "rs AS", 1).replace("FROM s", "FROM rs").replace("o AS (SELECT *", "ro AS (SELECT *").replace("FROM o)", "FROM ro)")
    + "SELECT DISTINCT 'poses' AS tab, name AS rec_key FROM f WHERE reason <> '' UNION ALL SELECT DISTINCT 'poses_report', seam_id::VARCHAR FROM r WHERE reason <> ''",
    "p3_found": P3_ORPHANS + "SELECT DISTINCT id AS job_id FROM orphan",
    "p3_report": P3_ORPHANS
    + """SELECT 'jobs' AS tab, CAST(make_timestamp(CAST(floor(t) * 1000000 AS BIGINT)) AS DATE) AS day,
CAST(count(*) AS BIGINT) AS n_orphans, CAST(count(DISTINCT object_id) AS BIGINT) AS n_keys FROM orphan GROUP BY 2""",
}
