import itertools

import pytest
from pyspark.sql import functions as F

from orrery.operators import compaction as c

SCHEMA = "file_id long, dataset string, tree string, path string, cam string, payload binary, frame string"


def files(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


SPELLINGS = ["layers/nxyz/A_1_f.jpg", "layers\\nxyz\\A_1_f.jpg", "./layers/nxyz/A_1_f.jpg", "street_video/layers/nxyz/A_1_f.jpg", "/street_video/layers/nxyz/A_1_f.jpg", "LAYERS/NXYZ/A_1_f.jpg", "layers/nxyz/A_1_f.JPG", "layers/nxyz/A_1_f.jpeg", "layers/nxyz/A%5F1%5Ff.jpg", "layers/nxyz/A_1_f (3).jpg", "layers/nxyz/A_1_f_copy.jpg", "layers/nxyz/A_1_f.jpg.bak", "layers/nxyz//A_1_f.jpg", "layers/nxyz/A_1_f.jpg\n", "layers/nxyz/A_1_f.jpg "]


def test_spellings_are_one_file(spark):
    rows = [(i, "rec/a" + "/" * (i % 2), "layers", p, "A", bytearray(b"x"), None) for i, p in enumerate(SPELLINGS)]
    known = c.identify(files(spark, rows)).select("recording", "tree_key", "product", "frame").distinct().collect()
    assert [tuple(r) for r in known] == [("rec/a", "layers", "nxyz", "a_1_f")]


def test_other_trees_products_content_stay_apart(spark):
    rows = [(1, "r", "rgb", "rgb/A_1.jpg", "A", bytearray(b"x"), None), (2, "r", "rgb_orig", "rgb_orig/A_1.jpg", "A", bytearray(b"x"), None), (3, "r", "layers", "layers/edge/A_1.jpg", "A", bytearray(b"x"), None), (4, "r", "layers", "layers/n_xy/A_1.jpg", "A", bytearray(b"x"), None), (5, "r", "rgb", "rgb/A_1.jpg", "A", bytearray(b"y"), None), (6, "q", "rgb", "rgb/A_1.jpg", "A", bytearray(b"x"), None), (7, "r", None, "rgb/A_1.jpg", None, bytearray(b""), None), (8, "r", None, "rgb/A_1.jpg", None, None, None)]
    done = c.compact(files(spark, rows))
    assert done.copies.count() == 0
    assert done.records(spark).count() == 6  # the lone files of q and of rgb_orig are no partitions of many small files
    assert c.compact(files(spark, rows), max_small_files=0).records(spark).count() == 8


def brute(rows):
    ids = {}
    for i, k in rows:
        ids.setdefault(k, set()).add(i)
    return {tuple(p) for v in ids.values() for p in itertools.combinations(sorted(v), 2)}


def test_every_record_once_with_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(c, "PAIR_BLOCK", 7)
    rows, keys = [], []
    for i in range(300):
        k = 0 if i % 3 == 0 else i % 40
        rows.append((i, f"r{k % 2}", "rgb", f"rgb/A_{k}.jpg", "A", bytearray([k]), f"extra{i}"))
        keys.append((i, k))
    rows += rows[:20]  # delivered twice under the same id
    done = c.compact(files(spark, rows))
    got = {tuple(r) for r in c.copy_pairs(done.copies).collect()}
    assert got == brute(keys)
    kept = done.records(spark)
    assert kept.count() == len({k for _, k in keys})
    assert kept.withColumn("f", F.input_file_name()).groupBy("recording", "tree_key").agg(F.count_distinct("f").alias("n")).agg(F.max("n")).head()[0] == 1


def test_empty_and_null(spark):
    done = c.compact(files(spark, []))
    assert (done.version, done.copies.count(), c.copy_pairs(done.copies).count()) == (1, 0, 0)
    rows = [(None, None, None, None, None, None, None), (1, None, None, "", None, bytearray(b"z"), None), (2, "", None, "/", None, bytearray(b"z"), None), (None, None, None, None, None, None, None)]
    done = c.compact(files(spark, rows))
    assert done.records(spark).count() == 2  # the rows without id fold into one, 1 and 2 are copies


def test_untouched_partitions_and_threshold(spark):
    rows = [(i, "big", "rgb", f"rgb/A_{i}.jpg", "A", bytearray(b"x"), None) for i in range(10)] + [(100 + i, "small", "rgb", f"rgb/A_{i}.jpg", "A", bytearray(b"x"), None) for i in range(3)]
    done = c.compact(files(spark, rows), max_small_files=5)
    assert [r["recording"] for r in done.plan.collect()] == ["big"]
    again = c.compact(files(spark, rows[10:]), lake=done.lake)
    assert again.version == 2
    assert done.records(spark).groupBy("recording").count().count() == 2  # dynamic overwrite left the first partition


def test_conflict_is_refused(spark):
    rows = [(i, "a", "rgb", f"rgb/A_{i}.jpg", "A", bytearray(b"x"), None) for i in range(4)]
    done = c.compact(files(spark, rows))
    with pytest.raises(c.CommitConflict):
        c.compact(files(spark, rows), lake=done.lake, base_version=0)
    other = [(i, "b", "rgb", f"rgb/A_{i}.jpg", "A", bytearray(b"x"), None) for i in range(4)]
    assert c.compact(files(spark, other), lake=done.lake, base_version=0).version == 2
    log = c.SnapshotLog(spark, done.lake)
    log.reserve(2)
    with pytest.raises(c.CommitConflict):
        log.reserve(2)
    log.lease_s = -1
    assert log.reserve(2) == 3


def small(spark, rec, n, first=0, content=b"x"):
    return files(spark, [(first + i, rec, "rgb", f"rgb/A_{first + i}.jpg", "A", bytearray(content), None) for i in range(n)])


def test_failed_run_is_never_read_and_can_be_repeated(spark, monkeypatch):
    done = c.compact(small(spark, "a", 4))
    monkeypatch.setattr(c.SnapshotLog, "publish", lambda self, *a, **k: (_ for _ in ()).throw(RuntimeError("the driver died")))
    with pytest.raises(RuntimeError):
        c.compact(small(spark, "a", 6, 10), done.lake)
    monkeypatch.undo()
    assert done.records(spark).count() == 4
    again = c.compact(small(spark, "a", 6, 10), done.lake)
    assert again.version == 2 and again.records(spark).count() == 6 and again.records(spark, 1).count() == 4


def test_two_writers(spark):
    done = c.compact(small(spark, "a", 4))
    one, two = c.SnapshotLog(spark, done.lake, 0.0), c.SnapshotLog(spark, done.lake, 0.0)
    assert one.reserve(1) == 2
    two.lease_s = -1  # the first is taken for dead
    assert two.reserve(1) == 2 and two.holds(2) and not one.holds(2)
    one.release(2)
    assert two.holds(2)
    listing = f"{done.lake}/_snapshots/none"
    done.plan.limit(0).write.parquet(listing)
    with pytest.raises(c.CommitConflict):
        one.publish(2, 1, listing, state="", schema="", replaced=False)
    state = two.manifest(1)
    two.publish(2, 1, listing, state=state["state"], schema=state["schema"], replaced=False)
    assert two.current() == 2 and done.records(spark).count() == 4
    with pytest.raises(c.CommitConflict):
        two.publish(2, 1, listing, state="", schema="", replaced=False)


def test_change_published_meanwhile_is_a_conflict(spark, monkeypatch):
    done = c.compact(small(spark, "a", 4))
    log = c.SnapshotLog(spark, done.lake)
    version = log.reserve(0)
    with pytest.raises(c.CommitConflict):
        log.publish(version, 0, log.manifest(1)["partitions"], state="", schema="", replaced=False)


def test_equal_hash_is_no_proof(spark, monkeypatch):
    monkeypatch.setattr(c, "_identity", lambda: [F.lit(1)])  # every file has the same hash
    done = c.compact(files(spark, [(1, "r", "rgb", "rgb/A_1.jpg", "A", bytearray(b"x"), None), (2, "r", "rgb", "rgb/A_1.jpg", "A", bytearray(b"y"), None), (3, "r", "rgb", "rgb/A_1.jpg", "A", bytearray(b"x"), None)]))
    assert {tuple(r) for r in c.copy_pairs(done.copies).collect()} == {(1, 3)} and done.records(spark).count() == 2
