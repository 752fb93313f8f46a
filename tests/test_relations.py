"""Invariants and brute force on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.operators import spatial, temporal
from orrery.streaming import incremental


def cloud(spark, n=300, seed=0):
    x = np.random.default_rng(seed).uniform(-3, 3, (n, 3))
    return x, spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "seq long, x double, y double, z double")


def test_radius_and_knn(spark):
    x, df = cloud(spark)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, 9)
    got = {(r["id_a"], r["id_b"]) for r in spatial.radius_join(df, df, 0.8).collect()}
    assert got == set(zip(*map(list, np.nonzero(d <= 0.8))))
    knn = {(r["id_a"], r["rank"]): r["id_b"] for r in spatial.knn_within(df, df, 3, 0.8).collect()}
    for i in range(len(x)):
        near = [j for j in np.argsort(d[i]) if d[i, j] <= 0.8][:3]
        assert [knn.get((i, k + 1)) for k in range(len(near))] == near


def test_voxels(spark):
    _, df = cloud(spark)
    once = spatial.first_per_voxel(df, 0.5)
    twice = spatial.first_per_voxel(once.select("seq", "x", "y", "z"), 0.5)
    assert once.count() == twice.count() == df.select(*[F.floor(F.col(c) / 0.5) for c in "xyz"]).distinct().count()
    near = spatial.near_views(df.withColumn("d", F.abs("z")), 0.5, "d")
    best = df.groupBy(g.voxel_key(g.vec(""), 0.5).alias("k")).agg(F.min(F.abs("z")).alias("m"))
    assert near.groupBy("key").agg(F.min("d").alias("m")).subtract(best.select("k", "m")).count() == 0
    c = spatial.cells(df, 1.0)
    assert c.agg(F.sum("n")).head()[0] == 300 and c.orderBy(F.desc("start")).head()["start"] < 300
    assert spatial.first_per_voxel(df.limit(0), 0.5).count() == 0 and spatial.cells(df.limit(0), 1.0).count() == 0


def test_project_unproject(spark):
    k = {"fx": 600.0, "fy": 610.0, "cx": 320.0, "cy": 240.0}
    df = spark.createDataFrame([(0.3, -0.2, 4.0, 0.9, 0.1, -0.2, 0.3), (1.0, 2.0, 9.0, 1.0, 0.0, 0.0, 0.0)], "x double, y double, z double, qw double, qx double, qy double, qz double")
    n = g.norm(g.vec("q", "wxyz"))
    q = [c / n for c in g.vec("q", "wxyz")]
    eye = g.lits((0.1, 0.2, -3.0))
    cam = g.to_camera(g.vec(""), eye, q)
    u, v = g.project(cam, k)
    back = g.unproject(u, v, cam[2], k, q, eye)
    r = df.select(*[(b - F.col(c)).alias(c) for b, c in zip(back, "xyz")]).collect()
    assert max(abs(x) for row in r for x in row) < 1e-9
    again = g.quaternion_of(g.rotation_of(q))
    assert max(abs(x) for row in df.select(*[F.abs(a) - F.abs(b) for a, b in zip(again, q)]).collect() for x in row) < 1e-9


def test_chunks_own_every_row_once(spark):
    for n in (1, 5, 24, 25, 60, 100):
        df = spark.range(n).withColumn("cam", F.lit("A"))
        c = temporal.chunk_windows(df, ["cam"], ["id"], 24, 6)
        sizes = {r["chunk"]: r["n"] for r in c.groupBy("chunk").agg(F.count("*").alias("n")).collect()}
        assert c.select("id").distinct().count() == n and max(sizes.values()) <= 24
        own = temporal.owned(c, ["cam"], "id", ["id"], 6).collect()
        assert sorted(r["id"] for r in own) == list(range(n))


def test_bracket(spark):
    left = spark.createDataFrame([("r", "k1", 10), ("r", "k2", 20), ("r", "k3", 5), ("r", "k4", 95), ("q", "k5", 15)], "rec string, key string, t long")
    right = spark.createDataFrame([("r", 5, 1.0), ("r", 20, 2.0), ("r", 30, 4.0), ("r", 200, 9.0)], "rec string, t long, v double")
    for width in (1000, 30, 7):
        got = {r["key"]: (r["prev_t"], r["next_t"]) for r in temporal.bracket_join(left, right, ["rec"], ["v"], 50, width).collect()}
        assert got == {"k1": (5, 20), "k2": (5, 20)}


def test_sessions_and_merge(spark):
    t = [0, 1, 2, 3, 100, 101, 200, 201, 202, 203, 204, 205, 206]
    df = spark.createDataFrame([("a", x * 1_000_000) for x in t], "cam string, t long")
    s = temporal.gap_sessions(df, ["cam"], "t", 1_000_000, 6.0)
    n = s.groupBy("cam", "session").agg(F.count("*").alias("n"))
    assert sorted((r["session"], r["n"]) for r in n.collect()) == [(0, 4), (1, 2), (2, 7)]
    assert {r["session"]: r["merged"] for r in temporal.merge_short(n, ["cam"], 6).collect()} == {0: 0, 1: 0, 2: 2}


def test_stream_equals_batch(spark, tmp_path):
    _, df = cloud(spark)
    for i in range(3):
        df.filter(F.col("seq") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: incremental.arriving(spark, str(tmp_path / "in"), df.schema, 1)
    keys = incremental.run_to_end(incremental.fresh_voxels(stream(), 0.7).select("key"), str(tmp_path / "o1"), str(tmp_path / "c1"))
    assert keys.count() == keys.distinct().count() == df.select(g.voxel_key(g.vec(""), 0.7)).distinct().count()
    near = incremental.run_to_end(incremental.nearest_so_far(stream(), 0.7, "z"), str(tmp_path / "o2"), str(tmp_path / "c2"), "complete")
    want = spatial.nearest_per_voxel(df, 0.7, "z")
    assert near.exceptAll(want.select(*near.columns)).count() == 0 and near.count() == want.count()


def test_quantiles_are_exact(spark):
    from orrery.operators import spatial

    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 1, 30_000), np.repeat(0.25, 4_000)]
    few = [1.0, 5.0, None, 2.0]
    df = spark.createDataFrame([("big", float(v)) for v in x] + [("few", v) for v in few] + [("none", None)], "k string, v double")
    got = {r["k"]: r for r in spatial.quantiles(df, ["k"], {"a": ("v", 0.5), "b": ("v", 0.003), "c": ("v", 0.92), "d": ("v", 1.0)}).collect()}
    for n, q in (("a", 0.5), ("b", 0.003), ("c", 0.92), ("d", 1.0)):
        assert got["big"][n] == pytest.approx(np.quantile(x, q), abs=1e-12)
        assert got["few"][n] == pytest.approx(np.quantile([1.0, 2.0, 5.0], q))
    assert "none" not in got
    one = spatial.quantiles(df.filter("k = 'few'"), [], {"a": ("v", 0.5)}).collect()
    assert [tuple(r) for r in one] == [(2.0,)]


def test_neighbours_in_time_over_blocks_and_hours(spark, monkeypatch):
    from pyspark.sql import functions as F

    from orrery.operators import temporal

    monkeypatch.setattr(temporal.in_blocks, "__defaults__", (50,))
    rows = spark.range(400).select(F.lit("r").alias("k"), (F.col("id") * 37_000_000).alias("t"), F.col("id").alias("v"))
    got = temporal.beside(rows, ["k"], "t", ["t", "v"], {"before": ("v", -1), "two": ("v", 2)}).orderBy("pos").collect()
    assert [(r["pos"], r["v"], r["before"], r["two"]) for r in got] == [(i, i, i - 1 if i else None, i + 2 if i < 398 else None) for i in range(400)]


def test_crowded_voxels_are_cut_and_lose_nothing(spark, monkeypatch):
    from orrery.operators import spatial

    monkeypatch.setattr(spatial, "SLOT", 8)
    pts = spark.createDataFrame([(i, 0.1 if i < 60 else float(i), 0.0, 0.0) for i in range(70)], "seq long, x double, y double, z double")
    got = {tuple(r) for r in spatial.radius_join(pts, pts, 1.0).select("id_a", "id_b").collect()}
    x = [0.1 if i < 60 else float(i) for i in range(70)]
    assert got == {(a, b) for a in range(70) for b in range(70) if a != b and abs(x[a] - x[b]) <= 1.0}
