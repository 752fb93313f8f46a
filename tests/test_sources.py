import datetime as dt
import tarfile

import numpy as np
import pytest

from orrery.operators import raster
from orrery.sources import images, packs, points


def test_ply_with_other_types_and_splits(spark, tmp_path, monkeypatch):
    points.register(spark)
    fields = [("x", "<f4"), ("flag", "<u1"), ("t", "<f8"), ("n", "<u4")]
    for k in range(2):
        rows = np.zeros(250, np.dtype(fields))
        rows["x"], rows["flag"], rows["t"], rows["n"] = np.arange(250) + k * 1000, 200, 1e-3, 4_000_000_000
        (tmp_path / f"p{k}.ply").write_bytes(points.ply_bytes(fields, rows))
    df = spark.read.format("ply").load(str(tmp_path))
    assert df.dtypes == [("x", "float"), ("flag", "smallint"), ("t", "double"), ("n", "bigint")]
    assert df.count() == 500 and df.selectExpr("sum(x)").head()[0] == sum(range(250)) * 2 + 250_000 and df.head()["n"] == 4_000_000_000
    monkeypatch.setattr(points, "ROWS_PER_PARTITION", 100)
    assert [(r.first, r.n) for r in points._split("p", 0, fields, 250)] == [(0, 100), (100, 100), (200, 50)]
    (tmp_path / "bad.ply").write_bytes(b"no")
    with pytest.raises(ValueError):
        points.ply_header(str(tmp_path / "bad.ply"))


def test_empty_ply_and_overwrite(spark, tmp_path):
    points.register(spark)
    out = str(tmp_path / "o")
    df = spark.createDataFrame([(1.0, None)], "x float, r smallint").coalesce(1)
    df.write.format("ply").mode("append").save(out)
    df.write.format("ply").mode("overwrite").save(out)
    back = spark.read.format("ply").load(out).collect()
    assert [tuple(r) for r in back] == [(1.0, 0)]


def test_splat_order_and_bytes(spark, tmp_path):
    points.register(spark)
    g = spark.createDataFrame([(float(i), 0.0, 0.0, i * 20, 0, 255) for i in range(5)], "x float, y float, z float, r int, g int, b int")
    s = packs.splats(packs.gaussians(g, 0.1)).collect()
    assert [r["b"] for r in s] == [255] * 5 and s[0]["a"] == 242 and s[0]["qw"] == 255
    packs.splats(packs.gaussians(g, 0.1)).write.format("splat").mode("append").save(str(tmp_path / "s"))
    assert spark.read.format("splat").load(str(tmp_path / "s")).count() == 5


def test_raw_frames(spark, tmp_path):
    rng = np.random.default_rng(0)
    image = rng.integers(0, 4096, (8, 12))
    body = raster.pack12(image, 20)
    assert (raster.unpack12(body, 12, 8, 20) == image).all()
    assert raster.unpack12(bytes([0xAB, 0xCD, 0xEF]), 2, 1, 3).tolist() == [[0xABF, 0xCDE]]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "A_2026_06_01_23_57_57_768100_f.raw").write_bytes(body)
    (tmp_path / "raw" / "B_notime.raw12").write_bytes(body)
    (tmp_path / "raw" / "A_2026_06_01_23_57_58_768100.raw").write_bytes(body[:-1])
    df = images.raw_frames(spark, str(tmp_path))
    assert df.count() == 3
    ok = images.accepted(df, len(body))
    assert [r["ts"] for r in ok.select("ts").collect()] == [dt.datetime(2026, 6, 1, 23, 57, 57, 768100)]
    assert images.unpacked(ok, 12, 8, 20).head()["pixels"] == image.ravel().tolist()


def test_slices_of_archives(spark, tmp_path):
    tar = tmp_path / "a.tar"
    (tmp_path / "x").write_bytes(b"0123456789")
    with tarfile.open(tar, "w") as t:
        t.add(tmp_path / "x", "x")
    with tarfile.open(tar) as t:
        at = t.getmember("x").offset_data
    idx = spark.createDataFrame([("x", str(tar), at + 2, 4), ("beyond", str(tar), 10**7, 4)], "name string, tar string, offset long, size long")
    assert {r["name"]: r["content"] and bytes(r["content"]) for r in images.slices(idx).collect()} == {"x": b"2345", "beyond": None}


def test_png_round_trip_and_depth(spark):
    rng = np.random.default_rng(1)
    d = rng.integers(0, 65536, (20, 30))
    d[0, :5] = 0
    assert (images.read_png16(images.write_png16(d)) == d).all()
    df = spark.createDataFrame([("f", bytearray(images.write_png16(d))), ("bad", bytearray(b"x")), ("none", None)], "frame string, content binary")
    px = images.depth_pixels(df).toPandas()
    assert len(px) == (d > 0).sum() and px.z.sum() == pytest.approx(d.sum() / 1000)
    with pytest.raises(ValueError):
        images.read_png16(b"nothing")


def test_mounts(spark):
    s = spark.createDataFrame([("A", "s2", 180.0), ("A", "s1", None), ("A", "s3", 0.0), ("B", "s1", None), ("C", "s1", 0.0)], "cam string, name string, rotation_deg double")
    assert {r["cam"]: r["quarter_turns"] for r in images.mounts(s).collect()} == {"A": 2, "B": 3, "C": 0}
    with pytest.raises(Exception, match="unknown mount"):
        images.mounts(spark.createDataFrame([("D", "s", 90.0)], s.schema)).collect()


def test_snapshot_drops_empty_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, None, [1.0])], "a int, b int, c array<double>")
    assert packs.write_snapshot(df, str(tmp_path / "s")) == ["a", "c"]


def test_raster_kernels():
    z = np.add.outer(np.sin(np.arange(20) / 3), np.cos(np.arange(30) / 4))
    p, q = np.zeros_like(z), np.zeros_like(z)
    p[:, :-1], q[:-1] = np.diff(z, axis=1), np.diff(z, axis=0)
    back, residual = raster.integrate(p, q)
    assert residual < 1e-3 and np.abs(back - (z - z.mean())).max() < 1e-2
    mask = np.zeros((6, 8), bool)
    mask[0, 0] = mask[1, 1] = mask[4, 5] = mask[4, 6] = True
    assert raster.label(mask)[1] == 2 and raster.label(mask, diagonal=False)[1] == 3 and raster.label(np.zeros((3, 3), bool))[1] == 0
    assert not raster.edge(np.ones((5, 5, 3))).any()
    assert raster.laplacian(np.ones((5, 5))).max() == 0
    ring = np.zeros((60, 60), bool)
    ring[10:50, [10, 49]] = ring[[10, 49], 10:50] = True
    assert [s[4] for s in raster.segments(ring, 3, 700)] == [60 * 60 - 1600, 38 * 38]
    n = np.zeros((6, 6, 3))
    n[..., 0], n[..., 2] = 0.5, 0.8
    n[2, 3, 0] = -0.5
    assert (raster.relax(n)[..., 0] == 0.5).all()
    assert len(raster.outline(np.array([[0.0, 0], [1, 0], [1, 1]]), 4)) == 12


def test_splats_keep_their_order(spark, tmp_path):
    points.register(spark)
    g = spark.createDataFrame([(float(i), 0.0, 0.0, (i * 7) % 256, 0, 255) for i in range(2000)], "x float, y float, z float, r int, g int, b int").repartition(6)
    gs = packs.gaussians(g, 0.1).withColumn("opacity", (packs.F.col("x") / 500).cast("float"))
    packs.splats(gs).write.format("splat").mode("append").save(f"file://{tmp_path}/s")
    rows = spark.read.format("splat").load(str(tmp_path / "s")).collect()
    alpha = [r["a"] for r in rows]
    assert len(rows) == 2000 and alpha == sorted(alpha, reverse=True)


def test_sqlite_round_trip(spark, tmp_path):
    from orrery.sources import sqlite

    df = spark.createDataFrame([(1, "a", None), (2, None, 0.5), (3, "ä'\"", -1.0)], "id long, s string, v double").repartition(2)
    sqlite.write(df, str(tmp_path / "db"), "t")
    assert sorted(map(tuple, sqlite.read(spark, str(tmp_path / "db"), "t", "id long, s string, v double").collect())) == [(1, "a", None), (2, None, 0.5), (3, "ä'\"", -1.0)]


def test_contour_and_closed_spline():
    yy, xx = np.mgrid[0:60, 0:80]
    disc = (yy - 30) ** 2 + (xx - 40) ** 2 <= 20**2
    border = raster.contour(disc)
    radius = np.hypot(border[:, 0] - 40, border[:, 1] - 30)
    assert 19 < radius.min() and radius.max() <= 20 and np.abs(np.diff(border, axis=0)).max() == 1
    curve, off = raster.closed_spline(border)
    assert off < 0.02 and np.abs(np.hypot(curve[:, 0] - 40, curve[:, 1] - 30) - 20).max() < 1
    assert np.linalg.norm(curve[0] - curve[-1]) < 1e-9 and np.allclose(raster.periodic_basis(np.linspace(0, 1, 50), 16).sum(1), 1)
    comb = np.zeros((40, 120), bool)
    comb[20:], comb[:, ::4] = True, True
    assert raster.closed_spline(raster.contour(comb), 4, 64, 0.01)[0] is None  # abstains
    assert raster.closed_spline(raster.contour(np.zeros((4, 4))))[0] is None and len(raster.contour(np.eye(1, dtype=bool))) == 1
