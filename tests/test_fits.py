import math

import numpy as np
import pytest

from orrery.operators import choosing, fitting
from orrery.operators import mesh as m


def frame(spark, x, cols="x y z"):
    names = cols.split()
    return spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, " + ", ".join(f"{c} double" for c in names))


def turn(yaw):
    c, s = math.cos(yaw), math.sin(yaw)
    return np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]])


def test_smallest_rectangle_finds_a_turned_box():
    rng = np.random.default_rng(0)
    p = rng.uniform(-1, 1, (400, 2)) * [3, 1]
    p = np.concatenate([p, [[3, 1], [3, -1], [-3, 1], [-3, -1]]])
    for yaw in (0.0, 0.3, 1.2, 2.9):
        r = np.array([[math.cos(yaw), -math.sin(yaw)], [math.sin(yaw), math.cos(yaw)]])
        centre, long, short, got = fitting.smallest_rectangle(p @ r.T + [5, -2])
        assert (long, short) == pytest.approx((6, 2)) and centre == pytest.approx([5, -2])
        assert abs((got - yaw + math.pi / 2) % math.pi - math.pi / 2) < 1e-6
    assert fitting.smallest_rectangle(np.array([[1.0, 2.0]]))[1:] == (0.0, 0.0, 0.0)
    assert fitting.smallest_rectangle(np.zeros((0, 2)))[1] == 0.0
    assert fitting.smallest_rectangle(np.array([[0.0, 0], [1, 1], [2, 2]]))[1] == pytest.approx(math.hypot(2, 2))


def test_oriented_box(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (3000, 3)) * [4, 1, 2] @ turn(0.5).T + [10, 5, -3]
    b = fitting.oriented_box(frame(spark, x), ["grp"]).head()
    assert b["length"] == pytest.approx(8, abs=0.15) and b["width"] == pytest.approx(4, abs=0.15) and b["height"] == pytest.approx(1.9, abs=0.1)
    assert [b["cx"], b["cz"]] == pytest.approx([10, -3], abs=0.1) and b["n"] == 3000
    assert fitting.oriented_box(frame(spark, [[1, 2, 3], [float("nan"), 0, 0]]), ["grp"]).head()["length"] == 0.0


def test_similarity_is_found_despite_outliers(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(0, 1, (200, 3))
    b = 2.5 * a @ turn(0.7).T + [1, 2, 3]
    b[:8] += 30
    s = fitting.similarity(frame(spark, np.c_[a, b], "ax ay az bx by bz"), ["grp"]).head()
    assert s["s"] == pytest.approx(2.5, abs=1e-6) and np.array(s["r"]).reshape(3, 3) == pytest.approx(turn(0.7), abs=1e-6) and s["t"] == pytest.approx([1, 2, 3], abs=1e-5)
    assert fitting.similarity(frame(spark, np.zeros((2, 6)), "ax ay az bx by bz"), ["grp"]).head()["s"] is None


def test_rotation_means_and_alignment(spark):
    rng = np.random.default_rng(3)
    rows = [turn(0.4 + e).ravel() for e in rng.normal(0, 0.01, 50)]
    cols = " ".join(f"r{i}" for i in range(9))
    r = fitting.mean_rotation(frame(spark, rows, cols), ["grp"], cols.split()).head()["r"]
    assert np.array(r).reshape(3, 3) == pytest.approx(turn(0.4), abs=0.01)
    a = rng.normal(0, 1, (120, 3))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = a @ turn(0.9).T
    b[:6] = -b[:6]
    got = fitting.align_vectors(frame(spark, np.c_[a, b, np.ones(120)], "ax ay az bx by bz w"), ["grp"], ["ax", "ay", "az"], ["bx", "by", "bz"], "w").head()
    assert np.array(got["r"]).reshape(3, 3) == pytest.approx(turn(0.9), abs=1e-6)


def test_plane_axes_and_normals(spark):
    rng = np.random.default_rng(4)
    ground = np.c_[rng.uniform(-20, 20, 900), rng.normal(0.5, 0.02, 900), rng.uniform(-20, 20, 900)]
    x = np.r_[ground, rng.uniform(-20, 20, (300, 3)) + [0, 21, 0]]
    p = fitting.ground_plane(frame(spark, x), ["grp"]).head()
    assert p["ny"] == pytest.approx(1, abs=1e-3) and p["offset"] == pytest.approx(0.5, abs=0.02) and 0.7 < p["share"] < 0.8
    axes = fitting.principal_axes(frame(spark, rng.normal(0, 1, (2000, 3)) * [9, 1, 4]), ["grp"]).head()
    assert abs(axes["axes"][0]) > 0.99 and abs(axes["axes"][5]) > 0.99 and axes["values"][0] > axes["values"][1]
    pts = spark.createDataFrame([(i, float(i % 20), 0.0, float(i // 20)) for i in range(400)], "seq long, x double, y double, z double")
    from orrery.operators.spatial import knn_within

    near = knn_within(pts, pts, 8, 1.6).select("id_a", "id_b")
    cams = spark.createDataFrame([(5.0, 10.0, 5.0)], "x double, y double, z double")
    n = fitting.normals(pts, near, cams).collect()
    assert len(n) == 400 and all(r["ny"] == pytest.approx(1) for r in n)


def test_track_fit(spark):
    q = np.c_[np.arange(24) * 0.1, np.zeros(24), np.zeros(24)]
    p = 3 * q + [1, 2, 3]
    p[5] += 40
    f = fitting.fit_track(frame(spark, np.c_[q, p], "qx qy qz px py pz"), ["grp"], 30).head()
    assert f["scale"] == pytest.approx(3, abs=0.05)
    assert fitting.fit_track(frame(spark, np.zeros((4, 6)), "qx qy qz px py pz"), ["grp"]).head()["scale"] == 0.0


def test_greedy_choices(spark):
    rows = [(1, f"n{i:02}", "A", i, i * 0.1, 100.0, 0.5) for i in range(40)] + [(1, "far", "B", 0, 2.5, 40.0, 0.1), (2, "only", "A", 3, None, None, None)]
    c = spark.createDataFrame(rows, "id int, name string, cam string, i int, bearing double, span double, vis double")
    got = choosing.auto_views(c, ["id"], 5).orderBy("id", "rank").collect()
    first = [r["name"] for r in got if r["id"] == 1]
    assert first[0] == "n00" and len(first) == 5 and [r["name"] for r in got if r["id"] == 2] == ["only"]
    picked = sorted(int(n[1:]) for n in first if n != "far")
    assert all(b - a > 3 for a, b in zip(picked, picked[1:]))
    q = spark.createDataFrame([(1, "a", 10.0, True, 0.0), (1, "b", 9.9, True, 1.0), (1, "c", 8.0, True, 90.0), (2, "x", 1.0, False, None), (2, "y", 3.0, False, 5.0), (2, "z", 2.0, False, 5.0)], "id int, name string, score double, ok boolean, bearing double")
    got = choosing.quality_views(q, ["id"], 2).orderBy("id", "rank").collect()
    assert [(r["id"], r["name"]) for r in got] == [(1, "a"), (1, "c"), (2, "y"), (2, "z")]


def test_chain(spark):
    s = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.25), ("a", 3, None), ("a", 4, 1.0), ("a", 7, 2.0), ("a", 8, 1.0)], "cam string, chunk int, log_ratio double")
    got = {r["chunk"]: r["log_scale"] for r in choosing.chain_scales(s, ["cam"]).collect()}
    assert got == {1: 0.0, 2: 0.25, 3: 0.0, 4: 1.0, 7: 0.0, 8: 1.0}


def test_components_match_union_find(spark):
    rng = np.random.default_rng(6)
    n = 150
    e = [tuple(map(int, p)) for p in rng.integers(0, n, (90, 2))] + [(i, i + 1) for i in range(100, 140)]
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in e:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = m.components(spark.range(n), spark.createDataFrame(e, "f long, g long"), "id", ("f", "g")).collect()
    assert {r["id"]: r["component"] for r in got} == {i: root(i) for i in range(n)}
    lone = m.components(spark.range(3), spark.createDataFrame([], "f long, g long"), "id", ("f", "g")).collect()
    assert {(r["id"], r["component"]) for r in lone} == {(0, 0), (1, 1), (2, 2)}


def test_small_segments_merge(spark):
    lab = spark.createDataFrame([(i, 0) for i in range(50)] + [(50, 50), (51, 51)], "fid long, component long")
    adj = spark.createDataFrame([(49, 50), (50, 51)], "f long, g long")
    assert {r["component"] for r in m.merge_small(lab, adj, "fid", 0.1).collect()} == {0}


def test_surface_of_solid_cells():
    from orrery.operators import mesh

    quads, corners = mesh.surface_squares(np.array([[0, 0, 0]]))
    assert len(quads) == 6 and len(corners) == 8
    c = corners[quads].astype(float)
    n = np.cross(c[:, 1] - c[:, 0], c[:, 2] - c[:, 0])
    assert ((c.mean(1) - 0.5) * n).sum(1).min() > 0  # outwards
    block = np.array([[i, j, k] for i in range(4) for j in range(5) for k in range(6)])
    quads, corners = mesh.surface_squares(block)
    assert len(quads) == 2 * (4 * 5 + 5 * 6 + 4 * 6)
    edges, times = np.unique(np.sort(np.concatenate([quads[:, [p, (p + 1) % 4]] for p in range(4)]), axis=1), axis=0, return_counts=True)
    assert (times == 2).all() and len(corners) - len(edges) + len(quads) == 2  # closed, in one piece, without holes
    even = mesh.taubin(corners, edges)
    assert np.abs(even.mean(0) - corners.mean(0)).max() < 0.05 and np.ptp(even, axis=0).min() > 3
