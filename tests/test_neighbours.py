"""The exact searches against brute force, where a fixed radius finds nothing."""

import numpy as np

from orrery.operators import neighbours


def cloud_of(spark, x, group="g"):
    return spark.createDataFrame([(i, group, *map(float, r)) for i, r in enumerate(x)], "seq long, dataset string, x double, y double, z double")


def sparse(rng, n):
    x = rng.normal(0, 1, (n, 3))
    x[: n // 10] *= 1000
    x[n // 2 : n // 2 + 40] = x[n // 2]  # equal places
    return x


def test_nearest_has_no_radius(spark):
    rng = np.random.default_rng(0)
    x, y = sparse(rng, 900), sparse(rng, 700) + [300, 0, 0]
    for other, own in ((x, True), (y, False)):
        d2 = ((x[:, None] - other[None]) ** 2).sum(axis=2)
        if own:
            np.fill_diagonal(d2, np.inf)
        want = np.lexsort((np.broadcast_to(np.arange(len(other)), d2.shape), d2), axis=1)[:, :4]
        a, b = cloud_of(spark, x), cloud_of(spark, other)
        got = neighbours.nearest(a, None if own else b, 4, ["dataset"]).toPandas().sort_values(["id_a", "rank"])
        assert got["id_b"].to_numpy().reshape(-1, 4).tolist() == want.tolist()
    few = neighbours.nearest(cloud_of(spark, [[0, 0, 0], [9e5, 0, 0]]), None, 4, ["dataset"]).collect()
    assert sorted((r["id_a"], r["id_b"]) for r in few) == [(0, 1), (1, 0)]


def brute_views(d):
    """Pairs of object and frame of a recording, with distances in space and on the ground."""
    from compare import duck

    from orrery.plans.binding import FRAMES, OBJECTS

    return duck(d).execute(f"""WITH {OBJECTS}, {FRAMES} SELECT id, name, sqrt((cx-px)**2 + (cy-py)**2 + (cz-pz)**2) AS dist, sqrt((cx-px)**2 + (cz-pz)**2) AS flat, sx
        FROM obj JOIN frames f ON coalesce(obj.dataset, '') = f.dataset WHERE cx IS NOT NULL AND cy IS NOT NULL AND cz IS NOT NULL AND sx IS NOT NULL""").df()


def test_every_object_has_its_nearest_camera_and_large_views(spark):
    from orrery.plans import fits, relations

    d = "/root/testdata/sf0.01"
    p = brute_views(d)
    best = p.sort_values(["dist", "name"]).groupby("id").first()
    got = {r["id"]: r["name"] for r in relations.QUERIES["j12_nearest_camera"](spark, d).collect()}
    assert got == best["name"].to_dict() and (best["dist"] > 30).any()
    span = 1183.5 * p["sx"] / p["flat"].clip(lower=1e-9)
    for least, pick in ((36.0, span >= 36), (None, span > -1)):
        want = p[(p["flat"] > 1) & pick]
        views = fits._view_candidates(spark, d, least).select("id", "name").collect()
        assert sorted(map(tuple, views)) == sorted(zip(want["id"], want["name"])) and (want["flat"] > 30).any()


def test_far_objects_have_neighbours_and_count_in_the_radius(spark):
    from compare import duck

    from orrery.plans import fits, relations
    from orrery.plans.binding import OBJECTS

    d = "/root/testdata/sf0.01"
    p = duck(d).execute(f"""WITH {OBJECTS}, o AS (SELECT id, coalesce(dataset, '') AS dataset, cx, cy, cz FROM obj WHERE cx IS NOT NULL AND cy IS NOT NULL AND cz IS NOT NULL)
        SELECT a.dataset, a.id AS a, b.id AS b, sqrt((a.cx-b.cx)**2 + (a.cy-b.cy)**2 + (a.cz-b.cz)**2) AS dist FROM o a JOIN o b ON a.dataset = b.dataset AND a.id <> b.id""").df().sort_values(["a", "dist", "b"])
    four = p.groupby("a").head(4)
    got = {(r["id_a"], r["id_b"]) for r in relations.QUERIES["j11_knn_within"](spark, d).collect()}
    assert got == set(zip(four["a"], four["b"])) and (p.groupby("a")["dist"].min() > 20).any()
    want = 1.6 * p.groupby(["dataset", "a"])["dist"].min().groupby("dataset").median()
    radius = {r["dataset"]: r["radius"] for r in fits.QUERIES["a37_point_radius"](spark, d).collect()}
    assert set(radius) == set(want.index) and all(abs(radius[k] - v) < 1e-9 * max(v, 1) for k, v in want.items())


def test_groups_without_right_points_give_nothing(spark):
    a = cloud_of(spark, [[0, 0, 0]]).union(cloud_of(spark, [[0, 0, 0], [1, 0, 0]], "alone").selectExpr("seq + 5", "dataset", "x", "y", "z"))
    got = neighbours.nearest(a, cloud_of(spark, [[2, 0, 0]]), 1, ["dataset"]).collect()
    assert [(r["id_a"], r["id_b"], r["dist"]) for r in got] == [(0, 0, 2.0)]


def test_neighbours_in_noise_take_few_distances():
    """A dense street with noise all around: nearest ones as by brute force, without a table of all distances."""
    import tracemalloc

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1, (12000, 3)) * [20, 0.5, 20], rng.normal(0, 60, (3000, 3)), np.repeat(rng.normal(0, 9, (5, 3)), 200, axis=0)])
    rank = rng.permutation(len(x))
    tracemalloc.start()
    idx, d2 = neighbours._best(x, x, rank, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6  # all distances are 2 GB
    for i in rng.choice(len(x), 200, replace=False):
        own = sum((x[i, c] - x[:, c]) ** 2 for c in range(3))
        want = np.lexsort((rank, own))[:20]
        assert idx[i].tolist() == want.tolist() and (d2[i] == own[want]).all()
    idx, d2 = neighbours._best(x[:3], x[:2], rank, 4)
    assert (idx[:, 2:] == -1).all() and np.isinf(d2[:, 2:]).all() and sorted(idx[0, :2]) == [0, 1]


def test_splats_look_for_no_cameras(spark, monkeypatch):
    from orrery.operators import fitting

    calls, around = [], neighbours.around
    monkeypatch.setattr(neighbours, "around", lambda *a, **k: calls.append(a[1]) or around(*a, **k))
    rng = np.random.default_rng(8)
    n = fitting.surface_normals(cloud_of(spark, rng.normal(0, 1, (60, 3))), None, 8).collect()
    assert calls == [None, None] and len(n) == 60 and all(r["facing"] >= 0 and abs(r["nx"] ** 2 + r["ny"] ** 2 + r["nz"] ** 2 - 1) < 1e-6 for r in n)
