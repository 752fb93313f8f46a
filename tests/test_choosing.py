"""Greedy choices of many sets at once, and of sets that are never made as pairs, against the plain rule."""

import re

import numpy as np
from pyspark.sql import functions as F

from orrery.operators import choosing

INF = float("inf")


def plain(score, ok, bearing, k):
    """Places of the views of one set, in order of name, one after the other."""
    score, bearing, chosen, left = np.nan_to_num(score, posinf=INF, neginf=-INF), np.radians(bearing), [], set(np.flatnonzero(ok))
    while left and len(chosen) < k:
        sides = [min([np.degrees(abs((bearing[i] - bearing[j] + np.pi) % (2 * np.pi) - np.pi)) for j in chosen if np.isfinite(bearing[i] + bearing[j])], default=INF) for i in range(len(score))]
        best = max(sorted(left), key=lambda i: score[i] * (0.4 + 0.6 * min(sides[i] / 35, 1)))
        chosen.append(best)
        left.discard(best)
    return chosen or sorted(range(len(score)), key=lambda i: (-score[i], i))[:2]


def test_many_sets_choose_at_once():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 30, 200)
    start, n = np.r_[0, np.cumsum(sizes)[:-1]], sizes.sum()
    score, ok = rng.integers(1, 9, n) * 1.0, rng.random(n) < np.repeat(rng.choice([0, 0.3, 1], 200), sizes)
    bearing = rng.integers(0, 36, n) * 10.0
    bearing[rng.random(n) < 0.1], score[rng.random(n) < 0.05] = np.nan, np.nan
    at, rank = choosing.best_views(start, score, ok, bearing, 8)
    got = sorted(zip(np.searchsorted(start, at, "right") - 1, rank, at))
    want = [(i, j + 1, s + p) for i, (s, m) in enumerate(zip(start, sizes)) for j, p in enumerate(plain(score[s : s + m], ok[s : s + m], bearing[s : s + m], 8))]
    assert got == want


def test_views_of_objects_without_pairs(spark):
    """Dense and far frames, frames on the object, several in one place, sizes and places of no use."""
    rng = np.random.default_rng(4)
    p = np.concatenate([rng.normal(0, 2, (500, 2)), rng.normal(0, 200, (400, 2)), np.repeat(rng.normal(5, 1, (20, 2)), 10, axis=0)])
    f = [(f"f{i:04d}", "r", *map(float, x)) for i, x in enumerate(p[rng.permutation(len(p))])] + [(f"s{i}", "small", float(3 * i), 0.0) for i in range(5)]
    o = [(i, "r", *map(float, x), float(s)) for i, (x, s) in enumerate(zip(rng.normal(0, 60, (150, 2)), rng.choice([0.01, 0.3, 4.0], 150)))]
    o += [(200 + i, "r", x, 1.0, s) for i, (x, s) in enumerate([(1.0, 0.0), (1.0, -1.0), (1.0, INF), (INF, 1.0), (-INF, INF), (1e7, 0.3)])]
    o += [(300, "small", 0.5, 0.0, 0.3), (301, "small", 1e5, 0.0, 0.3), (302, "none", 0.0, 0.0, 1.0)]
    objects, frames = spark.createDataFrame(o, "id long, dataset string, cx double, cz double, sx double"), spark.createDataFrame(f, "name string, dataset string, px double, pz double")
    dist = F.hypot(F.col("px") - F.col("cx"), F.col("pz") - F.col("cz"))
    both = objects.join(frames, "dataset").withColumn("score", 1183.5 * F.col("sx") / dist).filter(dist > 1)
    all_ = both.select("id", "name", "score", (F.col("score") > 10).alias("ok"), F.degrees(F.atan2(F.col("px") - F.col("cx"), F.col("pz") - F.col("cz"))).alias("bearing"))
    want, got = (sorted(map(tuple, df.select("id", "name", "rank").collect())) for df in (choosing.quality_views(all_, ["id"]), choosing.near_quality_views(objects, frames)))
    assert got == want and len({r[0] for r in got}) == 158


def test_objects_and_frames_do_not_meet_in_a_join(spark):
    from orrery.plans import fits

    plan = fits.QUERIES["o05_quality_views"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert all("need" in line for line in plan.split("\n") if re.search(r"\bJoin\b", line))


def test_sets_are_judged_many_at_a_time_and_whole(spark, monkeypatch):
    """Sets that go over batches, or are larger than one; no call per set."""
    monkeypatch.setattr(choosing, "BATCH", 20)
    rng = np.random.default_rng(5)
    sizes = [*rng.integers(1, 9, 100), 90, 1]
    rows = [(None if i == 7 else i, j, float(rng.integers(1, 50)), bool(rng.random() < 0.7), float(rng.integers(0, 360))) for i, m in enumerate(sizes) for j in range(m)]
    df = spark.createDataFrame(rows, "id long, name long, score double, ok boolean, bearing double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        kept = choosing.quality_views(df, ["id"])
        got = sorted((-1 if r["id"] is None else r["id"], r["rank"], r["name"]) for r in kept.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for i in range(len(sizes)):
        own = [r for r in rows if r[0] == (None if i == 7 else i)]
        want += [(-1 if i == 7 else i, n + 1, p) for n, p in enumerate(plain(*(np.array([r[c] for r in own]) for c in (2, 3, 4)), 8))]
    assert got == sorted(want)
    assert "InPandas" not in kept._jdf.queryExecution().optimizedPlan().toString()
