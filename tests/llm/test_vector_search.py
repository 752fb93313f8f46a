import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import vector_search as v


def search(spark, rows, dims, k, asks, **kw):
    cols = [f"c{i}" for i in range(dims)]
    df = spark.createDataFrame([(g, i, *map(float, x)) for g, i, x in rows], "g string, id long, " + ", ".join(f"{c} double" for c in cols))
    df = df.withColumn("is_query", F.lit("clash")).withColumn("group", F.lit(1))
    out = v.nearest_vectors(df, "g", "id", [F.col(c) for c in cols], k, asks, **kw).collect()
    return {(r["query"], r["rank"]): (r["neighbour"], r["distance"]) for r in out}


def brute(rows, k, asks):
    out, seen = {}, {}
    for g, i, x in rows:
        if np.isfinite(x).all():
            seen.setdefault((g or "", i), []).append(np.array(x, float))
    for (g, i), places in seen.items():
        if asks(i):
            d = sorted((min(np.linalg.norm(p - q) for p in places[:1] for q in qs), j) for (h, j), qs in seen.items() if h == g and j != i)
            for n, (dist, j) in enumerate(d[:k]):
                out[i, n + 1] = (j, dist)
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for key, (j, dist) in want.items():
        assert got[key][1] == pytest.approx(dist, abs=1e-9), key
        assert got[key][0] == j or got[key][1] == pytest.approx(dist, abs=1e-9)


@pytest.mark.parametrize("size", [512, 16])
def test_exact_in_space(spark, size):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(5, 0.01, (200, 3)), rng.uniform(-900, 900, (20, 3)), np.zeros((60, 3))]).astype(np.float32)
    rows = [("hot" if i % 3 else "cold", i, x[i]) for i in range(len(x))]
    rows += rows[:40] + [("hot", 9001, (np.nan, 0, 0)), ("hot", 9002, (0, np.inf, 0)), (None, 9003, (1, 1, 1)), (None, 9004, (1, 1, 2)), ("lone", 9005, (0, 0, 0))]
    asks = lambda i: i % 5 == 0 or i >= 9000
    same(search(spark, rows, 3, 8, (F.col("id") % 5 == 0) | (F.col("id") >= 9000), list_size=size), brute(rows, 8, asks))


def test_empty(spark):
    assert search(spark, [], 3, 4, F.lit(True)) == {}
    assert search(spark, [("a", 1, (0, 0, 0)), ("a", 2, (0, 0, 1))], 3, 4, F.lit(False)) == {}


def test_recall_in_many_dimensions(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (20, 32))
    x = centres[rng.integers(0, 20, 1500)] + rng.normal(0, 0.3, (1500, 32))
    rows = [("g", i, x[i]) for i in range(1500)]
    got = search(spark, rows, 32, 10, F.col("id") % 20 == 0, list_size=64)
    want = brute(rows, 10, lambda i: i % 20 == 0)
    hit = {(q, got[q, n][0]) for q, n in got} & {(q, j) for (q, _), (j, _) in want.items()}
    assert len(hit) >= 0.9 * len(want)


def test_threshold_never_cuts_deep_in_few_dimensions():
    r2 = np.array([4.0])
    assert all(v.threshold(r2, s, 3, 2.1)[0] == 4.0 for s in (1, 2, 3))
    assert v.threshold(r2, 8, 64, 2.1)[0] < 4.0
