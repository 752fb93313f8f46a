import datetime as dt

import numpy as np
import pytest

from orrery.operators import spikes as s

T0 = dt.datetime(2026, 6, 1, 23, 58)
SCHEMA = "recording string, cam string, name string, ts timestamp, p array<double>"


def track(n, seed=0, step=0.5):
    rng = np.random.default_rng(seed)
    p = np.cumsum(np.c_[np.full(n, step), np.zeros(n), rng.normal(0, 0.05, n)], axis=0)
    p[:, 1] = 1.5 + rng.normal(0, 0.001, n)
    return np.round(p, 6)


def rows_of(p, rec="r", cam="A"):
    return [(rec, cam, f"{cam}_{i}", T0 + dt.timedelta(seconds=0.2 * i), [float(v) for v in q]) for i, q in enumerate(p)]


def flagged(spark, rows):
    return {r["name"]: r["reason"] for r in s.flag_track(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("block", [4096, 40])
def test_cases_and_only_these(spark, monkeypatch, block):
    monkeypatch.setattr(s, "BLOCK", block)
    monkeypatch.setattr(s.with_margins, "__defaults__", (block, 32))
    p = track(1200)
    p[300:] += 250.0  # a hole: the track goes on elsewhere
    p[700:760] = p[700] + np.random.default_rng(5).normal(0, 0.004, (60, 3)).round(6)  # standing still with jitter
    p[760:] += p[700] - p[760] + 0.5
    p[50, 0] = np.nan
    p[90, 1] = 990000000.0
    p[150:153] += [12.0, 0, 9.0]
    p[500] += [0, -8.0, 0]
    p[900:906, 2] = p[900, 2]
    p[1000:1004, 0] = p[1000, 0]  # four are not enough
    want = {"A_50": "impossible", "A_90": "impossible", "A_500": "off_track", **{f"A_{i}": "off_track" for i in (150, 151, 152)}, **{f"A_{i}": "stuck" for i in range(900, 906)}}
    rows = rows_of(p)
    rows += rows[100:200]
    assert flagged(spark, rows) == want


def test_odd_inputs(spark):
    assert flagged(spark, []) == {}
    rows = [("r", "A", "n1", None, [1.0, 2.0, 3.0]), ("r", "A", "n2", T0, None), ("r", None, "n3", T0, [1.0, None, 3.0]), (None, "B", "n4", T0, [float("inf"), 0.0, 0.0]), ("r", "C", "n5", T0, [1.0, 2.0])]
    assert flagged(spark, rows) == {"n3": "impossible", "n4": "impossible", "n5": "impossible"}


def test_readings(spark):
    v = [0.2, 0.21, 0.19, float("nan"), -1.0, 0.2, 5.0, 0.22, 0.18, 0.3, 0.3, 0.3, 0.3, 0.3, None, 0.25, 0.9]
    rows = [(i, "r", "A", 0, i, x, T0) for i, x in enumerate(v)] + [(100 + i, "r", "B", 0, i, None, T0) for i in range(3)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "seam_id long, recording string, cam string, run_no int, chunk int, v double, ts timestamp")
    got = {r["seam_id"]: r["reason"] for r in s.flag_readings(df, "seam_id", "v", ["run_no", "chunk"]).collect()}
    assert got == {3: "impossible", 4: "impossible", 6: "fence", **{i: "stuck" for i in range(9, 14)}}
    assert s.flag_readings(df.limit(0), "seam_id", "v", ["run_no", "chunk"]).count() == 0


def test_sketch_is_exact_for_small_sources_and_near_for_large(spark):
    from pyspark.sql import functions as F

    df = spark.range(200_000).select((F.col("id") % 2).cast("string").alias("src"), F.col("id").cast("double").alias("v"), (F.col("id") % 24).alias("h"))
    q = s.source_quantiles(s.hour_sketches(df, ["src"], F.col("h"), F.col("v")), ["src"], {"med": 0.5})
    for r in q.collect():
        assert abs(r["med"] - 100_000) < 2_000
