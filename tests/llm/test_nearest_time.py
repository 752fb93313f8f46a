import datetime as dt
import random

from orrery.llm.nearest_time import match_nearest

T0 = dt.datetime(2026, 6, 1, 23, 59, 59)
SCHEMA = "rec string, key string, ts timestamp, p array<double>"


def us(n):
    return T0 + dt.timedelta(microseconds=n)


def run(spark, left, right, tol=120_000, **kw):
    l, r = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    return {(x["key_left"], x["key_right"], x["gap_us"]) for x in match_nearest(l, r, ["rec"], tol, carry=["p"], **kw).collect()}


def brute(left, right, tol):
    out = set()
    for rec, k, t, _ in left:
        if None in (rec, k, t):
            continue
        near = [(abs((u - t) // dt.timedelta(microseconds=1)), u, j) for r, j, u, _ in right if r == rec and None not in (j, u)]
        if near and min(near)[0] <= tol:
            _, u, j = min(near)
            out.add((k, j, (u - t) // dt.timedelta(microseconds=1)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    mk = lambda c, n: [(rng.choice("xyy"), f"{c}{i}", us(rng.randrange(0, 20_000_000)), [float(i)]) for i in range(n)]
    left, right = mk("b", 400), mk("a", 500)
    left += left[:20] + [(None, "n", us(0), None), ("x", None, us(0), None), ("x", "t", None, None)]
    right += right[:20] + [("x", "late", None, [0.0]), ("y", "same", right[1][2], [0.0])]
    for width in (300_000_000, 700_000, 200_000):
        assert run(spark, left, right, bin_us=width) == brute(left, right, 120_000)


def test_ties_and_empty(spark):
    right = [("x", "later", us(100), None), ("x", "earlier", us(0), None), ("x", "b", us(500), None), ("x", "a", us(500), None)]
    assert run(spark, [("x", "q", us(50), None), ("x", "r", us(500), None)], right) == {("q", "earlier", -50), ("r", "a", 0)}
    assert run(spark, [], right) == set() and run(spark, [("x", "q", us(50), None)], []) == set()
    assert run(spark, [("x", "q", us(120_500), None)], right[2:]) == {("q", "a", -120_000)}
    assert run(spark, [("x", "q", us(120_501), None)], right[2:]) == set()


def test_repeated_keys_carry_the_smallest_values(spark):
    import datetime as dt

    from orrery.llm import nearest_time as n

    t0 = dt.datetime(2026, 6, 1)
    left = spark.createDataFrame([("r", "b", t0)], "recording string, key string, ts timestamp")
    right = spark.createDataFrame([("r", "a", t0, [2.0, float("nan")]), ("r", "a", t0, [2.0, 1.0]), ("r", "a", t0, [2.0, 3.0])], "recording string, key string, ts timestamp, p array<double>")
    assert [r["p"] for r in n.match_nearest(left, right, ["recording"], 10, carry=["p"]).collect()] == [[2.0, 1.0]]
