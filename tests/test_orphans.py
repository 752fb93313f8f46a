import random

from pyspark.sql import functions as F

from orrery.operators import orphans as o

DAY = 86_400


def brute(refs, parents):
    out = []
    for i, k, t in refs:
        if k is None:
            continue
        at = float("inf") if t is None else t
        if not any(p == k and c is not None and c <= at and (d is None or d > at) for p, c, d in parents):
            out.append(i)
    return sorted(out)


def run(spark, refs, parents):
    r = spark.createDataFrame(refs, "id long, key long, at double")
    p = spark.createDataFrame(parents, "key long, created double, deleted double")
    return sorted(x["id"] for x in o.orphans(r, p).collect())


def test_against_brute_force(spark):
    rng = random.Random(1)
    parents = [(rng.choice([rng.randrange(200), rng.randrange(-50, 0), 40_000 + rng.randrange(99), 1 << 40]), DAY * rng.uniform(0, 6), rng.choice([None, None, DAY * rng.uniform(0, 8)])) for _ in range(160)]
    parents += parents[:30] + [(7, None, None), (5, DAY * 2.0, DAY * 2.0)]
    refs = [(i, rng.choice([None, 5, rng.randrange(260), -rng.randrange(60), 40_000 + rng.randrange(120), 1 << 40, 1 << 41]), rng.choice([None, DAY * rng.uniform(0, 8), DAY * 2.0, DAY * 3.0])) for i in range(900)]
    assert run(spark, refs, parents) == brute(refs, parents)


def test_empty_sides(spark):
    assert run(spark, [], []) == []
    assert run(spark, [(1, 2, 3.0)], []) == [1]
    assert run(spark, [], [(1, 2.0, None)]) == []


def test_seconds_and_dictionary(spark):
    df = spark.createDataFrame([(1.7e12,), (1.7e9,), (None,)], "t double").select(o.seconds(F.col("t")).alias("t"))
    assert [r["t"] for r in df.collect()] == [1.7e9, 1.7e9, None]
    keys = spark.createDataFrame([(k,) for k in ["b", "a", None, "c", "b", "ä", ""]], "k string")
    codes = {r["k"]: r["code"] for r in o.dictionary(keys, "k").collect()}
    assert sorted(codes.values()) == list(range(5)) and codes[""] == 0 and codes["a"] < codes["b"] < codes["c"]


def test_sparse_keys_go_through_the_dictionary(spark):
    from pyspark.sql import functions as F

    ids = spark.range(400).select(F.xxhash64("id").alias("key"), (F.col("id") % 7).alias("n"))
    parents = ids.filter("n <> 3").select("key", F.lit(10.0).alias("created"), F.when(F.col("n") == 5, 50.0).alias("deleted"))
    refs = ids.select("key", "n", F.lit(60.0).alias("at"))
    assert o.is_sparse(refs, parents)
    codes = o.dictionary(refs, "key").toPandas()["code"]
    assert sorted(codes) == list(range(400))
    for encode in (None, True, False):
        got = o.orphans(refs, parents, encode).groupBy("n").count().collect()
        assert {r["n"]: r["count"] for r in got} == {3: 57, 5: 57}
    dense = spark.range(1000).select(F.col("id").alias("key"))
    assert not o.is_sparse(dense, dense)
