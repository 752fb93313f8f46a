"""Spatial operators on points: voxels, cells, trims, z-buffers, nearest-neighbour and radius joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.geometry import voxel_key
from orrery.session import materialize

XYZ = ("x", "y", "z")
#: Points of one voxel that meet in one group of a radius join.
SLOT = 2048


def _key(side: float, axes: Sequence[str] = XYZ) -> Column:
    return voxel_key([F.col(a) for a in axes], side)


def first_per_voxel(points: DataFrame, side: float, by: Sequence[str] = (), order: str = "seq") -> DataFrame:
    """One row per voxel (and group `by`): that with the smallest `order`. Partial aggregation precedes the shuffle."""
    cols = [c for c in points.columns if c not in by]
    agg = points.withColumn("key", _key(side)).groupBy(*by, "key").agg(F.min_by(F.struct(*cols), order).alias("s"))
    return agg.select(*by, "key", "s.*")


def nearest_per_voxel(points: DataFrame, side: float, depth: str, by: Sequence[str] = ()) -> DataFrame:
    """key, zmin, n: the nearest observation of each voxel."""
    return points.groupBy(*by, _key(side).alias("key")).agg(F.min(depth).alias("zmin"), F.count("*").alias("n"))


def near_views(points: DataFrame, side: float, depth: str, by: Sequence[str] = (), ratio: float = 1.6, slack: float = 0.15) -> DataFrame:
    """Rows not much farther than the nearest observation of their voxel: depth <= max(ratio zmin, zmin + slack).

    The minimum is aggregated map-side and joined back, so that a crowded voxel is no single task's burden.
    """
    keyed = points.withColumn("key", _key(side))
    best = keyed.groupBy(*by, "key").agg(F.min(depth).alias("zmin"))
    return keyed.join(best, [*by, "key"]).filter(F.col(depth) <= F.greatest(ratio * F.col("zmin"), F.col("zmin") + slack))


def cells(points: DataFrame, side: float, by: Sequence[str] = ()) -> DataFrame:
    """Per coarse cell: its key, centre, radius, count, and the start of its points in cell order."""
    keyed = points.groupBy(*by, _key(side).alias("cell")).agg(
        *[f(a).alias(f"{n}{a}") for a in XYZ for n, f in (("lo", F.min), ("hi", F.max))], F.count("*").alias("n")
    )
    mid = [((F.col(f"lo{a}") + F.col(f"hi{a}")) / 2).alias(f"c{a}") for a in XYZ]
    radius = F.sqrt(sum(((F.col(f"hi{a}") - F.col(f"lo{a}")) ** 2 for a in XYZ), F.lit(0.0))) / 2
    order = W.partitionBy(*by).orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    return keyed.select(*by, "cell", *mid, radius.alias("radius"), "n", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("start"))


def bounds(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return points.groupBy(*by).agg(*[f(a).alias(f"{n}{a}") for a in XYZ for n, f in (("lo", F.min), ("hi", F.max))], F.count("*").alias("n"))


#: Items on a sketch's lowest level, and how far its bounds reach around a quantile, in ranks; its error is far below.
SKETCH_K, REACH = 4096, 0.003


def quantiles(rows: DataFrame, by: Sequence[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """by and one column per entry (column, share) of wanted: exact quantiles, interpolated between the two nearest values.

    A mergeable sketch brackets each quantile; only the values between the brackets, a few in a thousand, are put in
    order, so no task holds a group's distinct values. Nulls do not count. rows is read twice: pass what is written.
    """
    spec = {n: (F.col(c).cast("double"), q) for n, (c, q) in wanted.items()}
    cols = list(dict.fromkeys(c for c, _ in wanted.values()))
    sketch = rows.groupBy(*by).agg(*[f(c) for c in cols for f in (lambda c: F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(SKETCH_K)).alias("_s" + c), lambda c: F.count(c).alias("_n" + c), lambda c: F.min(F.col(c).cast("double")).alias("_l" + c), lambda c: F.max(F.col(c).cast("double")).alias("_h" + c))])
    read = lambda c, q: F.kll_sketch_get_quantile_double("_s" + c, F.lit(float(min(max(q, 0.0), 1.0))))
    edge = []
    for n, (c, q) in wanted.items():
        few = F.col("_n" + c) <= SKETCH_K  # all values are between the brackets
        edge += [F.when(few, F.col("_l" + c)).otherwise(F.col("_l" + c) if q <= REACH else read(c, q - REACH)).alias("_lo" + n)]
        edge += [F.when(few, F.col("_h" + c)).otherwise(F.col("_h" + c) if q >= 1 - REACH else read(c, q + REACH)).alias("_hi" + n), F.col("_n" + c).alias("_n" + n)]
    edges = materialize(sketch.select(*by, *edge), "quantile-edges")  # a row per group
    joined = rows.join(edges, list(by)) if by else rows.crossJoin(F.broadcast(edges))
    tagged = joined.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("q"), c.alias("v"), F.when(c < F.col("_lo" + n), -1).when(c <= F.col("_hi" + n), 0).otherwise(1).alias("side"), F.col("_n" + n).alias("n")) for n, (c, _) in spec.items()])).alias("t")).select(*by, "t.*").filter("v is not null and side < 1")
    counted = tagged.groupBy(*by, "q", "n", F.when(F.col("side") == 0, F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    w = W.partitionBy(*by, "q").orderBy(F.col("v").asc_nulls_first())
    placed = counted.withColumn("upto", F.sum("c").over(w.rowsBetween(W.unboundedPreceding, 0))).filter("v is not null")
    share = F.create_map(*[F.lit(x) for n, (_, q) in spec.items() for x in (n, float(q))])[F.col("q")]
    at = placed.withColumn("_at", (F.col("n") - 1) * share)
    hit = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    each = at.groupBy(*by, "q").agg(hit(F.floor("_at")).alias("_a"), hit(F.ceil("_at")).alias("_b"), F.max(F.col("_at") - F.floor("_at")).alias("_f"))
    value = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")
    return each.groupBy(*by).agg(*[F.max(F.when(F.col("q") == n, value)).alias(n) for n in spec])


def trim_outliers(points: DataFrame, share: float, by: Sequence[str] = (), slack: float = 0.0) -> DataFrame:
    """Points nearer to their group's median point than the given percentile of these distances (plus slack)."""
    points = materialize(points, "trim")
    middle = quantiles(points, by, {f"m{a}": (a, 0.5) for a in XYZ})
    joined = points.join(middle, list(by)) if by else points.crossJoin(F.broadcast(middle))
    r = F.sqrt(sum(((F.col(a) - F.col(f"m{a}")) ** 2 for a in XYZ), F.lit(0.0)))
    ranged = materialize(joined.withColumn("r", r).drop("mx", "my", "mz"), "trim-ranged")
    limit = quantiles(ranged, by, {"limit": ("r", share)})
    both = ranged.join(limit, list(by)) if by else ranged.crossJoin(F.broadcast(limit))
    return both.filter(F.col("r") < F.col("limit") + slack).drop("r", "limit")


def depth_band(hits: DataFrame, depth: str, by: Sequence[str], low: float = 0.15, below: float = 0.2, above: float = 0.6, least: int = 12) -> DataFrame:
    """The cluster of hits nearest to the camera: from `below` before the low percentile of depth to `above` behind it.

    Where fewer than `least` hits are in the band all hits of the group stay.
    """
    hits = materialize(hits, "band")
    cut = quantiles(hits, by, {"zlo": (depth, low)})
    joined = hits.join(cut, list(by)) if by else hits.crossJoin(F.broadcast(cut))
    inside = F.col(depth).between(F.col("zlo") - below, F.col("zlo") + above)
    n = joined.groupBy(*by).agg(F.count(F.when(inside, 1)).alias("in_band"))
    both = joined.join(n, list(by)) if by else joined.crossJoin(F.broadcast(n))
    return both.filter(inside | (F.col("in_band") < least)).drop("zlo", "in_band")


def z_buffer(pixels: DataFrame, by: Sequence[str], u: str, v: str, depth: str, cell: int = 2) -> DataFrame:
    """Per cell of `cell` pixels the smallest depth of it and its eight neighbours."""
    own = pixels.groupBy(*by, F.floor(F.col(u) / cell).alias("gx"), F.floor(F.col(v) / cell).alias("gy")).agg(F.min(depth).alias("zmin"))
    spread = own.select(*by, "gx", "gy", "zmin", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("dx")).select("*", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("dy"))
    eroded = spread.groupBy(*by, (F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy")).agg(F.min("zmin").alias("zmin"))
    return own.select(*by, "gx", "gy").join(eroded, [*by, "gx", "gy"])


def _around(side: float, rings: int = 1) -> Column:
    """Keys of a point's voxel and its neighbours."""
    steps = range(-rings, rings + 1)
    cell = [F.floor(F.col(a) / side) for a in XYZ]
    keys = [voxel_key([(cell[0] + i) * side + side / 2, (cell[1] + j) * side + side / 2, (cell[2] + k) * side + side / 2], side) for i in steps for j in steps for k in steps]
    return F.array(*keys)


def radius_join(left: DataFrame, right: DataFrame, radius: float, by: Sequence[str] = ()) -> DataFrame:
    """Pairs (id_a, id_b, dist) of points within radius, id_a from left; an equi join on voxels and their neighbours.

    left, right: seq, x, y, z and the columns `by`. Points do not pair with themselves.
    """
    a = left.select(*by, F.col("seq").alias("id_a"), *XYZ, F.explode(_around(radius)).alias("key"))
    b = right.select(*by, F.col("seq").alias("id_b"), *[F.col(c).alias(f"o{c}") for c in XYZ], voxel_key([F.col(c) for c in XYZ], radius).alias("key"))
    # a crowded voxel is cut into slots, each of which meets all that ask for the voxel
    crowd = b.groupBy(*by, "key").agg(F.ceil(F.count("*") / SLOT).cast("int").alias("slots")).filter("slots > 1")
    keys = [*by, "key"]
    slots = F.coalesce("slots", F.lit(1))
    b = b.join(crowd, keys, "left").withColumn("slot", F.pmod(F.xxhash64("id_b"), slots).cast("int")).drop("slots")
    a = a.join(crowd, keys, "left").withColumn("slot", F.explode(F.sequence(F.lit(0), slots - 1))).drop("slots")
    d2 = sum(((F.col(c) - F.col(f"o{c}")) ** 2 for c in XYZ), F.lit(0.0))
    return a.join(b, [*keys, "slot"]).withColumn("d2", d2).filter((F.col("d2") <= radius * radius) & (F.col("id_a") != F.col("id_b"))).select(*by, "id_a", "id_b", F.sqrt("d2").alias("dist"))


def knn_within(left: DataFrame, right: DataFrame, k: int, radius: float, by: Sequence[str] = ()) -> DataFrame:
    """The k nearest of `radius_join` for each left point, with their rank; ties by id."""
    w = W.partitionBy("id_a").orderBy("dist", "id_b")
    return radius_join(left, right, radius, by).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
