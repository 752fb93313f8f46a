"""Close-up assets: packs turned, centred and scaled to a unit box, and written as splats."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators.fitting import surface_normals
from orrery.operators.spatial import quantiles
from orrery.operators.spikes import numbered
from orrery.session import materialize

XYZ = ("x", "y", "z")
RGB = ("r", "g", "b")
SLICES = 96  # of a thin pack, along its height
BLOCK = 65_536  # splats whose order one task looks at


def close_up(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """points with x, y, z in the frame of the close-up, `scale`, `tall` and `wide`: y is up, x the long horizontal axis.

    The axis is the first principal one on the ground, turned by at most 90 degrees from x. The middle is halfway between the
    1st and the 99th percentile of each axis; the largest extent between the 0.5th and the 99.5th becomes 1. tall and wide
    are the extents between the 1st and the 99th, of y and the larger of x and z. Points without coordinates stay so.
    """
    points = materialize(points, "close-up")
    m = points.groupBy(*by).agg(F.covar_pop("x", "z").alias("_c"), (F.var_pop("x") - F.var_pop("z")).alias("_d"))
    turn = materialize(m.select(*by, (0.5 * F.atan2(2 * F.col("_c"), F.col("_d"))).alias("_th")), "close-up-turn")  # a row per group
    x, z, th = F.col("x"), F.col("z"), F.col("_th")
    turned = points.join(turn, list(by)).withColumn("_a", x * F.cos(th) + z * F.sin(th)).withColumn("_b", z * F.cos(th) - x * F.sin(th))
    turned = materialize(turned.drop("x", "z", "_th").withColumnsRenamed({"_a": "x", "_b": "z"}), "close-up-turned")
    q = quantiles(turned, by, {f"_{c}{n}": (c, s) for c in XYZ for n, s in (("l", 0.01), ("h", 0.99), ("a", 0.005), ("b", 0.995))})
    size = F.greatest(*[F.col(f"_{c}b") - F.col(f"_{c}a") for c in XYZ], F.lit(1e-6))
    reach = {c: (F.col(f"_{c}h") - F.col(f"_{c}l")) / size for c in XYZ}
    both = turned.join(q, list(by), "left").withColumns({"scale": 1 / size, "tall": reach["y"], "wide": F.greatest(reach["x"], reach["z"])})
    for c in XYZ:
        both = both.withColumn(c, (F.col(c) - (F.col(f"_{c}l") + F.col(f"_{c}h")) / 2) * F.col("scale"))
    return both.drop(*[f"_{c}{n}" for c in XYZ for n in "lhab"])


def thin_colours(splats: DataFrame, by: Sequence[str]) -> DataFrame:
    """splats of close-ups with the colours of thin ones (over three times as tall as wide, more than 500 points) smoothed.

    Colour varies little around a pole: each colour keeps three tenths of what sets it apart from the median of its slice,
    of SLICES along the height; slices with fewer than five colours lie between their neighbours', and a Gaussian of 25
    slices runs along. Colours stay whole numbers; points without a colour get none. splats is read three times.
    """
    placed = splats.filter("tall > 3 * wide and y is not null")
    thin = materialize(placed.groupBy(*by).agg(F.min("y").alias("_low"), F.count("*").alias("_n")).filter("_n > 500").drop("_n"), "thin")  # a row per group
    at = F.least(F.floor((F.col("y") - F.col("_low")) / F.greatest("tall", F.lit(1e-6)) * SLICES), F.lit(SLICES - 1)).cast("int")
    sliced = materialize(placed.dropna(subset=list(RGB)).join(thin, list(by)).select(*by, at.alias("_slice"), *RGB), "thin-slices")
    middle = quantiles(sliced, [*by, "_slice"], {c: (c, 0.5) for c in RGB})
    enough = sliced.groupBy(*by, "_slice").agg(F.count("*").alias("_n")).filter("_n >= 5")
    types = dict(splats.dtypes)
    shape = ", ".join([f"`{c}` {types[c]}" for c in by] + ["_slice int"] + [f"_{c} double" for c in RGB])
    weights = np.exp(-0.5 * (np.arange(-12, 13) / 4.0) ** 2)

    def along(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, every = pdf.sort_values("_slice"), np.arange(SLICES)
        out = {"_slice": every}
        for c in RGB:
            whole = np.interp(every, pdf["_slice"], pdf[c].astype(float))
            out["_" + c] = np.convolve(np.pad(whole, 12, mode="edge"), weights / weights.sum(), mode="valid")
        return pd.DataFrame(out).assign(**{c: pdf[c].iat[0] for c in by})[[*by, "_slice", *["_" + c for c in RGB]]]

    medians = materialize(middle.join(enough, [*by, "_slice"]).groupBy(*by).applyInPandas(along, shape), "thin-medians")  # 96 rows per group
    both = splats.join(thin, list(by), "left").withColumn("_slice", F.when(F.col("_low").isNotNull(), at)).join(medians, [*by, "_slice"], "left")
    near = {c: F.least(F.greatest(F.round(F.col("_" + c) + (F.col(c) - F.col("_" + c)) * 0.3), F.lit(0.0)), F.lit(255.0)).cast(types[c]) for c in RGB}
    return both.withColumns({c: F.when(F.col(c).isNotNull() & F.col("_" + c).isNotNull(), near[c]).otherwise(F.col(c)) for c in RGB}).drop("_low", "_slice", *["_" + c for c in RGB])


def splats_of(points: DataFrame, by: Sequence[str], radius: float = 0.02, opacity: float = 3.0) -> DataFrame:
    """Splats of close-ups: by, pos, x, y, z, scale, weight, r, g, b and the normal as colour nr, ng, nb.

    pos numbers each group's splats by falling weight (opacity times volume), then seq; normals look away from the middle.
    points: seq, dataset, x, y, z, r, g, b. A splat is the larger the farther its pack's colour lies from black, so that the
    order says something; all are equally opaque. Every point is a splat: one without a colour is as large as a black one,
    one with an infinite coordinate has neither place nor normal. Colours of thin packs are smoothed.
    """
    finite = F.greatest(*[F.abs(F.col(a)) for a in XYZ]) < float("inf")
    c = materialize(close_up(points.select("seq", *by, *[F.when(finite, F.col(a)).alias(a) for a in XYZ], *RGB), by), "splats-frame")
    n = surface_normals(c.select("seq", *by, *XYZ), None, 32)
    byte = lambda v: F.when(v.isNotNull(), F.floor(F.least(F.greatest((v * 0.5 + 0.5) * 255, F.lit(0.0)), F.lit(255.0)) + 0.5)).cast("int")
    bright = sum((F.coalesce(F.col(k), F.lit(0)) for k in RGB), F.lit(0)) / 765.0
    sized = c.withColumn("weight", F.round((radius * (1 + bright)) ** 3 / (1 + math.exp(-opacity)), 12))
    each = thin_colours(sized, by).join(n, "seq", "left")
    each = each.select(*by, "seq", *XYZ, "scale", "weight", *RGB, *[byte(F.col("n" + a)).alias("n" + k) for a, k in zip(XYZ, RGB)])
    each = each.withColumn("_less", -F.col("weight")).withColumn("_bucket", F.floor(F.col("_less") * 1e7))
    return numbered(each, list(by), "_bucket", ["_less", "seq"]).drop("_less", "_bucket")


def splat_faults(splats: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, n, out_of_order, pale: splats that do not follow the one before, from 0 on, and placed ones whose normal's colour
    is none or not of length 1. Blocks of places are looked at one by one, then each block's first with the last before it."""
    home = F.floor(F.col("pos") / BLOCK)
    key = F.struct("pos", (-F.col("weight")).alias("less"), "seq")
    after = lambda a, b: F.coalesce((a["pos"] + 1 == b["pos"]) & (F.struct(a["less"], a["seq"]) < F.struct(b["less"], b["seq"])), F.lit(False))
    length = F.sqrt(sum(((F.col("n" + c) / 127.5 - 1) ** 2 for c in RGB), F.lit(0.0)))
    pale = F.col("x").isNotNull() & F.coalesce(F.abs(length - 1) > 0.02, F.lit(True))
    keyed = splats.select(*by, home.alias("block"), key.alias("key"), pale.alias("pale"))
    before = F.lag("key").over(W.partitionBy(*by, "block").orderBy("key.pos"))
    seen = keyed.withColumn("before", before).withColumn("worse", F.col("before").isNotNull() & ~after(F.col("before"), F.col("key")))
    ends = [F.min("key").alias("first"), F.max("key").alias("last")]
    blocks = seen.groupBy(*by, "block").agg(F.count("*").alias("n"), F.count_if("worse").alias("worse"), F.count_if("pale").alias("pale"), *ends)
    edge = blocks.withColumn("before", F.lag("last").over(W.partitionBy(*by).orderBy("block")))  # a row per block
    start = F.when(F.col("before").isNull(), F.col("first")["pos"] == 0).otherwise(after(F.col("before"), F.col("first")))
    return edge.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("worse") + F.count_if(~start)).alias("out_of_order"), F.sum("pale").alias("pale"))
