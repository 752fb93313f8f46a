"""Implausible readings: impossible values, spikes off the track, stuck values, each judged within its own source.

What is usual for a source comes from quantile sketches (KLL), built per source and hour of its clock in the map
stage, shuffled as sketches, and merged to one per source. Sequences are cut into blocks of consecutive entries with
overlapping margins, so that a source with most of the rows is spread over many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.session import materialize

#: Items a sketch keeps on its lowest level. A source with fewer values gets its exact quantiles.
SKETCH_K = 4096
#: Entries in a block, and entries of its neighbours that each block sees on either side.
BLOCK, MARGIN = 4096, 32
#: Half width of the running median that finds candidates, and the most entries in a row that are off together; more of
#: them agree with each other and are a track of their own.
HALF_WINDOW, MAX_TOGETHER = 5, 10


def hour_sketches(df: DataFrame, source: list[str], hour: Column, value: Column) -> DataFrame:
    """source, hour, n, sketch: how the finite values of a source are distributed in each hour of its clock."""
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return df.groupBy(*source, hour.alias("hour")).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.when(ok, value), F.lit(SKETCH_K)).alias("sketch"))


def source_quantiles(sketches: DataFrame, source: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Merges the sketches of all hours of a source and reads quantiles; null for a source without finite values."""
    merged = sketches.groupBy(*source).agg(F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("_s"))
    read = lambda q: F.when(F.kll_sketch_get_n_double("_s") > 0, F.kll_sketch_get_quantile_double("_s", F.lit(float(q))))
    return merged.select(*source, F.kll_sketch_get_n_double("_s").alias("n_finite"), *[read(q).alias(k) for k, q in quantiles.items()])


def numbered(df: DataFrame, source: list[str], bucket: str, order: list[str]) -> DataFrame:
    """Adds pos, the place of a row within its source, from counts per bucket; no task sees a whole source.

    Buckets must be in the same order as `order` and bounded in size (an hour of one camera, one solver run).
    """
    counts = df.groupBy(*source, bucket).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*source).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*source, bucket, before.alias("_start"))
    at = F.row_number().over(W.partitionBy(*source, bucket).orderBy(*order)) - 1
    return df.withColumn("_at", at).join(starts, [*source, bucket]).withColumn("pos", F.col("_start") + F.col("_at")).drop("_at", "_start")


def with_margins(df: DataFrame, block: int = BLOCK, margin: int = MARGIN) -> DataFrame:
    """Adds block and own: each row once in its block (own) and again in a neighbour whose margin it lies in."""
    home = F.floor(F.col("pos") / block)
    near = F.array_distinct(F.array(home, F.floor((F.col("pos") - margin) / block), F.floor((F.col("pos") + margin) / block)))
    near = F.filter(near, lambda b: b >= 0)
    return df.withColumn("block", F.explode(near)).withColumn("own", F.col("block") == home)


def runs_of_equal(x: np.ndarray, least: int) -> np.ndarray:
    """True where an entry is in a run of at least `least` equal values; NaN equals nothing."""
    n = len(x)
    if n < least:
        return np.zeros(n, bool)
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    lengths = np.diff(np.r_[starts, n])
    return np.repeat(lengths >= least, lengths)


def off_track(t: np.ndarray, p: np.ndarray, usual: float, steps: float) -> np.ndarray:
    """True where an entry lies at least `steps` usual steps off the line from the entry before to the one after it.

    Candidates lie off the running median of their neighbours. The line is drawn between the nearest entries that are
    no candidates; these must agree, that is, lie nearer to each other than the candidate lies to the line. More than
    MAX_TOGETHER candidates in a row are no spike.
    """
    n = len(p)
    if n < 3 or not np.isfinite(usual) or usual <= 0:
        return np.zeros(n, bool)
    h = min(HALF_WINDOW, (n - 1) // 2)
    padded = np.concatenate([p[1 : h + 1][::-1], p, p[-h - 1 : -1][::-1]])
    middle = np.median(np.lib.stride_tricks.sliding_window_view(padded, 2 * h + 1, axis=0), axis=2)
    far = steps * usual
    suspect = np.linalg.norm(p - middle, axis=1) >= far / 2
    out = np.zeros(n, bool)
    calm = np.flatnonzero(~suspect)
    if not len(calm):
        return out
    idx = np.flatnonzero(suspect)
    right = np.searchsorted(calm, idx)
    inside = (right > 0) & (right < len(calm))
    idx, right = idx[inside], right[inside]
    a, b = calm[right - 1], calm[right]
    span = np.maximum(t[b] - t[a], 1e-9)
    share = ((t[idx] - t[a]) / span)[:, None]
    away = np.linalg.norm(p[idx] - (p[a] + share * (p[b] - p[a])), axis=1)
    apart = np.linalg.norm(p[b] - p[a], axis=1)
    out[idx] = (away >= far) & (apart < np.maximum(away, 2 * far)) & (b - a - 1 <= MAX_TOGETHER)
    return out


def flag_track(entries: DataFrame, steps: float = 10.0, bound: float = 3000.0, run: int = 5) -> DataFrame:
    """Flags entries (source, key, ts, p) whose position is implausible for their source.

    entries: recording, cam, name, ts, p (array of 3 doubles). Result: recording, cam, name, reason, one row per
    flagged name, reason a comma-separated list of `impossible` (a component null, not finite or beyond bound),
    `off_track` (at least `steps` usual steps off the track its neighbours agree on) and `stuck` (a component exactly
    equal over `run` entries or more). A null recording or cam counts as ''. Rows without ts or p are left out; of repeated names one counts, the smallest p.
    A source with fewer than three plausible entries has no track. Empty input gives an empty result.
    """
    source = ["recording", "cam"]
    named = [F.coalesce(c, F.lit("")).alias(c) for c in source]
    clean = entries.filter(F.col("ts").isNotNull() & F.col("p").isNotNull()).select(*named, "name", "ts", "p").withColumn("hour", F.date_trunc("hour", "ts"))
    by_time = W.partitionBy(*source, "hour").orderBy("ts", "name", "p")
    seen = F.lag("name").over(by_time)
    distinct = clean.withColumn("_seen", seen).filter(F.col("_seen").isNull() | (F.col("_seen") != F.col("name"))).drop("_seen")
    x, y, z = (F.element_at("p", i) for i in (1, 2, 3))
    by_time = W.partitionBy(*source, "hour").orderBy("ts", "name")
    before = F.lag("p").over(by_time)
    step = F.sqrt(sum(((c - F.element_at(before, i)) ** 2 for i, c in ((1, x), (2, y), (3, z))), F.lit(0.0)))
    plain = F.forall("p", lambda c: c.isNotNull() & (F.abs(c) <= bound)) & F.forall(before, lambda c: c.isNotNull() & (F.abs(c) <= bound))
    stepped = materialize(distinct.withColumn("step", F.when(plain, step)), "spikes-steps")

    usual = source_quantiles(hour_sketches(stepped, source, F.col("hour"), F.col("step")), source, {"usual": 0.5})
    placed = with_margins(numbered(stepped, source, "hour", ["ts", "name"]).join(usual.select(*source, "usual"), source))

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        p = np.array([[np.nan if c is None else c for c in row] if len(row) == 3 else [np.nan] * 3 for row in pdf["p"]], float).reshape(-1, 3)
        t = pdf["ts"].astype("int64").to_numpy() / 1e6
        with np.errstate(invalid="ignore"):
            bad = ~(np.abs(p) <= bound).all(axis=1)
        off = np.zeros(len(p), bool)
        good = np.flatnonzero(~bad)
        u = pdf["usual"].iloc[0]
        off[good] = off_track(t[good], p[good], np.nan if u is None else float(u), steps)
        stuck = np.zeros(len(p), bool)
        for i in range(3):
            stuck |= runs_of_equal(p[:, i], run)
        own = pdf["own"].to_numpy(bool) & (bad | off | stuck)
        why = [",".join(w for w, f in (("impossible", b), ("off_track", o), ("stuck", s)) if f) for b, o, s in zip(bad[own], off[own], stuck[own])]
        return pdf.loc[own, [*source, "name"]].astype(object).assign(reason=np.array(why, object))

    types = dict(entries.dtypes)
    schema = f"recording {types['recording']}, cam {types['cam']}, name {types['name']}, reason string"
    cols = [*source, "name", F.unix_micros("ts").alias("ts"), "p", "usual", "pos", "block", "own"]
    return placed.select(*cols).groupBy(*source, "block").applyInPandas(judge, schema)


def flag_readings(readings: DataFrame, key: str, value: str, order: list[str], factor: float = 5.0, run: int = 5) -> DataFrame:
    """Flags readings (recording, cam, key, ts, value) that are implausible for their source.

    Result: recording, cam, key, value, reason: `impossible` (not finite or negative), `fence` (above factor times the
    median of the source, the fence on a scale that cannot be negative) or `stuck` (run or more equal values one after
    the other by `order`). The columns also carry outer_fence, q3 + 3 (q3 - q1), as a report of how far out it lies.
    A null recording or cam counts as ''. Null values are left out; of repeated keys one counts. A source whose values are all null gives no rows.
    """
    source = ["recording", "cam"]
    v = F.col(value)
    for c in source:
        readings = readings.withColumn(c, F.coalesce(c, F.lit("")))
    clean = readings.filter(v.isNotNull() & F.col(key).isNotNull()).groupBy(*source, key, *order).agg(F.min(v).alias(value), F.min("ts").alias("ts"))
    clean = materialize(clean, "spikes-readings")
    sketches = hour_sketches(clean, source, F.date_trunc("hour", "ts"), F.col(value))
    q = source_quantiles(sketches, source, {"q1": 0.25, "med": 0.5, "q3": 0.75})
    placed = with_margins(numbered(clean, source, order[0], [*order[1:], key]))
    w = W.partitionBy(*source, "block").orderBy("pos")
    changed = (~F.coalesce(F.lag(v).over(w) == v, F.lit(False))).cast("int")
    group = F.sum("_changed").over(w.rowsBetween(W.unboundedPreceding, 0))
    length = F.count("*").over(W.partitionBy(*source, "block", "_group"))
    flagged = placed.withColumn("_changed", changed).withColumn("_group", group).withColumn("_length", length).filter("own").join(q, source)
    infinite = F.isnan(v) | (F.abs(v) == float("inf"))
    reasons = F.concat_ws(
        ",",
        F.when(infinite | (v < 0), "impossible"),
        F.when(~infinite & (v > factor * F.col("med")), "fence"),
        F.when((F.col("_length") >= run) & ~F.isnan(v), "stuck"),
    )
    fence = F.col("q3") + 3 * (F.col("q3") - F.col("q1"))
    return flagged.withColumn("reason", reasons).filter("reason <> ''").select(*source, key, value, "reason", fence.alias("outer_fence"))
