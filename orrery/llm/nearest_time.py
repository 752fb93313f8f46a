"""Pairs each record with the record of another table that is nearest in time, within a tolerance."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_positions(times: np.ndarray, wanted: np.ndarray, tolerance: int) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted time the position of the nearest of the sorted times, and whether it is within tolerance.

    Of two equally near times the earlier wins; of equal times the first.
    """
    if not len(times):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    right = np.searchsorted(times, wanted, side="left")
    after = np.minimum(right, len(times) - 1)
    before = np.searchsorted(times, times[np.maximum(right - 1, 0)], side="left")
    pick = np.where(np.abs(wanted - times[before]) <= np.abs(times[after] - wanted), before, after)
    return pick, np.abs(times[pick] - wanted) <= tolerance


def match_nearest(left: DataFrame, right: DataFrame, entity: list[str], tolerance_us: int, bin_us: int = 300_000_000, carry: list[str] | None = None) -> DataFrame:
    """The rows (entity, key, ts) of left, each with the nearest row of right of the same entity.

    Result: entity, key_left, key_right, gap_us (right minus left) and the columns `carry` of right. Both tables are
    co-grouped by entity and time bin; right rows go to all bins within the tolerance, so a task
    holds one bin of one entity, however many rows an entity has. Rows with a null ts, key or entity take no part; a
    key counts once; left rows without a partner do not come out. Ties: the earlier, then the smaller key.
    Of right rows with one key the one with the smallest carried values counts (null before NaN after numbers).
    """
    carry = carry or []
    whole = lambda df, cols: df.select(*entity, "key", F.unix_micros("ts").alias("t"), *cols).dropna(subset=[*entity, "key", "t"])
    bin_of = lambda c: F.floor(c / bin_us)
    a = whole(left, []).withColumn("bin", bin_of(F.col("t")))
    reach = F.sequence(bin_of(F.col("t") - tolerance_us), bin_of(F.col("t") + tolerance_us))
    b = whole(right, carry).withColumn("bin", F.explode(reach))

    def rank(v):
        if isinstance(v, (list, tuple, np.ndarray)):
            return (1, tuple(rank(x) for x in v))
        return (0, 0) if v is None else (2, 0) if isinstance(v, float) and np.isnan(v) else (1, v)

    def pair(l: pa.Table, r: pa.Table) -> pa.Table:
        """Only times and keys leave Arrow; what is carried is taken as it is."""
        lt, rt = l.column("t").to_numpy(), r.column("t").to_numpy()
        ours = np.flatnonzero(~l.column("key").to_pandas().duplicated().to_numpy())
        keys = r.column("key").to_pandas()
        order = np.arange(len(rt))
        twice = keys.duplicated(keep=False).to_numpy()
        if carry and twice.any():
            at = np.flatnonzero(twice)
            values = list(zip(*[r.column(c).take(at).to_pylist() for c in carry]))
            order = np.r_[at[sorted(range(len(at)), key=lambda i: rank(values[i]))], np.flatnonzero(~twice)]
        order = order[~keys.iloc[order].duplicated().to_numpy()]
        order = order[pd.DataFrame({"t": rt[order], "key": keys.to_numpy(object)[order]}).sort_values(["t", "key"], kind="stable").index.to_numpy()]
        at, near = nearest_positions(rt[order], lt[ours], tolerance_us)
        li = ours[near]
        ri = order[at[near]] if len(order) else np.zeros(0, np.int64)
        cols = {c: l.column(c).take(li) for c in entity}
        cols |= {"key_left": l.column("key").take(li), "key_right": r.column("key").take(ri), "gap_us": pa.array(rt[ri] - lt[li])}
        return pa.table(cols | {c: r.column(c).take(ri) for c in carry})

    lt, rt = dict(left.dtypes), dict(right.dtypes)
    schema = ", ".join([*(f"`{c}` {lt[c]}" for c in entity), f"key_left {lt['key']}, key_right {rt['key']}, gap_us long", *(f"`{c}` {rt[c]}" for c in carry)])
    return a.groupBy(*entity, "bin").cogroup(b.groupBy(*entity, "bin")).applyInArrow(pair, schema)
