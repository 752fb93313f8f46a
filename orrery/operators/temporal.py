"""Operators along time: brackets with interpolation, gap sessions, chunk windows, finite differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators.spatial import quantiles
from orrery.operators.spikes import numbered, with_margins
from orrery.session import materialize


def bracket_join(left: DataFrame, right: DataFrame, by: Sequence[str], values: Sequence[str], max_gap_us: int, bin_us: int = 600_000_000) -> DataFrame:
    """Each left row (by, key, t) with the right rows (by, t, values) before and after it: before.t < t <= after.t.

    Result: by, key, t, prev_t, next_t and prev_/next_ of each value; only where both exist and lie no farther apart
    than max_gap_us. Bins of time keep the windows bounded; right rows near a border go to both bins.
    """
    lo, hi = (lambda c: F.floor((c - max_gap_us) / bin_us)), (lambda c: F.floor((c + max_gap_us) / bin_us))
    a = left.select(*by, "key", "t", F.floor(F.col("t") / bin_us).alias("bin"), F.lit(1).alias("is_left"))
    b = right.select(*by, "t", *values, F.explode(F.sequence(lo(F.col("t")), hi(F.col("t")))).alias("bin"), F.lit(0).alias("is_left"))
    both = a.unionByName(b, allowMissingColumns=True)
    row = F.struct("t", *values)
    ref = F.when(F.col("is_left") == 0, row)
    # at equal times the left row stands first: its time is not before itself
    w = W.partitionBy(*by, "bin").orderBy(F.col("t"), F.col("is_left").desc())
    before = F.last(ref, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.first(ref, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    hit = both.withColumn("_p", before).withColumn("_n", after).filter("is_left = 1")
    out = hit.filter(F.col("_p").isNotNull() & F.col("_n").isNotNull() & (F.col("_n.t") - F.col("_p.t") <= max_gap_us))
    cols = [F.col(f"{s}.{v}").alias(f"{n}_{v}") for s, n in (("_p", "prev"), ("_n", "next")) for v in ("t", *values)]
    return out.select(*by, "key", "t", *cols)


def lerp(a: Column, b: Column, share: Column) -> Column:
    return a + (b - a) * share


def placed(rows: DataFrame, by: Sequence[str], t: str, order: Sequence[str]) -> DataFrame:
    """Adds pos, the place of a row in its group by order, which begins with the time t (microseconds or a timestamp).

    Places come from counts per hour, which bound what a task sees by what a camera takes in an hour.
    """
    micros = F.unix_micros(t) if dict(rows.dtypes)[t].startswith("timestamp") else F.col(t)
    return numbered(rows.withColumn("_hour", F.floor(micros / 3_600_000_000)), list(by), "_hour", list(order)).drop("_hour")


def in_blocks(rows: DataFrame, margin: int, block: int = 4096) -> DataFrame:
    """Placed rows in blocks of consecutive ones, each with `margin` rows of its neighbours; own marks a block's own rows."""
    return with_margins(rows, block, margin)


def beside(rows: DataFrame, by: Sequence[str], t: str, order: Sequence[str], columns: dict[str, tuple[str, int]]) -> DataFrame:
    """Adds columns (name: column, offset) of rows before (negative) and after each row of its group; null beyond the ends."""
    reach = max(abs(o) for _, o in columns.values())
    b = in_blocks(placed(rows, by, t, order), reach)
    w = W.partitionBy(*by, "block").orderBy("pos")
    near = b.select("*", *[F.lead(c, o).over(w).alias(n) if o > 0 else F.lag(c, -o).over(w).alias(n) for n, (c, o) in columns.items()])
    return near.filter("own").drop("block", "own")


def gap_sessions(rows: DataFrame, by: Sequence[str], t: str, least_us: int, factor: float, order: Sequence[str] = ()) -> DataFrame:
    """Adds session, counted from 0 per group: a new one where the gap exceeds max(least, factor x median gap)."""
    gaps = beside(rows, by, t, [t, *order], {"_before": (t, -1)}).withColumn("_gap", F.col(t) - F.col("_before")).drop("_before")
    gaps = materialize(gaps.withColumn("_block", F.floor(F.col("pos") / 4096)), "sessions-gaps")
    usual = quantiles(gaps, by, {"_usual": ("_gap", 0.5)})
    cut = (F.col("_gap") > F.greatest(F.lit(float(least_us)), factor * F.col("_usual"))).cast("int")
    marked = gaps.join(usual, list(by), "left").withColumn("_cut", F.coalesce(cut, F.lit(0)))
    blocks = marked.groupBy(*by, "_block").agg(F.sum("_cut").alias("_cuts"))
    earlier = F.coalesce(F.sum("_cuts").over(W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select(*by, "_block", earlier.alias("_start"))
    within = F.sum("_cut").over(W.partitionBy(*by, "_block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    whole = marked.withColumn("_in", within).join(starts, [*by, "_block"])
    return whole.withColumn("session", F.col("_start") + F.col("_in")).drop("_gap", "_usual", "_cut", "_block", "_start", "_in", "pos")


def merge_short(sessions: DataFrame, by: Sequence[str], least: int) -> DataFrame:
    """Sessions merged into the one before wherever either of the two has fewer than `least` rows: session -> merged.

    One row per session goes in. A merged session counts with all its rows, so the merge runs left to right; it is done
    in one pass over the short session list of a group.
    """
    types = dict(sessions.dtypes)

    def run(pdf):
        pdf = pdf.sort_values("session")
        out, size, head = [], 0, None
        for s, n in zip(pdf["session"], pdf["n"]):
            if head is not None and (n < least or size < least):
                size += n
            else:
                head, size = s, n
            out.append(head)
        res = pdf[[*by, "session"]].astype(object)
        res["merged"] = out
        return res

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in by), "session long, merged long"])
    return sessions.groupBy(*by).applyInPandas(run, schema)


def chunk_windows(rows: DataFrame, by: Sequence[str], order: Sequence[str], size: int, overlap: int) -> DataFrame:
    """Adds chunk: overlapping windows of `size` rows, each sharing `overlap` rows with the next; every row in 1..2 chunks.

    Rows after the last full step belong to the last chunk. The order begins with a time.
    """
    step = size - overlap
    rows = materialize(rows, "chunks")
    n = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    put = placed(rows, by, order[0], order).withColumnRenamed("pos", "_i").join(n, list(by))
    last = F.greatest(F.ceil((F.col("_n") - size) / step), F.lit(0))
    lo = F.least(F.greatest(F.ceil((F.col("_i") - size + 1) / step), F.lit(0)), last)
    hi = F.least(F.floor(F.col("_i") / step), last)
    return put.withColumn("chunk", F.explode(F.sequence(lo.cast("int"), hi.cast("int")))).drop("_i", "_n")


def owned(chunked: DataFrame, by: Sequence[str], key: str, order: Sequence[str], overlap: int) -> DataFrame:
    """Of the chunks a row is in the one that owns it: of a shared stretch the first half (rounded up) stays with the
    earlier chunk, the rest goes to the later one."""
    shared = chunked.groupBy(*by, key).agg(F.min("chunk").alias("first"), F.max("chunk").alias("last"), *[F.min(o).alias(o) for o in order if o != key])
    w = W.partitionBy(*by, "first", "last").orderBy(*order)
    nth = F.row_number().over(w)
    n = F.count("*").over(W.partitionBy(*by, "first", "last"))
    pick = F.when((F.col("first") == F.col("last")) | (nth <= F.ceil(n / 2)), F.col("first")).otherwise(F.col("last"))
    return shared.select(*by, key, pick.alias("chunk"))
