"""Greedy choices among few candidates, where each choice changes what the others are worth; one group per task."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators import neighbours

#: Views, at least, that are judged together.
BATCH = 100_000


def _schema(df: DataFrame, by: Sequence[str], key: str, more: str) -> str:
    types = dict(df.dtypes)
    return ", ".join([*(f"`{c}` {types[c]}" for c in by), f"`{key}` {types[key]}", more])


def turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Absolute difference of angles in radians, 0..pi, for every a against every b."""
    return np.abs((a[:, None] - b[None, :] + np.pi) % (2 * np.pi) - np.pi)


def auto_views(candidates: DataFrame, by: Sequence[str], k: int = 8, near: int = 3, least_span: float = 36.0) -> DataFrame:
    """by, name, rank, worth: up to k views of an object from different sides, large and unhidden ones first.

    candidates: by, name, cam, i, bearing (radians), span (pixels), vis (0..1). Worth: new side (degrees to the nearest
    chosen bearing / 40, at most 1.5) + log2(span / least_span) / 4 + vis / 2. After each choice frames of its camera
    within `near` places leave. Ties: smaller name. Null bearings count as straight ahead.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("name").reset_index(drop=True)
        bearing = pdf["bearing"].fillna(0.0).to_numpy(float)
        base = 0.25 * np.log2(np.maximum(pdf["span"].fillna(0).to_numpy(float) / least_span, 1.0)) + 0.5 * pdf["vis"].fillna(0).to_numpy(float)
        open_, i, cam = np.ones(len(pdf), bool), pdf["i"].to_numpy(), pdf["cam"].to_numpy(object)
        chosen: list[int] = []
        worths = []
        while len(chosen) < k and open_.any():
            side = turn(bearing, bearing[chosen]).min(axis=1) if chosen else np.full(len(pdf), np.pi)
            worth = np.where(open_, np.minimum(np.degrees(side) / 40.0, 1.5) + base, -np.inf)
            best = int(np.argmax(worth))
            chosen.append(best)
            worths.append(worth[best])
            open_ &= ~((cam == cam[best]) & (np.abs(i - i[best]) <= near))
        return pdf.loc[chosen, [*by, "name"]].astype(object).assign(rank=np.arange(1, len(chosen) + 1), worth=worths)

    return candidates.groupBy(*by).applyInPandas(run, _schema(candidates, by, "name", "rank long, worth double"))


def view_quality(views: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds rel_sol, rel_sharp, shape_ok, ok and score: how each view agrees with the medians of its set.

    views: by, solidity, sharp, ncc (pieces), aspect, fill, orig_px, manual. A view agrees if it is at least 0.75 as solid
    and 0.35 as sharp as the median, has at most three pieces, and aspect and fill within a factor of 1.8. Medians are of
    a set of views of one object, which is small; a median of 0 counts as 1, that of solidity as almost 0.
    """
    whole = views.filter(" and ".join(f"`{c}` is not null" for c in by))
    med = whole.withColumns({"_" + c: F.median(c).over(W.partitionBy(*by)) for c in ("solidity", "sharp", "aspect", "fill")})
    rel = lambda c: F.col(c) / F.greatest(F.when(F.col("_" + c) == 0, 1.0).otherwise(F.col("_" + c)), F.lit(1e-6))
    both = med.withColumn("rel_sol", F.col("solidity") / F.greatest("_solidity", F.lit(1e-6))).withColumn("rel_sharp", rel("sharp"))
    shape = rel("aspect").between(1 / 1.8, 1.8) & rel("fill").between(1 / 1.8, 1.8)
    ok = (F.col("rel_sol") >= 0.75) & (F.col("rel_sharp") >= 0.35) & (F.col("ncc") <= 3) & F.col("shape_ok")
    score = F.least("rel_sol", F.lit(1.2)) * F.sqrt(F.least("rel_sharp", F.lit(1.5))) * F.sqrt("orig_px") * F.when(F.col("manual"), 1.15).otherwise(1.0)
    return both.withColumn("shape_ok", shape).withColumn("ok", ok).withColumn("score", score).drop("_solidity", "_sharp", "_aspect", "_fill")


def best_views(start: np.ndarray, score: np.ndarray, ok: np.ndarray, bearing: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and ranks of the views that `quality_views` keeps, of many sets at once: set i begins at start[i], is not
    empty and in order of name. bearing in degrees.

    All sets choose their next view together; those that have no view left drop out.
    """
    score, bearing = np.where(np.isnan(score), 0.0, score), np.radians(bearing)
    bearing = np.where(np.isfinite(bearing), bearing, np.nan)
    of = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(score)]))
    places, ranks = [], []
    left = np.flatnonzero(ok)
    side = np.full(len(left), np.inf)
    for rank in range(1, k + 1):
        if not len(left):
            break
        group = of[left]
        new = np.r_[True, group[1:] != group[:-1]]
        dense = np.cumsum(new) - 1
        # no view is chosen yet on any side, or that of the view is not known: the factor is 1
        gain = score[left] * (0.4 + 0.6 * np.minimum(side / 35.0, 1.0))
        top = np.flatnonzero(gain == np.maximum.reduceat(gain, np.flatnonzero(new))[dense])
        top = top[np.r_[True, dense[top][1:] != dense[top][:-1]]]
        places.append(left[top])
        ranks.append(np.full(len(top), rank))
        off = np.abs((bearing[left] - bearing[left[top]][dense] + np.pi) % (2 * np.pi) - np.pi)
        stay = np.ones(len(left), bool)
        stay[top] = False
        left, side = left[stay], np.fmin(side, np.degrees(off))[stay]
    rest = np.flatnonzero((~np.logical_or.reduceat(ok, start))[of]) if len(start) else of
    rest = rest[np.lexsort((-score[rest], of[rest]))]
    nth = np.arange(len(rest)) - np.searchsorted(of[rest], of[rest])
    places.append(rest[nth < 2])
    ranks.append(nth[nth < 2] + 1)
    return np.concatenate(places), np.concatenate(ranks)


def quality_views(candidates: DataFrame, by: Sequence[str], k: int = 8) -> DataFrame:
    """by, name, rank: up to k good views, the best first, each weighed down where its side is covered already.

    candidates: by, name, score, ok, bearing (degrees, may be null). Gain: score (0.4 + 0.6 min(degrees to the nearest
    chosen / 35, 1)). Without any ok candidate the two best by score are taken. Ties: smaller name.
    """

    def run(batches):
        kept: list[pa.RecordBatch] = []  # of the last set, which may go on in the next batch
        enough = BATCH
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                kept.append(batch)
                if sum(len(b) for b in kept) < enough:
                    continue
            if not kept:
                continue
            t = pa.Table.from_batches(kept).combine_chunks()
            start = np.flatnonzero(t["_at"].to_numpy() == 1)
            end = len(t) if batch is None else int(start[-1])
            kept, enough = t.slice(end).to_batches(), max(BATCH, 2 * (len(t) - end))
            if end == 0:
                continue
            t, start = t.slice(0, end), start[start < end]
            number = lambda c: pc.fill_null(t[c].cast(pa.float64()), np.nan).to_numpy()
            at, rank = best_views(start, number("score"), pc.fill_null(t["ok"], False).to_numpy(), number("bearing"), k)
            out = t.select([*by, "name"]).take(pa.array(at)).append_column("rank", pa.array(rank, pa.int64()))
            yield from out.combine_chunks().to_batches()

    # each set is whole and in order within a partition, whose sets are then judged many at a time
    at = F.row_number().over(W.partitionBy(*by).orderBy(F.asc_nulls_last("name")))
    sets = candidates.select(*by, "name", "score", "ok", "bearing", at.alias("_at"))
    return sets.mapInArrow(run, _schema(candidates, by, "name", "rank long"))


def near_quality_views(objects: DataFrame, frames: DataFrame, k: int = 8, focal: float = 1183.5, least_span: float = 10.0) -> DataFrame:
    """id, name, rank: `quality_views` of all frames of an object's recording that are more than 1 away on the ground.

    objects: id, dataset, cx, cz, sx (size); frames: dataset, name, px, pz. Score: the object's size in pixels; ok: above
    least_span. A gain is at least 0.4 of its score, and the score falls as the distance grows. So a frame more than 2.5
    times as far as the k-th nearest is never chosen, and is not looked at. Sizes that are not above 0 and values that are
    not finite have no such order; their objects meet all frames.
    """
    finite = lambda c: F.abs(c) < float("inf")
    odd = ~((F.col("sx") > 0) & finite("sx") & finite("cx") & finite("cz"))
    place = [F.when(finite(c), F.col(c)).otherwise(0.0).alias(a) for c, a in (("cx", "x"), ("cz", "z"))]
    o = objects.select(F.col("id").alias("seq"), "dataset", *place, F.lit(0.0).alias("y"), "cx", "cz", "sx")
    f = frames.select(F.col("name").alias("seq"), "dataset", F.col("px").alias("x"), F.lit(0.0).alias("y"), F.col("pz").alias("z"))

    def see(a: dict, b: dict, row: np.ndarray, col: np.ndarray) -> pd.DataFrame:
        dx, dz = b["x"][col] - a["cx"][row], b["z"][col] - a["cz"][row]
        dist = np.hypot(dx, dz)
        at = np.flatnonzero(dist > 1)
        row, col, bearing = row[at], col[at], np.degrees(np.arctan2(dx[at], dz[at]))
        with np.errstate(invalid="ignore"):
            span = focal * a["sx"][row] / dist[at]
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
        best, rank = best_views(start, span, (span > least_span) | np.isnan(span), bearing, k)
        return pd.DataFrame({"id": a["seq"][row[best]], "name": b["seq"][col[best]], "rank": rank})

    types = dict(objects.dtypes)["id"], dict(frames.dtypes)["name"]
    schema = "id {}, name {}, rank long".format(*types)
    return neighbours.within_ratio(o, f, k, 2.5, 1.0, ["dataset"], see, schema, ["cx", "cz", "sx"], odd).drop("dataset")


def chain_scales(seams: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, chunk, log_scale: log scales chained from the first chunk over the ratios of its seams, in order.

    seams: by, chunk, log_ratio (of the seam to the chunk before). A null ratio, or a missing chunk, starts again at 0.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk").drop_duplicates("chunk")
        chunk, ratio = pdf["chunk"].to_numpy(), pdf["log_ratio"].to_numpy(float)
        new = np.r_[True, np.diff(chunk) != 1] | ~np.isfinite(ratio)
        total = np.cumsum(np.where(new, 0.0, np.nan_to_num(ratio)))
        base = total[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        return pdf[[*by, "chunk"]].astype(object).assign(log_scale=total - base)

    return seams.groupBy(*by).applyInPandas(run, _schema(seams, by, "chunk", "log_scale double"))
