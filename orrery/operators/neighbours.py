"""Exact nearest neighbours without a radius: blocks along a space-filling curve, chosen by their boxes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.spikes import numbered
from orrery.session import materialize

XYZ = ("x", "y", "z")
BLOCK, CHUNK = 128, 128  # points of a block, blocks of a chunk (the work of one call)
LEAF = 16  # points that look for neighbours together
PAIRS = 500_000  # pairs that are looked at together
BOX = [f"{n}{a}" for n in ("lo", "hi") for a in XYZ]
_SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def _spread(v: Column) -> Column:
    for shift, mask in _SPREAD:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def blocks(points: DataFrame, by: Sequence[str], carry: Sequence[str] = (), chunk: int = CHUNK) -> DataFrame:
    """by, chunk, block, box, ids and arrays of the coordinates and of `carry`: points in Morton order, BLOCK at a time.

    Points whose coordinates are not all finite are left out.
    """
    ok = points.filter(" and ".join(f"abs({a}) < double('infinity')" for a in XYZ))
    span = ok.groupBy(*by).agg(*[F.min(a).alias("o" + a) for a in XYZ], F.greatest(*[F.max(a) - F.min(a) for a in XYZ]).alias("_w"))
    grid = [_spread(F.when(F.col("_w") > 0, F.floor((F.col(a) - F.col("o" + a)) / F.col("_w") * 1048575)).otherwise(0).cast("long")) for a in XYZ]
    code = grid[0].bitwiseOR(F.shiftleft(grid[1], 1)).bitwiseOR(F.shiftleft(grid[2], 2))
    keyed = ok.join(span, list(by)).select(*by, "seq", *XYZ, *carry, code.alias("code")).withColumn("bucket", F.shiftright("code", 36))
    placed = numbered(keyed, list(by), "bucket", ["code", "seq"]).withColumn("block", F.floor(F.col("pos") / BLOCK))
    box = [f(a).alias(n + a) for n, f in (("lo", F.min), ("hi", F.max)) for a in XYZ]
    lists = [F.collect_list(c).alias(c) for c in ("seq", *XYZ, *carry)]
    return placed.groupBy(*by, "block").agg(*box, F.count("*").alias("n"), *lists).withColumn("chunk", F.floor(F.col("block") / chunk))


def _gap2(lo: np.ndarray, hi: np.ndarray, los: np.ndarray, his: np.ndarray) -> np.ndarray:
    """Least squared distance of a box to boxes."""
    return (np.maximum(np.maximum(los - hi, lo - his), 0.0) ** 2).sum(axis=1)


def _needed(k: int, by: Sequence[str], schema: str) -> Callable:
    """Which right blocks the points of each chunk may have neighbours in; sees only the boxes of a group."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=[c.split()[0].strip("`") for c in schema.split(", ")], dtype=object)
        los, his, n = b[BOX[:3]].to_numpy(), b[BOX[3:]].to_numpy(), b["n"].to_numpy()
        want: dict[int, set] = {}
        for chunk, box in zip(a["chunk"], a[BOX].to_numpy()):
            far = (np.maximum(his - box[:3], box[3:] - los) ** 2).sum(axis=1)
            order = np.argsort(far)
            at = min(int(np.searchsorted(np.cumsum(n[order]), k)), len(order) - 1)
            # a little more than the bound, so that rounding loses no block
            want.setdefault(chunk, set()).update(np.flatnonzero(_gap2(box[:3], box[3:], los, his) <= far[order[at]] * (1 + 1e-9)))
        rows = [(c, b["block"].iat[i]) for c, s in want.items() for i in s]
        out = pd.DataFrame(rows, columns=["chunk", "need"])
        for c in by:
            out[c] = a[c].iat[0]
        return out

    return run


def _fetched(la: DataFrame, boxes: DataFrame, rb: DataFrame, by: Sequence[str], needed: Callable, shape: str) -> DataFrame:
    """The right blocks that each chunk of la needs."""
    pairs = boxes.groupBy(*by).cogroup(rb.select(*by, "block", "n", *BOX).groupBy(*by)).applyInPandas(needed, shape)
    return pairs.join(rb.withColumnRenamed("block", "need").drop("chunk"), [*by, "need"])


def _leaves(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of x in leaves of up to `size` that lie close together (len(x) where a leaf has fewer), and the leaves' boxes:
    halved at the median of the longest side, again and again."""
    levels = max(0, int(np.ceil(np.log2(max(len(x), 1) / size))))
    at = np.full(-(-len(x) // 2**levels) * 2**levels, len(x))
    at[: len(x)] = np.arange(len(x))
    at, lows, highs = at[None], np.vstack([x, np.full((1, 3), np.inf)]), np.vstack([x, np.full((1, 3), -np.inf)])
    for _ in range(levels):
        side = (highs[at].max(axis=1) - lows[at].min(axis=1)).argmax(axis=1)
        half = at.shape[1] // 2
        order = np.argpartition(lows[at, side[:, None]], half, axis=1)
        at = np.take_along_axis(at, order, axis=1).reshape(2 * len(at), half)
    at = at[(at < len(x)).any(axis=1)]
    return at, lows[at].min(axis=1), highs[at].max(axis=1)


def _first(d2: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, places among the nearest, columns and values of the k smallest of each row; ties by rank (of the shape of d2)."""
    inside = d2 < np.inf
    if d2.shape[1] > k:
        inside &= d2 <= np.partition(d2, k - 1, axis=1)[:, k - 1, None]
    row, col = np.nonzero(inside)
    order = np.lexsort((rank[row, col], d2[row, col], row))
    row, col = row[order], col[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    row, nth, col = row[nth < k], nth[nth < k], col[nth < k]
    return row, nth, col, d2[row, col]


def _best(p: np.ndarray, q: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in q (-1 where there are too few) and squared distances of the k nearest of every p; ties by rank.

    Leaves of p meet leaves of q: a few near ones bound the k-th distance, and all within the bound are looked at.
    """
    idx, dist = np.full((len(p), k), -1), np.full((len(p), k), np.inf)
    if not len(p) or not len(q):
        return idx, dist
    mine, plo, phi = _leaves(p, LEAF)
    its, qlo, qhi = _leaves(q, LEAF)
    mine = np.where(mine < len(p), mine, mine[np.arange(len(mine)), (mine < len(p)).argmax(axis=1)][:, None])  # twice, where there are fewer
    q, rank, m = np.vstack([q, np.full((1, 3), np.inf)]), np.append(rank, len(q)), its.shape[1]
    few = min(len(its), -(-k // m) + 1)

    def closest(gap: np.ndarray, n: int) -> np.ndarray:
        return its[np.argpartition(gap, n - 1, axis=1)[:, :n] if n < len(its) else np.broadcast_to(np.arange(n), (len(gap), n))].reshape(len(gap), -1)

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return sum((p[a, i][:, :, None] - q[b, i][:, None, :]) ** 2 for i in range(3))

    step = max(1, PAIRS // max(len(its), mine.shape[1] * few * m))
    for j in range(0, len(mine), step):
        part = mine[j : j + step]
        gap = sum(np.maximum(np.maximum(qlo[None, :, i] - phi[j : j + step, i, None], plo[j : j + step, i, None] - qhi[None, :, i]), 0.0) ** 2 for i in range(3))
        d2 = apart(part, closest(gap, few))
        limit = np.partition(d2, k - 1, axis=2)[:, :, k - 1].max(axis=1) if d2.shape[2] >= k else np.full(len(part), np.inf)
        count = (gap <= limit[:, None] * (1 + 1e-9)).sum(axis=1)
        order = np.argsort(count, kind="stable")
        i = 0
        while i < len(order):
            upto = int(np.searchsorted(count[order], 1.25 * count[order[i]] + 1, "right"))
            upto = min(upto, i + max(1, int(PAIRS // (1.25 * count[order[i]] * mine.shape[1] * m + 1))))
            these = order[i:upto]
            near = closest(gap[these], int(count[order[upto - 1]]))
            rows = part[these].ravel()
            every = np.repeat(near, part.shape[1], axis=0)
            row, nth, col, value = _first(apart(part[these], near).reshape(len(rows), -1), rank[every], k)
            idx[rows[row], nth], dist[rows[row], nth] = every[row, col], value
            i = upto
    return idx, dist


def around(left: DataFrame, right: DataFrame | None, k: int, by: Sequence[str], see: Callable, schema: str, carry: Sequence[str] = ()) -> DataFrame:
    """What `see` makes of the k nearest right points of left points, a chunk at a time; every left point whose group has
    right points is seen. Exact: a block is left out only where its box is beyond the k-th distance.

    left, right: seq, x, y, z and `by`, left `carry` too. see(a, b, idx, d2): a, b are dicts of arrays of left and right points,
    idx (len(a), k) places in b, -1 where the group has fewer. Without right the points are looked for among themselves.
    """
    la = materialize(blocks(left, by, carry), "blocks")
    rb = la.toDF(*la.columns) if right is None else materialize(blocks(right, by), "blocks")
    types = dict(la.dtypes)
    keys = ", ".join(f"`{c}` {types[c]}" for c in by)
    shape = f"chunk long, need long, {keys}"
    fetched = _fetched(la, la.select(*by, "chunk", *BOX), rb, by, _needed(k, by, shape), shape)
    mine_of, every_of = [["seq", *XYZ, *carry], ["seq", *XYZ, *(carry if right is None else ())]]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            every, mine = ({c: np.concatenate(t[c].to_numpy()) for c in of} for t, of in ((b, every_of), (a, mine_of)))
            rank = np.argsort(np.argsort(every["seq"], kind="stable"), kind="stable")
            p, q = (np.stack([t[c] for c in XYZ], axis=1) for t in (mine, every))
            out.append(see(mine, every, *_best(p, q, rank, k)).assign(**{c: a[c].iat[0] for c in by}))
        names = [c.split()[0].strip("`") for c in f"{schema}, {keys}".split(", ")]
        return pd.concat(out)[names] if out else pd.DataFrame(columns=names, dtype=object)

    grouped = la.groupBy(*by, "chunk").cogroup(fetched.groupBy(*by, "chunk"))
    return grouped.applyInPandas(run, f"{schema}, {keys}")


def nearest(left: DataFrame, right: DataFrame | None, k: int, by: Sequence[str]) -> DataFrame:
    """by, id_a, id_b, dist, rank: the k nearest right points of each left point, however far; ties by id_b.

    Without right the points are looked for among themselves, and none pairs with itself.
    """
    own = right is None
    ta, tb = dict(left.dtypes)["seq"], dict((left if own else right).dtypes)["seq"]

    def see(a: dict, b: dict, idx: np.ndarray, d2: np.ndarray) -> pd.DataFrame:
        row, col = np.nonzero(idx >= 0)
        out = pd.DataFrame({"id_a": a["seq"][row], "id_b": b["seq"][idx[row, col]], "dist": np.sqrt(d2[row, col])})
        if own:
            out = out[out["id_a"] != out["id_b"]]
        out["rank"] = out.groupby("id_a", sort=False).cumcount() + 1
        return out[out["rank"] <= k]

    return around(left, right, k + 1 if own else k, by, see, f"id_a {ta}, id_b {tb}, dist double, rank long")


def _reach(k: int, ratio: float, beyond: float, by: Sequence[str], schema: str) -> Callable:
    """As `_needed`, but for points up to `ratio` times as far as the k-th that is farther than `beyond`; odd blocks need all."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=[c.split()[0].strip("`") for c in schema.split(", ")], dtype=object)
        los, his, n = b[BOX[:3]].to_numpy(), b[BOX[3:]].to_numpy(), b["n"].to_numpy()
        want: dict[int, np.ndarray] = {}
        for chunk, odd, box in zip(a["chunk"], a["odd"], a[BOX].to_numpy()):
            mine = want.setdefault(chunk, np.zeros(len(b), bool))
            mine |= odd or _gap2(box[:3], box[3:], los, his) <= _limit2(box, los, his, n, k, ratio, beyond)
        rows = [(c, b["block"].iat[i]) for c, s in want.items() for i in np.flatnonzero(s)]
        out = pd.DataFrame(rows, columns=["chunk", "need"])
        for c in by:
            out[c] = a[c].iat[0]
        return out

    return run


def _limit2(box: np.ndarray, los: np.ndarray, his: np.ndarray, n: np.ndarray, k: int, ratio: float, beyond: float) -> float:
    """Square of `ratio` times a bound, for all points of a box, of the distance of the k-th that is farther than `beyond`."""
    sure = _gap2(box[:3], box[3:], los, his) > beyond**2 * (1 + 1e-9)
    far, n = (np.maximum(his[sure] - box[:3], box[3:] - los[sure]) ** 2).sum(axis=1), n[sure]
    order = np.argsort(far)
    at = int(np.searchsorted(np.cumsum(n[order]), k))
    return far[order[at]] * ratio**2 * (1 + 1e-9) if at < len(order) else np.inf


def within_ratio(left: DataFrame, right: DataFrame, k: int, ratio: float, beyond: float, by: Sequence[str], see: Callable, schema: str, carry: Sequence[str], odd: Column) -> DataFrame:
    """What `see` makes of left points and the right points that are at most `ratio` times as far as the k-th of those farther
    than `beyond` (all, if there are fewer). Pairs are made some at a time, and never leave their task.

    left, right: as for `around`; odd: of left rows, true where every right point counts. see(a, b, row, col): row and col are
    places in a and b of the pairs, by row, then by seq of b; pairs that are not farther than `beyond` may be among them.
    """
    la = materialize(blocks(left.withColumn("odd", odd), by, [*carry, "odd"], 32), "blocks")
    rb = materialize(blocks(right, by), "blocks")
    types = dict(la.dtypes)
    keys = ", ".join(f"`{c}` {types[c]}" for c in by)
    shape = f"chunk long, need long, {keys}"
    names = [c.split()[0].strip("`") for c in f"{schema}, {keys}".split(", ")]
    boxes = la.select(*by, "chunk", F.exists("odd", lambda o: o).alias("odd"), *BOX)
    fetched = _fetched(la, boxes, rb, by, _reach(k, ratio, beyond, by, shape), shape)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            los, his, n = b[BOX[:3]].to_numpy(), b[BOX[3:]].to_numpy(), b["n"].to_numpy()
            every = {c: np.concatenate(b[c].to_numpy()) for c in ("seq", *XYZ)}
            order = np.argsort(every["seq"], kind="stable")
            every, home = {c: v[order] for c, v in every.items()}, np.repeat(np.arange(len(b)), n)[order]
            q = np.stack([every[c] for c in XYZ], axis=1)
            for i in range(len(a)):
                mine = {c: np.asarray(a[c].iat[i]) for c in ("seq", *XYZ, *carry)}
                p, whole = np.stack([mine[c] for c in XYZ], axis=1), np.asarray(a["odd"].iat[i], bool)
                box = a[BOX].iloc[i].to_numpy(float)
                near = np.flatnonzero((_gap2(box[:3], box[3:], los, his) <= _limit2(box, los, his, n, k, ratio, beyond))[home])
                for which, at in ((np.flatnonzero(~whole), near), (np.flatnonzero(whole), np.arange(len(q)))):
                    step = max(1, PAIRS // max(len(at), 1))
                    for rows in (which[j : j + step] for j in range(0, len(which), step)):
                        inside = np.ones((len(rows), len(at)), bool)
                        if at is near and len(at) > k:
                            d2 = sum((p[rows, c, None] - q[None, at, c]) ** 2 for c in range(3))
                            kth = np.partition(np.where(d2 > beyond**2 * (1 + 1e-9), d2, np.inf), k - 1, axis=1)[:, k - 1, None]
                            inside = d2 <= kth * ratio**2 * (1 + 1e-9)
                        row, col = np.nonzero(inside)
                        if len(row):
                            out.append(see(mine, every, rows[row], at[col]).assign(**{c: a[c].iat[i] for c in by}))
        return pd.concat(out)[names] if out else pd.DataFrame(columns=names, dtype=object)

    return la.groupBy(*by, "chunk").cogroup(fetched.groupBy(*by, "chunk")).applyInPandas(run, f"{schema}, {keys}")
