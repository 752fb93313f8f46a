"""The k nearest vectors of every vector, by lists and adaptive dimension scan.

Vectors are rotated by a fixed random rotation and sorted along a space-filling curve, scaled per group by quantile
sketches; consecutive vectors form lists of bounded size, however dense a place is. A list stores its vectors as column
blocks, one block per rotated dimension. A query first searches the list it lies in, which bounds its k-th distance,
then the lists whose bounding box is nearer than that. These are found by going down a tree of boxes: of stretches of the
curve, of their parts, of lists. Queries whose bound is wide (strays, queries of lists that hold too few points) go down
one by one, and on every level the farthest corner of a box that holds enough points tightens their bound. In a list, distances grow dimension by dimension; a candidate is
abandoned as soon as its partial distance fails the test against the bound. In few dimensions the test's threshold is
the bound itself, so nothing is lost; in many it is the usual hypothesis test with error parameter eps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.session import materialize

LIST_SIZE = 512
#: Lists that share a node of the tree of boxes, and partitions of the index that share one.
FANOUT = 256
#: A bound this many times the usual squared one of its list makes a query wide.
WIDE = 16.0
BITS = 20


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.RandomState(seed).randn(dims, dims))
    return q * np.sign(np.diag(r))


def threshold(r2: np.ndarray, seen: int, dims: int, eps: float) -> np.ndarray:
    """Squared partial distance over `seen` of `dims` rotated dimensions beyond which a candidate is abandoned."""
    if seen >= dims:
        return r2
    return r2 * min(1.0, seen / dims * (1 + eps / np.sqrt(seen)) ** 2)


def scan(queries: np.ndarray, r2: np.ndarray, columns: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Surviving (query, point, squared distance) of a list: columns is dims x points, queries is rows x dims."""
    dims = len(columns)
    d = (queries[:, :1] - columns[0][None, :]) ** 2
    qi, pi = np.nonzero(d <= threshold(r2, 1, dims, eps)[:, None])
    d = d[qi, pi]
    for i in range(1, dims):
        d = d + (queries[qi, i] - columns[i][pi]) ** 2
        keep = d <= threshold(r2[qi], i + 1, dims, eps)
        qi, pi, d = qi[keep], pi[keep], d[keep]
    return qi, pi, d


def best(qi: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k nearest distinct ids of each query, nearest first; ties by id."""
    order = np.lexsort((ids, d, qi))
    # of an id that occurs twice the nearer place counts
    first = np.zeros(len(order), bool)
    pairs = np.lexsort((d, ids, qi))
    lead = np.r_[True, (qi[pairs][1:] != qi[pairs][:-1]) | (ids[pairs][1:] != ids[pairs][:-1])] if len(pairs) else np.zeros(0, bool)
    first[pairs[lead]] = True
    order = order[first[order]]
    q = qi[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    nth = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return order[nth < k]


def _spread(c: Column) -> Column:
    """Puts two zero bits between the bits of a 20-bit integer."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def _curve(rotated: list[Column], scale: list[tuple[Column, Column]]) -> Column:
    code = F.lit(0).cast("long")
    for i, (c, (lo, hi)) in enumerate(zip(rotated[:3], scale)):
        unit = (c - lo) / F.greatest(hi - lo, F.lit(1e-12))
        cell = F.least(F.greatest(F.floor(unit * (1 << BITS)), F.lit(0)), F.lit((1 << BITS) - 1)).cast("long")
        code = code.bitwiseOR(F.shiftleft(_spread(cell), i))
    return code


LISTS = pa.schema([("group", pa.string()), ("top", pa.int64()), ("part", pa.int64()), ("super_id", pa.int64()), ("list_id", pa.int64()), ("n", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("ids", pa.binary()), ("block", pa.binary()), ("n_queries", pa.int32()), ("q_ids", pa.binary()), ("q_block", pa.binary()), ("q_r2", pa.binary()), ("own_q", pa.binary()), ("own_id", pa.binary()), ("own_d", pa.binary())])
LISTS_DDL = "group string, top long, part long, super_id long, list_id long, n int, lo array<double>, hi array<double>, ids binary, block binary, n_queries int, q_ids binary, q_block binary, q_r2 binary, own_q binary, own_id binary, own_d binary"


def _make_list(group: str, part: int, super_id: int, ids: np.ndarray, x: np.ndarray, is_query: np.ndarray, k: int, eps: float) -> dict:
    """One list as a row, with the results of its own queries within it."""
    at = np.flatnonzero(is_query)
    at = at[np.unique(ids[at], return_index=True)[1]]
    q, cols = x[at], np.ascontiguousarray(x.T)
    row = {"group": group, "top": part // FANOUT, "part": part, "super_id": super_id, "list_id": int(ids[0]), "n": len(np.unique(ids)), "lo": x.min(0), "hi": x.max(0), "ids": ids.tobytes(), "block": cols.tobytes(), "n_queries": len(at)}
    r2 = np.full(len(at), np.inf)
    own_q = own_id = np.zeros(0, np.int64)
    own_d = np.zeros(0)
    if len(at):
        qi, pi, d = scan(q, r2, cols, eps)
        other = ids[pi] != ids[at][qi]
        qi, pi, d = qi[other], pi[other], d[other]
        top = best(qi, ids[pi], d, k)
        own_q, own_id, own_d = ids[at][qi[top]], ids[pi[top]], d[top]
        n = np.bincount(qi[top], minlength=len(at))
        full = n == k
        ends = np.cumsum(n) - 1
        r2[full] = own_d[ends[full]]
    row |= {"q_ids": ids[at].tobytes(), "q_block": q.tobytes(), "q_r2": r2.tobytes(), "own_q": own_q.tobytes(), "own_id": own_id.tobytes(), "own_d": own_d.tobytes()}
    return row


def build_lists(points: DataFrame, group: str, id_col: str, dims: list[Column], is_query: Column, k: int, eps: float = 2.1, list_size: int = LIST_SIZE) -> DataFrame:
    """The index: one row per list, written to the shared folder. See `nearest_vectors`."""
    n_dims, rot = len(dims), rotation(len(dims))
    raw = [c.cast("double") for c in dims]
    rows = points.select(F.col(group).cast("string").alias("group"), F.col(id_col).cast("long").alias("id"), *[c.alias(f"v{i}") for i, c in enumerate(raw)], F.coalesce(is_query, F.lit(False)).alias("is_query"))
    finite = [F.col(f"v{i}").isNotNull() & ~F.isnan(f"v{i}") & (F.abs(F.col(f"v{i}")) != float("inf")) for i in range(n_dims)]
    for test in (F.col("id").isNotNull(), *finite):
        rows = rows.filter(test)
    axes = range(min(3, n_dims))
    turned = [sum((F.col(f"v{j}") * float(rot[j, i]) for j in range(n_dims)), F.lit(0.0)) for i in axes]
    rows = rows.withColumn("group", F.coalesce("group", F.lit("")))
    sketch = rows.groupBy("group").agg(*[F.kll_sketch_agg_double(turned[i]).alias(f"s{i}") for i in axes])
    read = lambda i, q: F.kll_sketch_get_quantile_double(f"s{i}", F.lit(q))
    scale = materialize(sketch.select("group", *[read(i, q).alias(f"{n}{i}") for i in axes for n, q in (("lo", 0.01), ("hi", 0.99))]), "ads-scale")
    code = _curve(turned, [(F.col(f"lo{i}"), F.col(f"hi{i}")) for i in axes])
    coded = rows.join(scale, "group").select("group", code.alias("code"), "id", "is_query", *[f"v{i}" for i in range(n_dims)])
    laid = coded.repartitionByRange("group", "code", "id").sortWithinPartitions("group", "code", "id", *[f"v{i}" for i in range(n_dims)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (ids, vectors, flags) of the current group, less than two lists of it
        pid = TaskContext.get().partitionId()
        state = {"group": None, "n_lists": 0, "super": 0, "last": None}

        def flush(whole: bool) -> list[dict]:
            """Full lists; at the end of a group what is left is one list, or two of like size, so that none is short."""
            n = sum(len(h[0]) for h in held)
            if not n or not whole and n < 2 * list_size:
                return []
            ids, x, f = (np.concatenate([h[i] for h in held]) for i in range(3))
            held.clear()
            stops = list(range(list_size, n - list_size + 1, list_size))
            if whole:
                rest = n - (stops[-1] if stops else 0)
                stops += [n - rest // 2, n] if rest > 1.5 * list_size else [n]
            out, at = [], 0
            for end in stops:
                if state["n_lists"] % FANOUT == 0:
                    state["super"] = int(ids[at])
                state["n_lists"] += 1
                out.append(_make_list(state["group"], pid, state["super"], ids[at:end], x[at:end], f[at:end], k, eps))
                at = end
            if at < n:
                held.append((ids[at:], x[at:], f[at:]))
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("group").dictionary_encode()
            codes = names.indices.to_numpy(zero_copy_only=False)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            x = np.stack([batch.column(f"v{i}").to_numpy(zero_copy_only=False) for i in range(n_dims)], axis=1)
            f = batch.column("is_query").to_numpy(zero_copy_only=False)
            out: list[dict] = []
            for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(codes)) + 1):
                g = names.dictionary[int(codes[part[0]])].as_py()
                if g != state["group"]:
                    out += flush(True)
                    state |= {"group": g, "n_lists": 0, "last": None}
                pi, px, pf = ids[part], x[part], f[part]
                # copies of a point follow each other
                same = np.r_[state["last"] is not None and state["last"][0] == pi[0] and bool((state["last"][1] == px[0]).all()), (pi[1:] == pi[:-1]) & (px[1:] == px[:-1]).all(axis=1)]
                state["last"] = (pi[-1], px[-1])
                held.append((pi[~same], px[~same] @ rot, pf[~same]))
                out += flush(False)
            if out:
                yield pa.RecordBatch.from_pylist(out, LISTS)
        if out := flush(True):
            yield pa.RecordBatch.from_pylist(out, LISTS)

    return materialize(laid.mapInArrow(cut, LISTS_DDL), "ads-lists")


def nearest_vectors(points: DataFrame, group: str, id_col: str, dims: list[Column], k: int, is_query: Column, eps: float = 2.1, list_size: int = LIST_SIZE) -> DataFrame:
    """query, neighbour, distance, rank: for each query the k nearest other vectors of its group (fewer in small groups).

    points: id_col (bigint), group, the components `dims`, and is_query, which marks the rows that ask. A null group is
    the group ''. Vectors with a null, NaN or infinite component are nobody's neighbour and ask nothing. An id counts
    once: of copies at different places the nearest counts. Two ids in one place are two vectors at distance 0. Ties:
    smaller id. All vectors are indexed and all lists that a better vector could lie in are searched; in up to four
    dimensions the result is exact, beyond that the early-abandon test errs as eps says.
    """
    n_dims = len(dims)
    lists = build_lists(points, group, id_col, dims, is_query, k, eps, list_size)
    axes = range(n_dims)
    box = [F.element_at(n, i + 1).alias(f"{n}{i}") for i in axes for n in ("lo", "hi")]
    boxes = [f"{n}{i}" for i in axes for n in ("lo", "hi")]
    whole = [f(c).alias(c) for c in boxes for f in (F.min if c[0] == "l" else F.max,)] + [F.sum("n").alias("n")]
    tree = [lists.select("group", "top", "part", "super_id", "list_id", "n", *box)]
    for keys in (["group", "top", "part", "super_id"], ["group", "top", "part"], ["group", "top"]):
        tree.append(tree[-1].groupBy(*keys).agg(*whole))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What goes down the tree: the box around a list's queries and their bounds, and each wide query by itself."""
        for b in batches:
            out = []
            for g, home, qb, qr in zip(*[b.column(c).to_pylist() for c in ("group", "home", "q_block", "q_r2")]):
                q, r2 = np.frombuffer(qb).reshape(-1, n_dims), np.frombuffer(qr)
                usual = np.median(r2[np.isfinite(r2)]) if np.isfinite(r2).any() else -1.0
                wide = r2 > max(WIDE * usual, 0.0)
                if not wide.all():
                    r = np.sqrt(r2[~wide])[:, None]
                    out.append({"group": g, "home": home, "nth": -1, "at": [], "r2": np.inf, "lo": (q[~wide] - r).min(0), "hi": (q[~wide] + r).max(0)})
                for j in np.flatnonzero(wide):
                    out.append({"group": g, "home": home, "nth": int(j), "at": q[j], "r2": r2[j], "lo": [], "hi": []})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("group", pa.string()), ("home", pa.int64()), ("nth", pa.int32()), ("at", pa.list_(pa.float64())), ("r2", pa.float64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))]))

    asking = lists.filter("n_queries > 0").select("group", F.col("list_id").alias("home"), "q_ids", "q_block", "q_r2")
    units = asking.select("group", "home", "q_block", "q_r2").mapInArrow(ask, "group string, home long, nth int, at array<double>, r2 double, lo array<double>, hi array<double>")
    units = materialize(units, "ads-units")
    together = units.filter("nth < 0").select("group", "home", *[F.element_at("lo", i + 1).alias(f"ql{i}") for i in axes], *[F.element_at("hi", i + 1).alias(f"qh{i}") for i in axes])
    alone = units.filter("nth >= 0").select("group", "home", "nth", "r2", *[F.element_at("at", i + 1).alias(f"q{i}") for i in axes])
    gap = sum((F.greatest(F.col(f"lo{i}") - F.col(f"q{i}"), F.col(f"q{i}") - F.col(f"hi{i}"), F.lit(0.0)) ** 2 for i in axes), F.lit(0.0))
    reach = sum((F.greatest(F.abs(F.col(f"lo{i}") - F.col(f"q{i}")), F.abs(F.col(f"q{i}") - F.col(f"hi{i}"))) ** 2 for i in axes), F.lit(0.0))
    touch = F.lit(True)
    for i in axes:
        touch = touch & (F.col(f"lo{i}") <= F.col(f"qh{i}")) & (F.col(f"hi{i}") >= F.col(f"ql{i}"))
    keys = ["group"]
    for nodes, own in zip(reversed(tree), ("top", "part", "super_id", "list_id")):
        leaf = own == "list_id"
        shed = [] if leaf else [*boxes, "n"]
        together = together.join(nodes, keys).filter(touch).drop(*shed)
        near = alone.join(nodes, keys).withColumn("_gap", gap).filter("_gap <= r2")
        bound = F.min(F.when(F.col("n") > k, reach * (1 + 1e-9))).over(W.partitionBy("group", "home", "nth"))
        alone = near.withColumn("r2", F.least("r2", F.coalesce(bound, F.lit(float("inf"))))).filter("_gap <= r2").drop("_gap", *shed)
        keys = [*keys, own]
    pairs = together.select("group", "home", F.lit(-1).alias("nth"), F.lit(float("inf")).alias("bound"), "list_id", *boxes).unionByName(alone.select("group", "home", "nth", F.col("r2").alias("bound"), "list_id", *boxes))
    fine = pairs.filter(F.col("home") != F.col("list_id"))
    sent = fine.join(asking, ["group", "home"]).select("group", "list_id", "nth", "bound", F.array(*[F.col(f"lo{i}") for i in axes]).alias("lo"), F.array(*[F.col(f"hi{i}") for i in axes]).alias("hi"), "q_ids", "q_block", "q_r2")

    def only_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block of queries, those whose bound reaches into the list's box."""
        for b in batches:
            out: dict[str, list] = {"group": [], "list_id": [], "q_ids": [], "q_block": [], "q_r2": []}
            for g, target, nth, bound, lo, hi, qi, qb, qr in zip(*[b.column(c).to_pylist() for c in ("group", "list_id", "nth", "bound", "lo", "hi", "q_ids", "q_block", "q_r2")]):
                q, r2 = np.frombuffer(qb).reshape(-1, n_dims), np.frombuffer(qr)
                if nth >= 0:
                    r2 = np.full(len(q), -1.0)
                    r2[nth] = bound
                else:
                    finite = np.isfinite(r2)
                    usual = np.median(r2[finite]) if finite.any() else -1.0
                    r2 = np.where(r2 > max(WIDE * usual, 0.0), -1.0, r2)  # wide ones come by themselves
                gap = np.maximum(np.maximum(np.array(lo) - q, q - np.array(hi)), 0)
                keep = (gap**2).sum(1) <= r2
                if keep.any():
                    for c, v in zip(out, (g, target, np.frombuffer(qi, np.int64)[keep].tobytes(), q[keep].tobytes(), r2[keep].tobytes())):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("group", pa.string()), ("list_id", pa.int64()), ("q_ids", pa.binary()), ("q_block", pa.binary()), ("q_r2", pa.binary())]))

    near = sent.mapInArrow(only_near, "group string, list_id long, q_ids binary, q_block binary, q_r2 binary")
    hits = pa.schema([("query", pa.int64()), ("neighbour", pa.int64()), ("d2", pa.float64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple] = []
            for ids, block, qi, qb, qr in zip(*[b.column(c).to_pylist() for c in ("ids", "block", "q_ids", "q_block", "q_r2")]):
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(qi, np.int64)
                at, pi, d = scan(np.frombuffer(qb).reshape(-1, n_dims), np.frombuffer(qr), np.frombuffer(block).reshape(n_dims, -1), eps)
                other = ids[pi] != q_ids[at]
                at, pi, d = at[other], pi[other], d[other]
                top = best(at, ids[pi], d, k)
                found.append((q_ids[at[top]], ids[pi[top]], d[top]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], schema=hits)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [np.frombuffer(b"".join(b.column(c).to_pylist()), t) for c, t in (("own_q", np.int64), ("own_id", np.int64), ("own_d", np.float64))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=hits)

    ddl = "query long, neighbour long, d2 double"
    elsewhere = near.join(lists.select("group", "list_id", "ids", "block"), ["group", "list_id"]).select("ids", "block", "q_ids", "q_block", "q_r2").mapInArrow(search, ddl)
    at_home = lists.filter("n_queries > 0").select("own_q", "own_id", "own_d").mapInArrow(own, ddl)
    merged = at_home.unionByName(elsewhere).groupBy("query", "neighbour").agg(F.min("d2").alias("d2"))
    # the k best of each task go on, so a query's candidates never come together
    nth = F.row_number().over(W.partitionBy("query").orderBy("d2", "neighbour"))
    return merged.withColumn("rank", nth).filter(F.col("rank") <= k).select("query", "neighbour", F.sqrt("d2").alias("distance"), "rank")
