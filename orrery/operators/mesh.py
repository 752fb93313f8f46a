"""Mesh and graph operators: adjacency, components, region growing, segment merge, majority vote."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.geometry import cross, dot, minus, norm
from orrery.session import materialize

MAX_ROUNDS = 60


def edges_of(faces: DataFrame) -> DataFrame:
    """fid, u, v: the three edges of each face, u < v."""
    sides = F.array(*[F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")) for a, b in (("a", "b"), ("b", "c"), ("c", "a"))])
    return faces.select("fid", F.explode(sides).alias("e")).select("fid", "e.u", "e.v")


def adjacency(faces: DataFrame) -> DataFrame:
    """f, g, u, v: pairs of faces that share an edge, f < g."""
    e = edges_of(faces)
    return e.select(F.col("fid").alias("f"), "u", "v").join(e.select(F.col("fid").alias("g"), "u", "v"), ["u", "v"]).filter("f < g").select("f", "g", "u", "v")


def face_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """fid, nx, ny, nz (unit), area; faces without area or with a missing vertex are left out."""
    joined = faces
    for p in "abc":
        joined = joined.join(vertices.select(F.col("v").alias(p), *[F.col(c).alias(p + c) for c in "xyz"]), p)
    at = {p: [F.col(p + c) for c in "xyz"] for p in "abc"}
    n = cross(minus(at["b"], at["a"]), minus(at["c"], at["a"]))
    size = norm(n)
    return joined.select("fid", *[c.alias("n" + a) for c, a in zip(n, "xyz")], size.alias("s")).filter("s > 0").select("fid", *[(F.col("n" + a) / F.col("s")).alias("n" + a) for a in "xyz"], (F.col("s") / 2).alias("area"))


def facing(adjacent: DataFrame, normals: DataFrame) -> Column | DataFrame:
    """Adds cos, the cosine between the normals of f and g."""
    one = normals.select(F.col("fid").alias("f"), *[F.col("n" + a).alias("p" + a) for a in "xyz"])
    two = normals.select(F.col("fid").alias("g"), *[F.col("n" + a).alias("q" + a) for a in "xyz"])
    both = adjacent.join(one, "f").join(two, "g")
    c = dot([F.col("p" + a) for a in "xyz"], [F.col("q" + a) for a in "xyz"])
    return both.withColumn("cos", c).drop(*[p + a for p in "pq" for a in "xyz"])


def components(nodes: DataFrame, edges: DataFrame, node: str, ends: Sequence[str]) -> DataFrame:
    """node, component: the smallest node reachable. Rounds of hooking and pointer jumping, each written out.

    nodes without edges are their own component. The number of rounds grows with the logarithm of the longest path.
    """
    a, b = ends
    pairs = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).filter("src <> dst")
    links = materialize(pairs.union(pairs.select("dst", "src")).distinct(), "components-edges")
    labels = materialize(nodes.select(F.col(node).alias("id")).distinct().withColumn("label", F.col("id")), "components")
    for _ in range(MAX_ROUNDS):
        # smallest label among the neighbours, handed to the node and to the node that its own label names
        near = links.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src").agg(F.min("label").alias("low"))
        seen = labels.join(near, labels["id"] == near["src"], "left").select("id", "label", F.least("label", "low").alias("low"))
        hooked = seen.select(F.col("label").alias("id"), "low").union(seen.select("id", "low")).groupBy("id").agg(F.min("low").alias("low"))
        lowered = labels.join(hooked, "id").select("id", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        jump = lowered.select(F.col("id").alias("label"), F.col("label").alias("top"))
        after = materialize(lowered.join(jump, "label", "left").select("id", F.least("label", "top").alias("label"), "old"), "components")
        labels = after.select("id", "label")
        if after.filter("label <> old").isEmpty():
            return labels.select(F.col("id").alias(node), F.col("label").alias("component"))
    raise RuntimeError("components did not settle")


def large_components(labelled: DataFrame, share: float) -> DataFrame:
    """component, n: those with at least `share` of all nodes, largest first in `rank`."""
    n = labelled.groupBy("component").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))  # one row
    # at most 1 / share components are left, so one task ranks them
    kept = n.crossJoin(F.broadcast(total)).filter(F.col("n") >= share * F.col("total")).drop("total")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("n"), "component")))


def merge_small(labelled: DataFrame, adjacent: DataFrame, node: str, share: float, rounds: int = 6) -> DataFrame:
    """Segments below `share` of all nodes merged into the neighbour they share most edges with; at most `rounds` rounds.

    node, component in and out. Of equal borders the smaller component wins. Two small neighbours do not swap: a segment
    only merges into a larger one, or an equally large one with a smaller label.
    """
    total = labelled.count()
    current = labelled
    for _ in range(rounds):
        sizes = current.groupBy("component").agg(F.count("*").alias("n"))
        one, two = current.select(F.col(node).alias("f"), F.col("component").alias("p")), current.select(F.col(node).alias("g"), F.col("component").alias("q"))
        touch = adjacent.select("f", "g").join(one, "f").join(two, "g").filter("p <> q").select("p", "q")
        border = touch.union(touch.select("q", "p")).groupBy("p", "q").agg(F.count("*").alias("border"))
        sized = border.join(sizes.select(F.col("component").alias("p"), F.col("n").alias("np")), "p").join(sizes.select(F.col("component").alias("q"), F.col("n").alias("nq")), "q")
        able = sized.filter((F.col("np") < share * total) & ((F.col("nq") > F.col("np")) | ((F.col("nq") == F.col("np")) & (F.col("q") < F.col("p")))))
        moves = materialize(able.groupBy("p").agg(F.min_by("q", F.struct(-F.col("border"), F.col("q"))).alias("to")), "merge-moves")
        if moves.isEmpty():
            break
        current = materialize(current.join(moves, current["component"] == moves["p"], "left").select(node, F.coalesce("to", "component").alias("component")), "merge")
    return current


def majority(votes: DataFrame, by: str, vote: str) -> DataFrame:
    """by, vote: the most frequent vote; of equally frequent ones the smallest. Counted map-side before the choice."""
    counted = votes.groupBy(by, vote).agg(F.count("*").alias("n"))
    return counted.groupBy(by).agg(F.min_by(vote, F.struct(-F.col("n"), F.col(vote))).alias(vote))


def surface_squares(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squares, corners): the sides of solid cells (n x 3 integers) that no other solid cell covers.

    A square names its four corners in order, seen from outside counter-clockwise; corners are points of the grid.
    """
    solid = set(map(tuple, cells.tolist()))
    squares = []
    for axis in range(3):
        u, v = (axis + 1) % 3, (axis + 2) % 3
        for way in (1, -1):
            step = np.eye(3, dtype=int)[axis] * way
            bare = np.array([c for c in cells if tuple((c + step).tolist()) not in solid]).reshape(-1, 3)
            base = bare + np.eye(3, dtype=int)[axis] * (way > 0)
            ring = [np.zeros(3, int), np.eye(3, dtype=int)[u], np.eye(3, dtype=int)[u] + np.eye(3, dtype=int)[v], np.eye(3, dtype=int)[v]]
            squares.append(np.stack([base + r for r in (ring if way > 0 else ring[::-1])], axis=1))
    at = np.concatenate(squares).reshape(-1, 3)
    corners, number = np.unique(at, axis=0, return_inverse=True)
    return number.reshape(-1, 4), corners


def taubin(corners: np.ndarray, edges: np.ndarray, shrink: float = 0.5, grow: float = -0.53, rounds: int = 8) -> np.ndarray:
    """Corners moved to and fro along the mean of their neighbours, so that the surface evens out and keeps its size."""
    p, degree = corners.astype(float), np.bincount(edges.ravel(), minlength=len(corners))[:, None]
    for _ in range(rounds):
        for pull in (shrink, grow):
            around = np.zeros_like(p)
            np.add.at(around, edges[:, 0], p[edges[:, 1]])
            np.add.at(around, edges[:, 1], p[edges[:, 0]])
            p = p + pull * (around / np.maximum(degree, 1) - p)
    return p
