"""Packs documents into containers of fixed capacity by the sum-of-squares rule.

Documents are spread over shards by the hash of their id; each shard packs online: a document goes to the fill level
for which the sum over levels of the squared number of containers partly filled to that level becomes smallest. What is
still partly filled at the end of the shards is packed once more, as items, by the same rule.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import materialize

CAPACITY = 2048
#: Documents a shard holds; more make fuller containers and fewer tasks.
SHARD_DOCS = 25_000
#: Shards whose leftovers are packed together.
MERGE_SHARDS = 256


class SumOfSquares:
    """Level array of partly filled containers: counts[h] containers are filled to h."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[int]] = {}
        self.n = 0

    def new(self) -> int:
        self.n += 1
        return self.n - 1

    def place(self, size: int) -> tuple[int, int]:
        """Container and offset for an item of 1..capacity."""
        b, counts = self.capacity, self.counts
        if size == b:
            return self.new(), 0
        # growth of the sum of squares, by level of the container chosen; a full container counts no more
        low = counts[1 : b - size + 1]
        growth = 2 * (counts[size + 1 : b + 1] - low) + 2
        growth[-1] = 1 - 2 * low[-1]
        growth = np.where(low > 0, growth, np.iinfo(np.int64).max)
        level = b - size - int(np.argmin(growth[::-1]))
        if growth[level - 1] <= 2 * counts[size] + 1:
            where = self.open[level].pop()
            counts[level] -= 1
        else:
            where, level = self.new(), 0
        full = level + size
        if full < b:
            counts[full] += 1
            self.open.setdefault(full, []).append(where)
        return where, level


def pack_sizes(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Container and offset of each item (sizes 1..capacity, in order of arrival), and the fill of each container."""
    packer = SumOfSquares(capacity)
    placed = [packer.place(int(s)) for s in sizes]
    where = np.array([p[0] for p in placed], np.int64)
    return where, np.array([p[1] for p in placed], np.int64), np.bincount(where, weights=sizes, minlength=packer.n).astype(np.int64)


def pack(sized: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """doc_id, part, n_tokens, doc_offset, container, container_offset.

    sized: doc_id, n_tokens. A document of at most capacity tokens is one part; a larger one fills whole containers and
    its rest, if any, is placed as an item. A document of 0 or null tokens needs no room: one part of 0 tokens with
    container null. A doc_id counts once, with its most tokens. Empty input: empty result.
    """
    n = sized.count()
    shards = max(1, -(-n // shard_docs))
    cut = sized.filter(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"))

    def pack_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n_tokens"], ascending=[True, False]).drop_duplicates("doc_id")
        ids, sizes, shard = pdf["doc_id"].to_numpy(np.int64), pdf["n_tokens"].to_numpy(np.int64), int(pdf["shard"].iloc[0])
        order = np.random.RandomState(shard % (1 << 31)).permutation(len(ids))  # arrival without the order of ids
        ids, sizes = ids[order], sizes[order]
        whole = np.where(sizes > capacity, sizes // capacity, 0)
        rest = sizes - whole * capacity
        item = rest > 0
        where, offset, fill = pack_sizes(rest[item], capacity)
        out = [pd.DataFrame({"doc_id": ids[item], "part": whole[item], "n_tokens": rest[item], "doc_offset": whole[item] * capacity, "container": where, "container_offset": offset, "fill": fill[where] if len(where) else where})]
        of = np.repeat(np.arange(len(ids)), whole)
        part = np.arange(len(of)) - np.repeat(np.cumsum(whole) - whole, whole)
        out.append(pd.DataFrame({"doc_id": ids[of], "part": part, "n_tokens": capacity, "doc_offset": part * capacity, "container": len(fill) + np.arange(len(of)), "container_offset": 0, "fill": capacity}))
        both = pd.concat(out)
        both["container"] = both["container"].astype(np.int64) + (shard << 36)
        empty = ids[sizes == 0]
        none = pd.DataFrame({"doc_id": empty, "part": 0, "n_tokens": 0, "doc_offset": 0, "container": pd.array([None] * len(empty), "Int64"), "container_offset": 0, "fill": capacity})
        both["container"] = both["container"].astype("Int64")
        return pd.concat([both, none]) if len(empty) else both

    schema = "doc_id long, part long, n_tokens long, doc_offset long, container long, container_offset long, fill long"
    first = materialize(cut.groupBy("shard").applyInPandas(pack_shard, schema), "packing")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fill", "container"], ascending=[False, True])
        where, offset, _ = pack_sizes(pdf["fill"].to_numpy(np.int64), capacity)
        heads = pdf["container"].to_numpy(np.int64)
        lead = heads[np.unique(where, return_index=True)[1]]  # a merged container is named after its first part
        return pd.DataFrame({"container": heads, "target": lead[where], "shift": offset})

    partly = first.filter(F.col("fill") < capacity).select("container", "fill", F.shiftright("container", 36).alias("shard")).distinct()
    merged = partly.groupBy(F.floor(F.col("shard") / MERGE_SHARDS).alias("g")).applyInPandas(merge, "container long, target long, shift long")
    out = first.join(merged, "container", "left")
    return out.select("doc_id", "part", "n_tokens", "doc_offset", F.coalesce("target", "container").alias("container"), (F.col("container_offset") + F.coalesce("shift", F.lit(0))).alias("container_offset"))


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """n_containers, n_tokens, fill_rate (null without containers)."""
    c = packed.filter(F.col("container").isNotNull()).groupBy("container").agg(F.sum("n_tokens").alias("t"))
    return c.agg(F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens"), (F.sum("t") / (F.count("*") * capacity)).alias("fill_rate"))
