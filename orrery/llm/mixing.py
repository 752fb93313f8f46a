"""Mixes sources to target shares of tokens, by Pfair scheduling of blocks.

Each source's documents, repeated as often as needed, are a stream that is cut into blocks of equal tokens. Block j of a
source that has a share w of all blocks is released at slot floor(j / w) and due at slot ceil((j + 1) / w); at each slot
the released block with the earliest deadline goes next. So at every point of the mix each source is less than one
block away from its share.

The schedule is made in rounds, each by a task of its own: how many blocks of a source have gone before a round follows
from its share alone, to less than one block, and within the round the rule above adds less than another. The blocks
that are scheduled are half as large as those the promise is about, so two of them are one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.session import materialize

#: No source is ever so many tokens (and a document) away from its share.
BLOCK_TOKENS = 16_384
#: Half blocks in a round, unless a source would have fewer than two of them in it: then rounds are longer.
ROUND_SLOTS = 65_536
#: Ranges of the hash of doc_id, by which running sums within a source are taken.
RANGES = 4096
#: A mix of more sources than this is refused.
MAX_SOURCES = 10_000


def source_name(c: Column) -> Column:
    """Case, blanks at the ends and - for _ make no other source."""
    return F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_"))


def mix_plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: target_share, max_uses, size, n_docs, want and take; one row per source.

    sized: doc_id, source, n_tokens. want = target_share x total, total the size of all listed sources; take is want but
    at most max_uses x size; n_docs are the documents with tokens. A source without documents has size 0. Targets listed twice: the
    larger share counts. Null shares and uses count as 0.
    """
    sizes = sized.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count(F.when(F.col("n_tokens") > 0, 1)).alias("n_docs"))
    listed = targets.filter(F.col("source").isNotNull()).groupBy(source_name(F.col("source")).alias("source")).agg(F.max(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("s"), F.coalesce("max_uses", F.lit(0)).alias("u"), F.col("source").alias("name"))).alias("t"))
    both = listed.join(sizes, "source", "left").select("source", F.col("t.name").alias("listed_as"), F.col("t.s").alias("target_share"), F.col("t.u").alias("max_uses"), F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
    total = both.agg(F.sum("size").alias("total"))
    both = both.crossJoin(F.broadcast(total))  # one row
    want, cap = F.col("target_share") * F.col("total"), F.col("max_uses") * F.col("size")
    return both.withColumn("want", want).withColumn("take", F.least(want, cap.cast("double")))


def pfair(blocks: dict) -> list[tuple]:
    """(source, block, slot) by earliest deadline among released blocks; all slots are filled."""
    total = sum(blocks.values())
    waiting = [(0, s) for s, n in sorted(blocks.items()) if n > 0]
    heapq.heapify(waiting)
    ready: list[tuple] = []
    done = dict.fromkeys(blocks, 0)
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[s] + 1) * total // blocks[s]), s))
        _, s = heapq.heappop(ready)
        out.append((s, done[s], slot))
        done[s] += 1
        if done[s] < blocks[s]:
            heapq.heappush(waiting, (done[s] * total // blocks[s], s))
    return out


def round_starts(blocks: list[int], slots: int) -> list[int]:
    """How many blocks of each source have gone after `slots` slots: each its share, rounded up or down."""
    total, before, out = sum(blocks), 0, []
    for n in blocks:
        out.append((before + n) * slots // total - before * slots // total)
        before += n
    return out


def schedule(spark: SparkSession, blocks: dict[str, int], round_slots: int = ROUND_SLOTS) -> DataFrame:
    """source, block, slot for all blocks of all sources, made round by round on the executors."""
    names = sorted(s for s, n in blocks.items() if n > 0)
    counts = [blocks[s] for s in names]
    total = sum(counts)
    rounds = max(1, min(total // round_slots, min(counts, default=0) // 2))

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for m in b["id"] if total else ():
                begin, end = (total * int(x) // rounds for x in (m, m + 1))
                gone, then = round_starts(counts, begin), round_starts(counts, end)
                slots = pfair({i: z - a for i, (a, z) in enumerate(zip(gone, then))})
                yield pd.DataFrame({"source": [names[i] for i, _, _ in slots], "block": [gone[i] + j for i, j, _ in slots], "slot": [begin + t for _, _, t in slots]})

    return spark.range(rounds, numPartitions=min(rounds, spark.sparkContext.defaultParallelism)).mapInPandas(plan, "source string, block long, slot long")


def mix(sized: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, round_slots: int = ROUND_SLOTS) -> tuple[DataFrame, DataFrame]:
    """(mixed, report).

    mixed: slot, source, block, at (token offset in the source's stream), use, doc_id, n_tokens, to be read in order of
    slot, at. Each use of a document is a row; use runs from 1 to at most max_uses. A document stands in the block that
    it begins in, so one longer than a block leaves the next ones of its source empty. report, from what was mixed:
    source, target_share, actual_share, n_tokens, n_uses, size, max_uses, short (all uses are used up and the target is
    not reached). Documents of unlisted sources and of 0 tokens are not mixed. More than MAX_SOURCES listed sources are
    refused.
    """
    spark = sized.sparkSession
    sized = materialize(sized.select("doc_id", source_name(F.col("source")).alias("source"), F.col("n_tokens").cast("long").alias("n_tokens")), "mix-sizes")
    plan = materialize(mix_plan(sized, targets), "mix-plan")
    if plan.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")

    docs = sized.filter("n_tokens > 0").join(plan.filter("take > 0").select("source", "size", "take", "max_uses"), "source")
    docs = docs.withColumn("h", F.xxhash64("doc_id")).withColumn("r", F.pmod("h", F.lit(RANGES)))
    ranges = docs.groupBy("source", "r").agg(F.sum("n_tokens").alias("_t"))
    starts = ranges.select("source", "r", F.coalesce(F.sum("_t").over(W.partitionBy("source").orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    within = F.coalesce(F.sum("n_tokens").over(W.partitionBy("source", "r").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = docs.withColumn("_in", within).join(starts, ["source", "r"]).withColumn("before", F.col("_start") + F.col("_in"))
    full = F.floor(F.col("take") / F.col("size"))
    rest = F.col("take") - full * F.col("size")
    # the last pass ends with the document whose middle lies before the end of the stream
    uses = F.least(full + (F.col("before") + F.col("n_tokens") / 2 <= rest).cast("int"), F.col("max_uses")).cast("int")
    each = placed.withColumn("uses", uses).filter("uses > 0").withColumn("use", F.explode(F.sequence(F.lit(1), F.col("uses"))))
    half = max(1, block_tokens // 2)
    stream = each.withColumn("at", (F.col("use") - 1) * F.col("size") + F.col("before")).withColumn("block", F.floor(F.col("at") / half))
    stream = materialize(stream.select("source", "block", "at", "use", "doc_id", "n_tokens"), "mix-stream")

    counts = {r["source"]: int(r["n"]) for r in stream.groupBy("source").agg((F.max("block") + 1).alias("n")).collect()}  # a row per listed source
    mixed = stream.join(schedule(spark, counts, round_slots), ["source", "block"]).select("slot", "source", "block", "at", "use", "doc_id", "n_tokens")
    mixed = materialize(mixed, "mix")
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_uses"))
    report = plan.join(got, "source", "left").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0))).withColumn("n_uses", F.coalesce("n_uses", F.lit(0)))
    whole = report.agg(F.sum("n_tokens").alias("_all"))
    report = report.crossJoin(F.broadcast(whole))  # one row
    short = (F.col("n_uses") == F.col("max_uses") * F.col("n_docs")) & (F.col("want") > F.col("n_tokens"))
    return mixed, report.select("source", "listed_as", "target_share", (F.col("n_tokens") / F.col("_all")).alias("actual_share"), "n_tokens", "n_uses", "size", "max_uses", short.alias("short"))


def deviation(mixed: DataFrame) -> DataFrame:
    """source, n_blocks, most_off: the most that a source is ahead of or behind its share of the slots gone, in blocks.

    A source is furthest behind just before a slot of its own and furthest ahead just after it. Slots whose block holds
    no document's beginning are known by the numbers of those that do.
    """
    blocks = mixed.select("source", "block", "slot").distinct()
    whole = blocks.agg((F.max("slot") + 1).alias("_slots"))
    share = blocks.groupBy("source").agg((F.max("block") + 1).alias("n_blocks")).crossJoin(F.broadcast(whole))  # one row
    w = F.col("n_blocks") / F.col("_slots")
    off = F.greatest(w * F.col("slot") - F.col("block"), F.col("block") + 1 - w * (F.col("slot") + 1))
    return blocks.join(share, "source").groupBy("source").agg(F.max("n_blocks").alias("n_blocks"), (F.max(off) / 2).alias("most_off"))
