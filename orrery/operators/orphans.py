"""References to records that do not exist, by bitmaps.

Keys are integers. Where they are sparse (hashes, ids with wide gaps) they go through `dictionary`, a dense code for each.
A key falls into a range of 32,768 keys and a bit in it. Per
range and period there is a bitmap of the keys referred to, of the keys created and of the keys deleted. Going through
the periods, a range's referred-to bits AND NOT the bits that live through the whole period leave the suspects, which
are decoded; only rows with these keys are checked against the moments of creation and deletion.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.session import materialize

RANGE = 32_768
DAY = 86_400


def seconds(epoch: Column) -> Column:
    """Epoch in seconds, also from milliseconds (values beyond 1e11, which would be the year 5138 in seconds)."""
    return F.when(F.abs(epoch) > 1e11, epoch / 1000).otherwise(epoch)


#: Keys that a range holds on average below which keys are encoded: a bitmap costs 4 KB however few they are.
SPARSE = 64


def dictionary(keys: DataFrame, column: str) -> DataFrame:
    """Key and code: a dense integer for each distinct non-null key, in the order of texts and of positive integers.

    Integers are told apart by four times 16 bits and codes come from counts on each level, so no window sees more than the
    values of 16 bits. Texts are counted by their first three bytes.
    """
    distinct = keys.select(column).filter(F.col(column).isNotNull()).distinct()
    if dict(keys.dtypes)[column] not in ("bigint", "int", "smallint", "tinyint"):
        return _text_dictionary(distinct, column)
    h = F.col(column).cast("long")
    levels = {f"_l{i}": F.shiftright("_h", 64 - 16 * i) for i in (1, 2, 3)}
    distinct = materialize(distinct.withColumn("_h", h).select(column, "_h", *[c.alias(n) for n, c in levels.items()]), "dictionary")
    three = distinct.groupBy("_l1", "_l2", "_l3").agg(F.count("*").alias("_n"))
    two = three.groupBy("_l1", "_l2").agg(F.sum("_n").alias("_m"))
    one = two.groupBy("_l1").agg(F.sum("_m").alias("_k"))
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    one = one.select("_l1", before("_k", W.partitionBy(F.lit(0)).orderBy("_l1")).alias("_a"))  # at most 65,536 rows
    two = two.select("_l1", "_l2", before("_m", W.partitionBy("_l1").orderBy("_l2")).alias("_b"))
    three = three.select("_l1", "_l2", "_l3", before("_n", W.partitionBy("_l2").orderBy("_l3")).alias("_c"))
    starts = three.join(two, ["_l1", "_l2"]).join(one, "_l1").select("_l3", (F.col("_a") + F.col("_b") + F.col("_c")).alias("_start"))
    nth = F.row_number().over(W.partitionBy("_l3").orderBy("_h", column)) - 1
    return distinct.withColumn("_nth", nth).join(starts, "_l3").select(column, (F.col("_start") + F.col("_nth")).alias("code"))


def _text_dictionary(distinct: DataFrame, column: str) -> DataFrame:
    distinct = distinct.withColumn("_bin", F.substring(F.hex(F.col(column).cast("string")), 1, 6))
    counts = distinct.groupBy("_bin").agg(F.count("*").alias("_n")).withColumn("_hi", F.substring("_bin", 1, 2))
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tops = counts.groupBy("_hi").agg(F.sum("_n").alias("_m"))  # at most 257 rows
    tops = tops.select("_hi", before("_m", W.partitionBy(F.lit(0)).orderBy("_hi")).alias("_top"))
    starts = counts.withColumn("_low", before("_n", W.partitionBy("_hi").orderBy("_bin"))).join(tops, "_hi")
    nth = F.row_number().over(W.partitionBy("_bin").orderBy(column)) - 1
    return distinct.withColumn("_nth", nth).join(starts, "_bin").select(column, (F.col("_top") + F.col("_low") + F.col("_nth")).alias("code"))


def is_sparse(references: DataFrame, parents: DataFrame) -> bool:
    """Whether ranges of keys hold few keys; counted approximately, in one pass and one row."""
    both = references.select("key").union(parents.select("key"))
    n = both.agg(F.approx_count_distinct("key").alias("keys"), F.approx_count_distinct(F.shiftright("key", 15)).alias("ranges")).head()
    return n["keys"] < SPARSE * n["ranges"] and n["ranges"] > 1


def bitmaps(df: DataFrame, key: str, period: Column, kind: str) -> DataFrame:
    """range, period, kind, bits: a bitmap of the keys of each range and period; partial bitmaps are made before the shuffle."""
    k = F.col(key).cast("long")
    return (
        df.select(F.shiftright(k, 15).alias("range"), period.cast("long").alias("period"), k.bitwiseAND(F.lit(RANGE - 1)).alias("_bit"))
        .groupBy("range", "period")
        .agg(F.bitmap_construct_agg("_bit").alias("bits"))
        .withColumn("kind", F.lit(kind))
    )


def _pack(b: bytes) -> bytes:
    return zlib.compress(b, 1)


def suspects(references: DataFrame, parents: DataFrame) -> DataFrame:
    """key, period of references whose key does not live through the whole period.

    references: key, at. parents: key, created, deleted (null while alive); all in seconds. Bitmaps of one range meet in
    one task; it holds one bitmap of 4 KB per period and kind, whatever the number of rows.
    """
    day = lambda c: F.floor(F.col(c) / DAY)
    used = bitmaps(references, "key", day("at"), "used")
    born = bitmaps(parents.filter(F.col("created").isNotNull()), "key", day("created"), "born")
    gone = bitmaps(parents.filter(F.col("deleted").isNotNull()), "key", day("deleted"), "gone")
    both = born.unionByName(gone)

    def and_not(ref: pd.DataFrame, par: pd.DataFrame) -> pd.DataFrame:
        keys, periods = [], []
        if len(ref):
            par = par.assign(bits=[_pack(b) for b in par["bits"]])
            events = par.sort_values("period", kind="stable")
            alive, dead, at = np.zeros(RANGE // 8, np.uint8), np.zeros(RANGE // 8, np.uint8), 0
            stamps, kinds, packed = events["period"].to_numpy(), events["kind"].to_numpy(), events["bits"].to_numpy()
            pending: list[int] = []
            for period, bits, low in ref.sort_values("period")[["period", "bits", "range"]].itertuples(index=False):
                while at < len(stamps) and stamps[at] <= period:
                    pending.append(at)
                    at += 1
                rest = []
                for i in pending:
                    other = np.frombuffer(zlib.decompress(packed[i]), np.uint8)
                    if kinds[i] == "gone":
                        dead |= other  # from the day of deletion on
                    elif stamps[i] < period:
                        alive |= other  # from the day after creation on
                    else:
                        rest.append(i)
                pending = rest
                left = np.frombuffer(bits, np.uint8) & ~(alive & ~dead)
                found = np.flatnonzero(np.unpackbits(left, bitorder="little"))
                keys.append(found.astype(np.int64) + low * RANGE)
                periods.append(np.full(len(found), period, np.int64))
        return pd.DataFrame({"key": np.concatenate(keys) if keys else np.zeros(0, np.int64), "period": np.concatenate(periods) if periods else np.zeros(0, np.int64)})

    return used.groupBy("range").cogroup(both.groupBy("range")).applyInPandas(and_not, "key long, period long")


def orphans(references: DataFrame, parents: DataFrame, encode: bool | None = None) -> DataFrame:
    """The rows of references whose key has no parent alive at their time, with all their columns.

    references: key (bigint), at (seconds) and any other columns. parents: key, created, deleted, in seconds.
    A parent is alive at a time if created at or before it and not deleted by then. Rows with a null key are no
    references. A reference with a null time is one at the end of time. A parent with null created never lives.
    Keys index the bitmaps through a dictionary if encode says so; by default where they are sparse.
    """
    end = 253_402_300_799.0
    refs = references.filter(F.col("key").isNotNull()).withColumn("__at", F.coalesce("at", F.lit(end)))
    if is_sparse(refs, parents) if encode is None else encode:
        codes = materialize(dictionary(refs.select("key").union(parents.select("key")), "key"), "codes")
        coded = lambda df: df.join(codes, "key").drop("key").withColumnRenamed("code", "key")
        found = suspects(coded(refs.select("key", F.col("__at").alias("at"))), coded(parents.select("key", "created", "deleted")))
        found = found.withColumnRenamed("key", "code").join(codes, "code").select("key", "period")
    else:
        found = suspects(refs.select("key", F.col("__at").alias("at")), parents)
    rows = refs.withColumn("__day", F.floor(F.col("__at") / DAY).cast("long"))
    hit = found.select(F.col("key").alias("__key"), F.col("period").alias("__period"))
    rows = rows.join(hit, (rows["key"] == hit["__key"]) & (rows["__day"] == hit["__period"]), "left_semi")
    lives = parents.filter(F.col("created").isNotNull()).select("key", "created", "deleted").distinct()
    own = lives.select(*[F.col(c).alias(f"__p_{c}") for c in lives.columns])
    alive = (F.col("key") == F.col("__p_key")) & (F.col("__p_created") <= F.col("__at")) & (F.col("__p_deleted").isNull() | (F.col("__p_deleted") > F.col("__at")))
    return rows.join(own, alive, "left_anti").drop("__at", "__day")


def orphan_report(orphan_rows: DataFrame, table_name: str) -> DataFrame:
    """Orphan references per referencing table and day."""
    day = F.to_date(F.timestamp_seconds(F.col("at")))
    return orphan_rows.groupBy(F.lit(table_name).alias("tab"), day.alias("day")).agg(F.count("*").alias("n_orphans"), F.count_distinct("key").alias("n_keys"))
