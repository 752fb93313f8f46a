"""Incremental forms of the batch operators, on Structured Streaming. All read files as they arrive and stop when idle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orrery.functions.geometry import voxel_key


def arriving(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def fresh_voxels(points: DataFrame, side: float) -> DataFrame:
    """The first point of each voxel, as it arrives. State grows with the number of voxels ever seen."""
    return points.withColumn("key", voxel_key([F.col(c) for c in "xyz"], side)).dropDuplicates(["key"])


def fresh_voxels_within(points: DataFrame, side: float, ts: str, late: str) -> DataFrame:
    """As fresh_voxels, with state bounded by a watermark: a voxel seen again later than `late` counts as new."""
    keyed = points.withColumn("key", voxel_key([F.col(c) for c in "xyz"], side)).withWatermark(ts, late)
    return keyed.dropDuplicatesWithinWatermark(["key"])


def nearest_so_far(points: DataFrame, side: float, depth: str) -> DataFrame:
    """The nearest observation of each voxel so far; write in update or complete mode."""
    return points.groupBy(voxel_key([F.col(c) for c in "xyz"], side).alias("key")).agg(F.min(depth).alias("zmin"), F.count("*").alias("n"))


def gap_sessions(events: DataFrame, by: list[str], ts: str, gap: str, late: str) -> DataFrame:
    """Sessions with a fixed gap; a session comes out in append mode once the watermark has passed its end."""
    s = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return s.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latest_state(updates: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """The last row of each key by `order`, so far; write in update or complete mode."""
    return updates.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("s")).select(key, "s.*")


def pending_only(batch: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a batch whose output is not there yet."""
    return batch.join(done, keys, "left_anti").dropDuplicates(keys)


def append_missing(stream: DataFrame, out: str, keys: list[str], make: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Makes and appends what is missing in `out`, batch by batch; may be stopped and started again at any time.

    A batch that is replayed after a failure finds its rows in `out` and appends nothing twice. make must keep `keys`.
    """

    def one(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
        there = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path)
        todo = pending_only(batch, spark.read.parquet(out).select(*keys), keys) if there else batch.dropDuplicates(keys)
        make(todo).write.mode("append").parquet(out)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a streaming query over all files there are. Append mode writes Parquet; complete mode keeps the last state."""
    spark = df.sparkSession
    if mode == "append":
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    else:
        last = lambda b, _: b.write.mode("overwrite").parquet(out)
        df.writeStream.foreachBatch(last).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
