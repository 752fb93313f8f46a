"""Point packs and JSON scenes: points sorted by cell with a cell index, poses, meta data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.geometry import voxel_key
from orrery.operators.spatial import bounds, cells

#: Schema of a pose pack; frame numbers of long names need more than 64 bits.
POSES = "fx double, fy double, cx double, cy double, w int, h int, up array<double>, frames array<struct<i: decimal(38,0), name: string, p: array<double>, q: array<double>>>"
META = "name string, count bigint, bbox struct<min: array<double>, max: array<double>>, extent double, spacing double, cell double, has_nrm boolean, intrinsics struct<fx: double, fy: double, cx: double, cy: double, w: int, h: int>, up array<double>"


def write_pack(points: DataFrame, path: str, side: float, files_per_dataset_bytes: int = 128 << 20) -> None:
    """points (dataset, seq, x, y, z, ...) as Parquet by dataset, in cell order, with the cell index and bounds beside it.

    Points are range-partitioned on dataset and cell, so that a hot dataset is written by many tasks and a reader that asks
    for a box skips row groups by their statistics. `lod_rank` orders points within a cell for partial display.
    """
    keyed = points.withColumn("cell", voxel_key([F.col(c) for c in "xyz"], side)).withColumn("lod_rank", F.xxhash64("seq"))
    laid = keyed.repartitionByRange("dataset", "cell", "lod_rank").sortWithinPartitions("dataset", "cell", "lod_rank")
    laid.write.mode("overwrite").partitionBy("dataset").parquet(f"{path}/points")
    cells(points, side, ["dataset"]).write.mode("overwrite").parquet(f"{path}/cells")
    bounds(points, ["dataset"]).write.mode("overwrite").parquet(f"{path}/bounds")


def read_box(spark: SparkSession, path: str, dataset: str, side: float, lo: tuple[float, float, float], hi: tuple[float, float, float]) -> DataFrame:
    """Points of a box: the dataset prunes folders, the range of its cells prunes row groups, the coordinates decide."""
    corner = lambda p: voxel_key([F.lit(float(v)) for v in p], side)
    inside = [F.col(c).between(a, b) for c, a, b in zip("xyz", lo, hi)]
    df = spark.read.parquet(f"{path}/points").filter((F.col("dataset") == dataset) & F.col("cell").between(corner(lo), corner(hi)))
    return df.filter(inside[0] & inside[1] & inside[2])


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry of JSON pose packs, with the pack's intrinsics; several lines a file."""
    packs = spark.read.schema(POSES).option("multiLine", "true").json(path)
    return packs.select("fx", "fy", "cx", "cy", "w", "h", "up", F.explode("frames").alias("f")).select("fx", "fy", "cx", "cy", "w", "h", "up", "f.*")


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(META).option("multiLine", "true").json(path)


def gaussians(points: DataFrame, radius: float) -> DataFrame:
    """Points (x, y, z, r, g, b) as gaussians ready for the "ply" sink: colour as first harmonic, round, nearly opaque."""
    import math

    fixed = {"opacity": 3.0, **{f"scale_{i}": math.log(radius) for i in range(3)}, "rot_0": 1.0, "rot_1": 0.0, "rot_2": 0.0, "rot_3": 0.0}
    dc = [((F.col(c) / 255.0 - 0.5) / 0.28209479177387814).cast("float").alias(f"f_dc_{i}") for i, c in enumerate("rgb")]
    return points.select(*[F.col(c).cast("float").alias(c) for c in "xyz"], *dc, *[F.lit(v).cast("float").alias(n) for n, v in fixed.items()])


def splats(gaussian: DataFrame) -> DataFrame:
    """Gaussians as splat records, the large and opaque ones first."""
    alpha = 1 / (1 + F.exp(-F.col("opacity")))
    scale = [F.exp(f"scale_{i}") for i in range(3)]
    byte = lambda c: F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0))).cast("smallint")
    rgb = [byte((F.col(f"f_dc_{i}") * 0.28209479177387814 + 0.5) * 255).alias(c) for i, c in enumerate("rgb")]
    rot = [byte(F.col(f"rot_{i}") * 128 + 128).alias(n) for i, n in enumerate(("qw", "qx", "qy", "qz"))]
    out = gaussian.select("x", "y", "z", *[s.cast("float").alias(n) for s, n in zip(scale, ("sx", "sy", "sz"))], *rgb, byte(alpha * 255).alias("a"), *rot, (-alpha * scale[0] * scale[1] * scale[2]).alias("_o"))
    return out.orderBy("_o").drop("_o")


def write_mesh(vertices: DataFrame, faces: DataFrame, path: str, sets: dict[str, DataFrame] | None = None) -> None:
    """A mesh as tables: vertices, faces and, per named set, a colour or value for each vertex."""
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    faces.write.mode("overwrite").parquet(f"{path}/faces")
    for name, values in (sets or {}).items():
        values.write.mode("overwrite").parquet(f"{path}/sets/set={name}")


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/faces")


def write_snapshot(frames: DataFrame, path: str) -> list[str]:
    """Predictions as Parquet, without the columns that are null in every row; the names that were written."""
    filled = frames.agg(*[F.count(c).alias(c) for c in frames.columns]).head()
    kept = [c for c in frames.columns if filled[c]]
    frames.select(*kept).write.mode("overwrite").parquet(path)
    return kept


def track_of(bounds: DataFrame, frames: int = 40, span: float = 0.4) -> DataFrame:
    """dataset, i, x, y, z: camera places along the x axis through the middle of each pack, evenly from -span to span of its size."""
    size = F.sqrt(sum(((F.col("hi" + a) - F.col("lo" + a)) ** 2 for a in "xyz"), F.lit(0.0))) / 3
    i = F.explode(F.sequence(F.lit(0), F.lit(frames - 1)))
    mid = {a: (F.col("lo" + a) + F.col("hi" + a)) / 2 for a in "xyz"}
    b = bounds.select("dataset", size.alias("size"), *[c.alias("m" + a) for a, c in mid.items()], i.alias("i"))
    return b.select("dataset", "i", (F.col("mx") + F.col("size") * (F.col("i") * (2 * span / (frames - 1)) - span)).alias("x"), F.col("my").alias("y"), F.col("mz").alias("z"))
