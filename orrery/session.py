"""Session defaults, table loading and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None, driver_memory: str = "8g") -> SparkSession:
    """A session with the settings the operators are written for: UTC, AQE with skew handling, Arrow."""
    builder = (
        SparkSession.builder.master(master)
        .appName("orrery")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.extraJavaOptions", "-Duser.timezone=UTC")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_orrery_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="orrery-code-")) / "orrery.zip"
    atexit.register(shutil.rmtree, path.parent, ignore_errors=True)
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._orrery_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share, below spark.checkpoint.dir.

    Only a local session that sets no such folder (tests) gets a temporary one, removed at exit.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="orrery-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/orrery/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and a lost executor loses nothing.

    What was written goes when the driver ends, as results may be read until then.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return df.sparkSession.read.schema(df.schema).parquet(path)
