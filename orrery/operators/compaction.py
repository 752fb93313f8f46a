"""Compaction of many small files into few, with copies of one record folded into it.

A small file is a row: who recorded it, where it lay, what it holds. The lake that compaction writes is partitioned
by recording and tree. One run
1. plans: counts files and bytes per partition and keeps the partitions with more small files than allowed;
2. reserves the next snapshot version by creating its intent file, which only one writer can do, and keeps it alive;
3. rewrites only those partitions, by dynamic partition overwrite, into folders of its own that nobody reads yet;
4. publishes the version by creating its manifest, after checking that it still holds the intent and that nobody
   published a change to the same partitions meanwhile.

A manifest names, for each partition, the folder that holds it; readers see only what a manifest names. A writer that
dies leaves folders that no manifest names.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.session import materialize, shared_dir

#: Endings that copy tools, browsers and editors append to a file name, besides the extension itself.
MARKS = r"(\s+|\.(jpe?g|png|bak|tmp|old|orig)|~|\s*\(\d+\)|[\s_-]+copy)+$"
#: Above this many partitions the plan is joined by shuffle instead of broadcast (about 100 bytes a row).
BROADCAST_PLAN_ROWS = 200_000
#: Columns that compaction adds.
ADDED = {"recording", "tree_key", "product", "frame", "part_rec", "part_tree", "out_files", "part_ver", "_canon", "_first", "_last", "_surplus", "_key", "_slot", "_nth"}
#: Members of one record paired within one join group; larger groups are salted.
PAIR_BLOCK = 1024


class CommitConflict(RuntimeError):
    """Another writer changed the same partitions since the snapshot this run was planned on."""


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def canonical_path(path: Column) -> Column:
    """Lower case, unescaped (also twice escaped), forward slashes, without what lies before the tree."""
    c = _blank(path)
    for _ in range(2):
        c = F.when(c.contains("%"), F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)).otherwise(c)
    c = F.translate(F.lower(c), "\\", "/")
    odd = c.contains("//") | c.contains("./") | c.startswith("/") | c.contains("street_video/")
    plain = F.ltrim(F.regexp_replace(c, r"/+(\./+)*", "/"), F.lit("./ \t\r\n"))
    return F.when(odd, F.when(plain.contains("street_video/"), F.substring_index(plain, "street_video/", -1)).otherwise(plain)).otherwise(F.ltrim(c))


def _stem(name: Column) -> Column:
    """Name without its extension and the marks of copies; the pattern runs only on names that could hold a mark."""
    body = F.substring(name, F.lit(1), F.length(name) - 4)
    usual = (name.endswith(".jpg") | name.endswith(".png")) & ~(body.contains(".") | body.contains(" ") | body.contains("~") | body.contains("(") | body.endswith("copy"))
    return F.when(usual, body).otherwise(F.regexp_replace(name, MARKS, ""))


def identify(files: DataFrame) -> DataFrame:
    """Adds recording, tree_key, product, frame: the identity of a small file, from the spelling of its path.

    The path decides; tree and cam are only copies of it and may be null. A path outside the known trees keeps its
    first folder as its tree; a null or empty path gives empty parts. A null dataset counts as the shipped recording ''.
    """
    canon, first, last = F.col("_canon"), F.col("_first"), F.col("_last")
    inner = F.length(canon) - F.length(first) - F.length(last) - 2
    return (
        files.withColumn("_canon", canonical_path(F.col("path")))
        .withColumn("_first", F.substring_index("_canon", "/", 1))
        .withColumn("_last", F.substring_index("_canon", "/", -1))
        .withColumn("recording", F.rtrim(F.trim(_blank(F.col("dataset"))), F.lit("\\/")))
        .withColumn("tree_key", F.when(canon.contains("/"), first).otherwise(F.lower(_blank(F.col("tree")))))
        .withColumn("product", F.when(canon.contains("/") & (inner > 0), F.substring(canon, F.length(first) + 2, inner)).otherwise(""))
        .withColumn("frame", _stem(last))
        .drop("_canon", "_first", "_last")
    )


def _identity() -> list[Column]:
    """What makes a record, a null payload apart from an empty one."""
    return [F.col("recording"), F.col("tree_key"), F.col("product"), F.col("frame"), F.col("payload").isNull(), F.col("payload")]


def _proof() -> Column:
    """SHA-256 over the identity and the content, each part with its length before it."""
    parts = [F.col(c).cast("binary") for c in ("recording", "tree_key", "product", "frame")] + [F.coalesce("payload", F.lit(b""))]
    sized = [x for p in parts for x in (F.octet_length(p).cast("string").cast("binary"), F.lit(b":"), p)]
    return F.sha2(F.concat(F.when(F.col("payload").isNull(), F.lit(b"-")).otherwise(F.lit(b"+")), *sized), 256)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.dtypes)


@dataclass
class SnapshotLog:
    """Versions of a lake: `_snapshots/v<N>.intent` reserves a version, `_snapshots/v<N>.json` publishes it.

    The intent names its owner, who renews its time while writing. One that nobody renewed for lease_s is a dead
    writer's: it is renamed away, which only one writer can do, before a new one is created. The manifest is created
    once, and that is the moment of publication.
    """

    spark: SparkSession
    root: str
    lease_s: float = 3600
    owner: str = field(default_factory=lambda: uuid.uuid4().hex)

    def _path(self, version: int, kind: str) -> str:
        return f"{self.root}/_snapshots/v{version:08d}.{kind}"

    def _create(self, path: str, content: dict) -> bool:
        fs, p, jvm = _fs(self.spark, path)
        try:
            out = fs.create(p, False)
        except Exception as e:  # an existing file is the one failure that means "somebody else was first"
            if fs.exists(p):
                return False
            raise e
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        return True

    def _read(self, path: str) -> dict:
        fs, p, jvm = _fs(self.spark, path)
        if not fs.exists(p):
            return {}
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode() or "{}")
        finally:
            stream.close()

    def versions(self, kind: str = "json") -> list[int]:
        fs, p, _ = _fs(self.spark, f"{self.root}/_snapshots")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:9]) for n in names if n.endswith("." + kind) and n[1:9].isdigit())

    def current(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int) -> dict:
        return self._read(self._path(version, "json"))

    def touched_since(self, base: int) -> DataFrame | None:
        """Partitions that versions after base changed."""
        paths = [self.manifest(v)["partitions"] for v in self.versions() if v > base]
        return self.spark.read.parquet(*paths) if paths else None

    def reserve(self, base: int) -> int:
        """The next version; raises CommitConflict while another live writer holds it."""
        version = max([base, self.current(), 0]) + 1
        path = self._path(version, "intent")
        mine = {"base": base, "owner": self.owner}
        if self._create(path, mine):
            return version
        fs, p, jvm = _fs(self.spark, path)
        try:
            idle = time.time() - fs.getFileStatus(p).getModificationTime() / 1000
            if idle > self.lease_s and version not in self.versions():
                if fs.rename(p, jvm.org.apache.hadoop.fs.Path(f"{path}-dead-{self.owner}")) and self._create(path, mine):
                    return version
        except Exception as e:  # another writer took it away meanwhile
            raise CommitConflict(f"version {version} is being written") from e
        raise CommitConflict(f"version {version} is being written")

    def holds(self, version: int) -> bool:
        return self._read(self._path(version, "intent")).get("owner") == self.owner

    @contextmanager
    def alive(self, version: int) -> Iterator[None]:
        """Renews the intent's time from a thread while the version is written; gives it back at the end."""
        done = threading.Event()

        def renew() -> None:
            while not done.wait(max(self.lease_s / 4, 1)):
                if self.holds(version):
                    fs, p, _ = _fs(self.spark, self._path(version, "intent"))
                    fs.setTimes(p, int(time.time() * 1000), -1)

        thread = threading.Thread(target=renew, daemon=True)
        thread.start()
        try:
            yield
        finally:
            done.set()
            thread.join()
            self.release(version)

    def publish(self, version: int, base: int, partitions: str, **facts) -> None:
        """Refused if the intent was lost, if the same partitions were changed after base, or if the version is out."""
        if not self.holds(version):
            raise CommitConflict(f"the reservation of version {version} was taken over")
        clash = self.touched_since(base)
        if clash is not None and not clash.join(self.spark.read.parquet(partitions), ["recording", "tree_key"], "left_semi").isEmpty():
            raise CommitConflict(f"partitions of this run changed after version {base}")
        if not self._create(self._path(version, "json"), {"version": version, "base": base, "partitions": partitions, "owner": self.owner, **facts}):
            raise CommitConflict(f"version {version} was published by another writer")

    def release(self, version: int) -> None:
        """Gives the reservation back, if it still is this writer's."""
        if self.holds(version):
            fs, p, _ = _fs(self.spark, self._path(version, "intent"))
            fs.delete(p, False)


@dataclass
class Compaction:
    lake: str
    version: int
    #: recording, tree_key, n_files, n_bytes, out_files of each rewritten partition
    plan: DataFrame
    #: file_id, record_id (smallest file_id of the record), copies: files of records that came more than once
    copies: DataFrame

    def records(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """The lake as a published version holds it, by default the newest."""
        log = SnapshotLog(spark, self.lake)
        known = log.manifest(log.current() if version is None else version)
        state = spark.read.parquet(known["state"])
        folders = [r["part_ver"] for r in state.select("part_ver").distinct().collect()]  # one per version that is still read
        part = lambda c: F.substring(F.col(c), 2, 1 << 20)
        if folders:
            rows = spark.read.option("basePath", f"{self.lake}/data").schema(known["schema"]).parquet(*[f"{self.lake}/data/part_ver={v}" for v in folders])
            if known["replaced"]:  # folders hold partitions that a later version wrote anew
                rows = rows.join(state, ["part_ver", "part_rec", "part_tree"], "left_semi")
        else:
            rows = spark.createDataFrame([], known["schema"])
        return rows.withColumn("recording", part("part_rec")).withColumn("tree_key", part("part_tree")).drop("part_rec", "part_tree", "part_ver")


def source_ledger(identified: DataFrame) -> DataFrame:
    """One narrow row per small file: where it belongs, its size, and a 64-bit hash of its identity and content."""
    size = F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long") + 64
    return identified.select("file_id", "recording", "tree_key", size.alias("size"), F.xxhash64(*_identity()).alias("h"))


def plan_compaction(ledger: DataFrame, max_small_files: int, small_bytes: int, target_bytes: int) -> DataFrame:
    """Per partition of recording and tree the number of small files; only partitions with more than max_small_files."""
    return (
        ledger.groupBy("recording", "tree_key")
        .agg(F.count(F.when(F.col("size") <= small_bytes, 1)).alias("n_small"), F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))
        .filter(F.col("n_small") > max_small_files)
        .withColumn("out_files", F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / target_bytes)).cast("int"))
    )


def likely_copies(ledger: DataFrame) -> DataFrame:
    """file_id of files whose hash another file has too. Partial aggregation folds a hot record before the shuffle."""
    known = ledger.filter(F.col("file_id").isNotNull())
    groups = known.groupBy("h").agg(F.min("file_id").alias("_low"), F.max("file_id").alias("_top")).filter("_low < _top")
    return known.join(groups.select("h"), "h").select("file_id").distinct()


def find_copies(identified: DataFrame, likely: DataFrame) -> DataFrame:
    """file_id, record_id, copies, recording, tree_key of files that are copies: likely ones whose SHA-256 is the same too."""
    known = identified.join(likely, "file_id").select("file_id", "recording", "tree_key", _proof().alias("proof"))
    known = materialize(known, "compaction-proofs")
    groups = known.groupBy("proof").agg(F.min("file_id").alias("record_id"), F.max("file_id").alias("_top"), F.count("*").alias("copies"))
    groups = groups.filter("record_id < _top").drop("_top")
    return known.join(groups, "proof").select("file_id", "record_id", "copies", "recording", "tree_key")


def compact(
    files: DataFrame,
    lake: str | None = None,
    max_small_files: int = 1,
    small_bytes: int = 32 << 20,
    target_bytes: int = 128 << 20,
    base_version: int | None = None,
) -> Compaction:
    """Rewrites the partitions of files (recording and tree) that hold more than max_small_files small files.

    files: file_id, dataset, tree, path, payload; all other columns are carried along, one with the name of an added
    column (ADDED) as <name>_source. Of files that are copies of one record (same recording, tree, product, frame and payload) the one with the
    smallest file_id is kept; a row that comes twice counts once. A partition comes out as ceil(bytes / target_bytes)
    files. Partitions with fewer small files stay as they are. A row without file_id is a record of its own, known by
    path and payload. Empty input publishes a version without partitions.
    """
    spark = files.sparkSession
    files = files.withColumnsRenamed({c: f"{c}_source" for c in files.columns if c.lower() in ADDED})
    lake = lake or shared_dir(spark, "lake")
    log = SnapshotLog(spark, lake)
    base = log.current() if base_version is None else base_version
    known = identify(files)
    ledger = materialize(source_ledger(known), "compaction-ledger")
    plan = materialize(plan_compaction(ledger, max_small_files, small_bytes, target_bytes), "compaction-plan")
    n_parts = plan.count()
    plan_side = F.broadcast(plan) if n_parts <= BROADCAST_PLAN_ROWS else plan
    plan_side = plan_side.select("recording", "tree_key", "out_files")
    likely = materialize(likely_copies(ledger.join(plan_side, ["recording", "tree_key"])), "compaction-likely")
    copies = materialize(find_copies(known, likely), "compaction-copies")

    version = log.reserve(base)
    before = log.current()
    with log.alive(version):
        # Each payload is shuffled once, straight to the file it ends in; a marker row meets each surplus copy there.
        place = plan_side.select(F.col("recording").alias("part_rec"), F.col("tree_key").alias("part_tree"), "out_files")
        rows = known.select(*files.columns, "product", "frame", F.col("recording").alias("part_rec"), F.col("tree_key").alias("part_tree"), F.lit(False).alias("_surplus"))
        marks = copies.filter("file_id <> record_id").select("file_id", F.col("recording").alias("part_rec"), F.col("tree_key").alias("part_tree"), F.lit(True).alias("_surplus"))
        key = F.when(F.col("file_id").isNotNull(), F.col("file_id")).otherwise(F.xxhash64("path", "payload"))
        laid = (
            rows.unionByName(marks, allowMissingColumns=True)
            .join(place, ["part_rec", "part_tree"])
            .withColumn("part_rec", F.concat(F.lit("="), "part_rec"))
            .withColumn("part_tree", F.concat(F.lit("="), "part_tree"))
            .withColumn("_key", key)
            .withColumn("_slot", F.pmod(F.xxhash64("_key"), F.col("out_files")).cast("int"))
            .drop("out_files")
            .repartition("part_rec", "part_tree", "_slot")
            .withColumn("_nth", F.row_number().over(W.partitionBy("part_rec", "part_tree", "_slot", F.col("file_id").isNull(), "_key").orderBy(F.desc("_surplus"), "path")))
            .filter("_nth = 1 and not _surplus")
            .drop("_slot", "_key", "_nth", "_surplus")
        )
        folder = f"{version:08d}-{log.owner}"
        laid = laid.withColumn("part_ver", F.lit(folder))
        laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part_ver", "part_rec", "part_tree").parquet(f"{lake}/data")
        listing, state = (f"{lake}/_snapshots/v{version:08d}-{log.owner}.{kind}" for kind in ("partitions", "state"))
        plan.write.mode("overwrite").parquet(listing)
        mine = plan.select(F.lit(folder).alias("part_ver"), F.concat(F.lit("="), "recording").alias("part_rec"), F.concat(F.lit("="), "tree_key").alias("part_tree"))
        replaced = False
        if before:
            old = log.manifest(before)
            rewritten = mine.drop("part_ver")
            replaced = old["replaced"] or not spark.read.parquet(old["state"]).join(rewritten, ["part_rec", "part_tree"], "left_semi").isEmpty()
            kept = spark.read.parquet(old["state"]).join(rewritten, ["part_rec", "part_tree"], "left_anti")
            mine = mine.unionByName(kept)
        mine.write.mode("overwrite").parquet(state)
        log.publish(version, base, listing, state=state, schema=_ddl(laid), replaced=replaced, n_partitions=n_parts)
    return Compaction(lake, version, plan, copies)


def copy_pairs(copies: DataFrame) -> DataFrame:
    """All pairs of files of one record, smaller id first. A record with very many copies is split into blocks."""
    blocks = F.ceil(F.col("copies") / PAIR_BLOCK).cast("int")
    copies = copies.dropDuplicates(["file_id"])
    left = copies.select("record_id", F.col("file_id").alias("file_a"), F.pmod(F.xxhash64("file_id"), blocks).alias("_b"))
    right = copies.select("record_id", F.col("file_id").alias("file_b"), F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)).alias("_b"))
    return left.join(right, ["record_id", "_b"]).filter("file_a < file_b").select("file_a", "file_b")
