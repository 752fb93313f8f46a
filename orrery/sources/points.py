"""Point-cloud files as Spark data sources: "ply" (schema from the header), "splat" (32-byte records).

Register with `register(spark)`; then spark.read.format("ply").load(folder) and df.write.format("ply").save(folder).
A file is split into ranges of records, so one large file is read by many tasks. A task writes its record batches as they
come, into one file named after its partition, so that reading files by name keeps the order that was written. Paths may
be on any file system that pyarrow opens by its address.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from orrery.sources.files import listing, open_file, remove, rename

#: PLY type names.
PLY_TYPES = {"float": "<f4", "double": "<f8", "uchar": "<u1", "int": "<i4", "uint": "<u4", "char": "<i1", "short": "<i2", "ushort": "<u2"}
SQL_TYPES = {"<f4": "float", "<f8": "double", "<u1": "smallint", "<i1": "smallint", "<i2": "smallint", "<u2": "int", "<i4": "int", "<u4": "bigint"}
ARROW_TYPES = {"float": pa.float32(), "double": pa.float64(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}
ROWS_PER_PARTITION = 1_000_000
BATCH = 65_536
#: The splat record.
SPLAT = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("sx", "<f4"), ("sy", "<f4"), ("sz", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1"), ("a", "u1"), ("qw", "u1"), ("qx", "u1"), ("qy", "u1"), ("qz", "u1")])


def files_at(path: str, ending: str) -> list[str]:
    found = [p for p, _ in listing(path, ending)]
    if not found:
        raise FileNotFoundError(f"no {ending} files at {path}")
    return found


def ply_header(path: str) -> tuple[list[tuple[str, str]], int, int]:
    """Fields (name, dtype), number of vertices, and where the records begin; only binary little-endian vertex data."""
    fields: list[tuple[str, str]] = []
    count, inside = 0, False
    with open_file(path) as f:
        head = f.read(1 << 16)  # no header is longer
        lines = head.split(b"\n")
        if lines[0].strip() != b"ply":
            raise ValueError(f"{path} is no PLY file")
        for line in lines[1:]:
            if line.strip() == b"end_header":
                break
            words = line.decode("ascii", "replace").split()
            if words[:1] == ["format"] and words[1] != "binary_little_endian":
                raise ValueError(f"{path}: format {words[1]}")
            if words[:1] == ["element"]:
                inside = words[1] == "vertex"
                count = int(words[2]) if inside else count
            elif words[:1] == ["property"] and inside:
                fields.append((words[2], PLY_TYPES[words[1]]))
        return fields, count, head.index(b"end_header") + len(b"end_header\n")


def _batches(path: str, start: int, dtype: np.dtype, first: int, n: int, names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    with open_file(path) as f:
        f.seek(start + first * dtype.itemsize)
        while n > 0:
            body = f.read(min(n, BATCH) * dtype.itemsize)
            rows = np.frombuffer(body[: len(body) // dtype.itemsize * dtype.itemsize], dtype)
            if not len(rows):
                return  # a file cut short ends where its data ends
            n -= len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(rows[c].copy()).cast(t) for c, t in zip(names, types)], names=names)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, fields: list, first: int, n: int):
        self.path, self.start, self.fields, self.first, self.n = path, start, fields, first, n


class _Reader(DataSourceReader):
    def __init__(self, ranges: list[_Range], names: list[str], types: list[str]):
        self.ranges, self.names, self.types = ranges, names, types

    def partitions(self):
        return self.ranges

    def read(self, part):
        yield from _batches(part.path, part.start, np.dtype(part.fields), part.first, part.n, self.names, [ARROW_TYPES[t] for t in self.types])


def _split(path: str, start: int, fields: list, count: int) -> list[_Range]:
    return [_Range(path, start, fields, i, min(ROWS_PER_PARTITION, count - i)) for i in range(0, count, ROWS_PER_PARTITION)] or [_Range(path, start, fields, 0, 0)]


class _Written(WriterCommitMessage):
    def __init__(self, part: str | None, final: str | None):
        self.part, self.final = part, final


class _Writer(DataSourceArrowWriter):
    """Tasks write hidden files; the commit renames them, an abort removes them."""

    ending = ""

    def __init__(self, path: str, schema, overwrite: bool):
        self.path, self.schema, self.overwrite = path.rstrip("/"), schema, overwrite
        self.run = uuid.uuid4().hex
        self.kept = [p for p, _ in listing(path, self.ending, missing_ok=True)] if overwrite else []

    def dtype(self) -> np.dtype:
        raise NotImplementedError

    def head(self, n: int) -> bytes:
        return b""

    def write(self, batches):
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{self.run}{self.ending}"
        part, body = f"{self.path}/.{name}.{task.taskAttemptId()}.tmp", f"{self.path}/.{name}.{task.taskAttemptId()}.body"
        dtype, n = self.dtype(), 0
        with open_file(body, "w") as f:  # the header needs the count, so the records go ahead of it
            for b in batches:
                rows = np.zeros(b.num_rows, dtype)
                for c in dtype.names:
                    rows[c] = b.column(c).fill_null(0).to_numpy(zero_copy_only=False)
                f.write(rows.tobytes())
                n += len(rows)
        with open_file(part, "w") as out, open_file(body) as f:
            out.write(self.head(n))
            while chunk := f.read(1 << 22):
                out.write(chunk)
        remove(body)
        return _Written(part, f"{self.path}/{name}")

    def commit(self, messages):
        for m in messages:
            if m:
                rename(m.part, m.final)
        for old in self.kept:
            remove(old)

    def abort(self, messages):
        for m in messages:
            if m:
                remove(m.part)


def ply_head(fields: list[tuple[str, str]], n: int) -> bytes:
    names = {v: k for k, v in reversed(PLY_TYPES.items())}
    lines = ["ply", "format binary_little_endian 1.0", f"element vertex {n}", *(f"property {names[t]} {c}" for c, t in fields), "end_header"]
    return ("\n".join(lines) + "\n").encode()


def ply_bytes(fields: list[tuple[str, str]], rows: np.ndarray) -> bytes:
    return ply_head(fields, len(rows)) + rows.tobytes()


class _PlyWriter(_Writer):
    ending = ".ply"

    def fields(self):
        code = {"float": "<f4", "double": "<f8", "smallint": "<u1", "short": "<u1", "tinyint": "<i1", "byte": "<i1", "int": "<i4", "integer": "<i4", "bigint": "<u4", "long": "<u4"}
        return [(f.name, code[f.dataType.typeName()]) for f in self.schema.fields]

    def dtype(self):
        return np.dtype(self.fields())

    def head(self, n):
        return ply_head(self.fields(), n)


class PlySource(DataSource):
    """Vertices of PLY files. All files of a folder must have the header's fields of the first one. Null is written as 0."""

    @classmethod
    def name(cls):
        return "ply"

    def _path(self) -> str:
        return self.options["path"]

    def schema(self):
        fields, _, _ = ply_header(files_at(self._path(), ".ply")[0])
        return ", ".join(f"`{n}` {SQL_TYPES[t]}" for n, t in fields)

    def reader(self, schema):
        ranges, first = [], None
        for p in files_at(self._path(), ".ply"):
            fields, count, start = ply_header(p)
            first = first or fields
            if fields != first:
                raise ValueError(f"{p} has other fields than the first file")
            ranges += _split(p, start, fields, count)
        return _Reader(ranges, [n for n, _ in first], [SQL_TYPES[t] for _, t in first])

    def writer(self, schema, overwrite):
        return _PlyWriter(self._path(), schema, overwrite)


class _SplatWriter(_Writer):
    ending = ".splat"

    def dtype(self):
        return SPLAT


class SplatSource(DataSource):
    """32-byte splat records: place, scale, colour with opacity, rotation as bytes."""

    @classmethod
    def name(cls):
        return "splat"

    def schema(self):
        return ", ".join(f"{n} {SQL_TYPES[SPLAT[n].newbyteorder('<').str.replace('|', '<')]}" for n in SPLAT.names)

    def reader(self, schema):
        ranges = []
        for p, size in listing(self.options["path"], ".splat"):
            ranges += _split(p, 0, SPLAT.descr, size // SPLAT.itemsize)
        return _Reader(ranges, list(SPLAT.names), [SQL_TYPES[SPLAT[n].str.replace("|", "<")] for n in SPLAT.names])

    def writer(self, schema, overwrite):
        return _SplatWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    for source in (PlySource, SplatSource):
        spark.dataSource.register(source)
