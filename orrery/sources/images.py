"""Raw frames and depth pictures: listing, slices of archives, 12-bit unpacking, 16-bit PNG."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.names import camera, capture_time
from orrery.operators.raster import unpack12
from orrery.sources.files import listing, open_file

#: Size of a raw frame.
WIDTH, HEIGHT, STRIDE = 2448, 2048, 3680


def raw_frames(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, name, cam, ts, length, content of the raw frames of a folder; `<folder>/raw` if it is there and holds any."""
    inner = f"{folder.rstrip('/')}/raw"
    place = inner if any(listing(inner, ending, missing_ok=True) for ending in (".raw", ".raw12")) else folder
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.{raw,raw12}").option("recursiveFileLookup", str(recursive).lower()).load(place)
    name = F.element_at(F.split("path", "/"), -1)
    return df.select("path", name.alias("name"), camera(name).alias("cam"), capture_time(name).alias("ts"), "length", "content")


def accepted(frames: DataFrame, size: int = HEIGHT * STRIDE) -> DataFrame:
    """Frames of the right size whose name holds a time; decided before the content is read."""
    return frames.filter((F.col("length") == size) & F.col("ts").isNotNull())


def slices(index: DataFrame) -> DataFrame:
    """name, content: byte ranges (name, tar, offset, size) read out of archives; a range beyond the end gives null.

    Sorted by archive and offset within a partition, each archive is opened once.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for tar, rows in b.groupby("tar", sort=False):
                with open_file(tar) as f:
                    end = f.size()
                    for name, offset, size in rows[["name", "offset", "size"]].itertuples(index=False):
                        f.seek(min(int(offset), end))
                        data = f.read(int(size))
                        out.append((name, data if len(data) == size else None))
            yield pd.DataFrame(out, columns=["name", "content"])

    return index.select("name", "tar", "offset", "size").repartition("tar").sortWithinPartitions("tar", "offset").mapInPandas(read, "name string, content binary")


def unpacked(frames: DataFrame, width: int = WIDTH, height: int = HEIGHT, stride: int = STRIDE) -> DataFrame:
    """name, pixels (array of height x width values, by rows); frames of another size give null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            px = [unpack12(c, width, height, stride).ravel() if c is not None and len(c) == height * stride else None for c in b["content"]]
            yield pd.DataFrame({"name": b["name"].to_numpy(object), "pixels": px})

    return frames.select("name", "content").mapInPandas(run, "name string, pixels array<int>")


def write_png16(image: np.ndarray) -> bytes:
    """A grey 16-bit PNG."""
    h, w = image.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.zeros((h, 1 + 2 * w), np.uint8)
    rows[:, 1:] = image.astype(">u2").view(np.uint8).reshape(h, -1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def read_png16(data: bytes) -> np.ndarray:
    """Pixels of a grey PNG of 8 or 16 bits, not interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, body, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    w, h, depth, colour, _, _, interlaced = head
    if colour != 0 or depth not in (8, 16) or interlaced:
        raise ValueError("only grey PNG of 8 or 16 bits")
    bpp = depth // 8
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * bpp)
    out = np.zeros((h + 1, (w + 1) * bpp), np.int32)  # a row above and a pixel to the left, all zero
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        above = out[y]
        if kind in (0, 2):
            out[y + 1, bpp:] = (line + (above[bpp:] if kind == 2 else 0)) % 256
        elif kind == 1:
            out[y + 1, bpp:] = np.cumsum(line.reshape(w, bpp), axis=0).ravel() % 256
        else:
            row = out[y + 1]
            for x in range(bpp, len(row)):
                a, b, c = row[x - bpp], above[x], above[x - bpp]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                row[x] = (line[x - bpp] + guess) % 256
    px = out[1:, bpp:].reshape(h, w, bpp)
    return px[..., 0] * 256 + px[..., 1] if bpp == 2 else px[..., 0]


def depth_pixels(pictures: DataFrame, scale: float = 1000.0) -> DataFrame:
    """frame, u, v, z: valid pixels (not 0) of depth pictures (frame, content); unreadable pictures give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["frame"], b["content"]):
                try:
                    d = read_png16(bytes(content))
                except (ValueError, TypeError, zlib.error, struct.error):
                    continue
                v, u = np.nonzero(d)
                yield pd.DataFrame({"frame": np.full(len(u), name, object), "u": u.astype(np.int32), "v": v.astype(np.int32), "z": d[v, u] / scale})

    return pictures.select("frame", "content").mapInPandas(run, "frame string, u int, v int, z double")


def mounts(sessions: DataFrame) -> DataFrame:
    """cam, quarter_turns: how each camera is mounted, from its first session (by name) that states a rotation.

    sessions: cam, name, rotation_deg. 0 and 180 degrees are 0 and 2 quarter turns, no statement is 3; any other angle is
    an error when the result is read.
    """
    first = sessions.groupBy("cam").agg(F.min_by("rotation_deg", F.when(F.col("rotation_deg").isNotNull(), F.col("name"))).alias("deg"))
    turns = F.when(F.col("deg").isNull(), 3).when(F.col("deg") == 0, 0).when(F.col("deg") == 180, 2).otherwise(F.raise_error(F.concat(F.lit("unknown mount of camera "), "cam")).cast("int"))
    return first.select("cam", turns.alias("quarter_turns"))
