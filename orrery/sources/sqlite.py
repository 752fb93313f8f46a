"""Tables in SQLite files below a shared folder: each task writes one file, each file is read by one task."""

from __future__ import annotations

import os
import sqlite3
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(rows: DataFrame, folder: str, name: str) -> None:
    """rows as table `name` in files of `folder`; columns are numbers, texts or bytes.

    A file is made in the task's own scratch space, as SQLite needs a local file, and travels as one binary row.
    """
    cols = rows.columns

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with tempfile.TemporaryDirectory() as scratch:
            path = os.path.join(scratch, "part.db")
            db = sqlite3.connect(path)
            marks = ", ".join(f'"{c}"' for c in cols)
            db.execute(f'CREATE TABLE "{name}" ({marks})')
            for b in batches:
                plain = b.astype(object).where(b.notna(), None)
                db.executemany(f'INSERT INTO "{name}" VALUES ({", ".join("?" * len(cols))})', plain.itertuples(index=False, name=None))
            db.commit()
            db.close()
            with open(path, "rb") as f:
                yield pd.DataFrame({"file": [uuid.uuid4().hex], "content": [f.read()]})

    rows.mapInPandas(make, "file string, content binary").write.mode("overwrite").parquet(folder)


def read(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """Table `name` of all files written by `write`, with the columns of schema."""
    cols = [c.split()[0] for c in schema.split(", ")]

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(content))
                yield pd.DataFrame(db.execute("SELECT " + ", ".join(f'"{c}"' for c in cols) + f' FROM "{name}"').fetchall(), columns=cols, dtype=object)
                db.close()

    return spark.read.parquet(folder).select(F.col("content")).mapInPandas(load, schema)
