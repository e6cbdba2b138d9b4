"""Scratch space that the driver and every executor share, and binary files in it.

``spark.checkpoint.dir`` names the shared folder. It is read from the session; only where it is unset and all runs on one
machine (tests, a laptop) does the driver pick a temporary folder of its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path under the cluster's shared folder."""
    base = spark.conf.get(_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_KEY} must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set(_KEY, base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again, so that a lost executor costs no recomputation of its past.

    files: how many files a table of known, small size takes at most."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path inside it."""
    if not urlparse(path).scheme:
        path = "file://" + os.path.abspath(path)
    elif path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


class AtomicFile:
    """A file under construction; it appears under its name only when whole, so a task that runs twice does no harm."""

    def __init__(self, path: str):
        self.fs, self.path = open_fs(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temp)

    def write(self, data) -> None:
        self.out.write(data)

    def tell(self) -> int:
        return self.out.tell()

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.path)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit integers as byte planes of their differences; the zero planes vanish in any compression."""
    values = np.ascontiguousarray(values).view(np.uint64)
    delta = np.diff(values, prepend=np.uint64(0))
    return delta.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_ints(values: np.ndarray) -> bytes:
    """64-bit integers in any order as byte planes."""
    return np.ascontiguousarray(values).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_ints(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()
