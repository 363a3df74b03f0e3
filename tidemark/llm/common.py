"""What several operators share: word splitting, hashing, bounded slices of Arrow batches, staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; bytes.split() cuts at exactly these six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see, spark.checkpoint.dir. Only a local session may have none and gets one (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def staging_folder(spark: SparkSession) -> str:
    """Where this application's staged tables are."""
    return f"{shared_folder(spark)}/tidemark-{spark.sparkContext.applicationId}"


def clear_staged(spark: SparkSession) -> None:
    """Remove all tables that this application has staged. Results not yet read or written would lose their inputs."""
    path = spark._jvm.org.apache.hadoop.fs.Path(staging_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lost executors recompute nothing before it."""
    path = f"{staging_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of text each (a longer text is a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // limit
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(first, np.r_[first[1:], batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered for up to `limit` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (two xor-multiply rounds) over an array."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of every run of n consecutive values, built by doubling: runs of 1, 2, 4, ... then one overlap."""
    k = 1
    with np.errstate(over="ignore"):
        while k < n and len(h) >= n - k + 1:
            step = min(k, n - k)
            h = mixed(h[: len(h) - step] * np.uint64(0x9E3779B97F4A7C15) + (h[step:] ^ np.uint64(k)), step)
            k += step
    return h if k == n else h[:0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(column: str, n: int):
    """crc32 of the number as text, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))
