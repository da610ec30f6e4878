"""What the operators of this folder share: places for intermediate tables and access to text bytes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


_caches: dict[str, dict] = {}


def own_cache(name: str) -> dict:
    """The cache of an operator in this process. Workers are used again: those of other operators are emptied, and what
    they held goes back to the machine."""
    others = [held for other, held in _caches.items() if other != name and held]
    for held in others:
        held.clear()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)
    return _caches.setdefault(name, {})


#: Rows of texts that go to a Python worker at a time; Spark's own default is five times as many.
BATCH_ROWS = 2000


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of the session have BATCH_ROWS rows at most, so that a worker holds a few MB of text at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below spark.checkpoint.dir; in local runs without one below the temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/tracklore"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Folders written within each open scratch(), the innermost last.
_open: list[list[str]] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if _open:
        _open[-1].append(path)
    return out


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that cut() writes inside are deleted at the end, but for those given to the function that this yields."""
    held: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._cut_path)
        return df

    _open.append(held)
    try:
        yield keep
    finally:
        _open.remove(held)
        for path in held:
            if path not in kept:
                drop_dir(spark, path)
        if _open:  # what is kept here may go where the caller ends
            _open[-1].extend(kept)


#: A key of more than this share of the rows, and of more than so many, is dealt out; so hot keys are bounded in number.
HOT_SHARE, HOT_ROWS = 4096, 1000


def join_salted(many: DataFrame, one: DataFrame, keys: list[str], counts: DataFrame, spread: Column, how: str = "inner") -> DataFrame:
    """many joined to one (keys: unique there), where a few keys may hold most rows of many. counts: keys and n, the rows
    of many. Rows of hot keys are dealt out by spread, and one's rows of these keys are repeated for each share; there are
    at most HOT_SHARE hot keys, which are broadcast."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(HOT_ROWS, total // HOT_SHARE)
    hot = F.broadcast(counts.where(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("__shares")))
    left = many.join(hot, keys, "left").withColumn("__salt", F.coalesce(F.pmod(spread, F.col("__shares")), F.lit(0))).drop("__shares")
    right = one.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__shares", F.lit(1)) - 1))).drop("__shares")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def drop_dir(spark: SparkSession, uri: str) -> None:
    """Deletes a folder of intermediate files through Spark's file system layer."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def local_fs(uri: str):
    """(pyarrow file system, path) for a shared folder's URI; file:, hdfs: and object stores that pyarrow knows."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def doc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id written as text, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def input_partitions(df: DataFrame, at_least: int = 1) -> int:
    """Shuffle partitions of the session, for operators that deal rows out themselves."""
    return max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
