"""What the operators share: columns, the shared folder, sizes."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tokenizer that the queries take; operators are given a path.
DIGEST_TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = DIGEST_TOKENIZER) -> str:
    """Where the named file of a public tokenizer is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset."""
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    if set_:
        return set_
    folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join("/tmp", "tidestate-shared"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there and lost executors lose nothing."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bytes_of(df: DataFrame) -> int:
    """The optimizer's estimate of df's size, from file sizes; where it knows none, the bytes of its strings, counted."""
    known = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if known < 1 << 56:
        return known
    total = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t == "string"), F.lit(16))
    return int(df.select(total.alias("n")).agg(F.sum("n")).first()[0] or 0)


def pieces(df: DataFrame, each: int, least: int = 1) -> int:
    """How many partitions of about that many bytes of files df makes."""
    return max(least, -(-bytes_of(df) // each))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, mod n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def fold_py(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


#: Rows and bytes that are worked on at a time, where each row makes much.
SMALL_ROWS, SMALL_BYTES = 64, 1 << 20


def small(batch: pa.RecordBatch, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a few rows; fewer where rows are long."""
    each = max(1, min(rows, size * batch.num_rows // max(batch.nbytes, 1)))
    for i in range(0, batch.num_rows, each):
        yield batch.slice(i, each)


def released(run: Callable) -> Callable:
    """run, a function of Arrow batches or of a table; after a task's last batch its worker gives memory that is free back to the system, as workers are used again."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back(collect: bool = True) -> None:
    """Free memory of Python, numpy and Arrow goes back to the system."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
