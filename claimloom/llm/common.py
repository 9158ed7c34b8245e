"""Helpers that the operators of this subpackage share: shared storage, skew-safe joins, words."""

from __future__ import annotations

import re
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators.graph import shared_folder

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)

#: Rows in one Arrow batch handed to Python, so that a batch of long texts stays small.
BATCH_ROWS = 500
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches at ``BATCH_ROWS`` rows, unless the session already has fewer, and in bytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; it doesn't exist yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a URI or an absolute path, and the path within it."""
    return pafs.FileSystem.from_uri(uri)


def publish(uri: str, data_writer) -> int:
    """Write a file under a temporary name and move it into place, so that a task that dies or
    runs twice leaves no partial file.  ``data_writer`` gets the open stream; returns the size."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as out:
        data_writer(out)
        size = out.tell()
    fs.move(part, path)
    return size


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join many rows a key (``left``) with one row a key (``right``), hot keys included.

    The second join key makes Spark deal out both sides for this join alone, also where ``right``
    is already grouped by ``key``; adaptive execution can then split a hot key's rows over tasks.
    ``right`` may have no column of ``left`` but the key.
    """
    r = right.withColumnRenamed(key, "_r_key")
    cond = (left[key].eqNullSafe(r["_r_key"]) if how == "null_safe" else left[key] == r["_r_key"]) & (
        F.xxhash64(left[key]) == F.xxhash64(r["_r_key"])
    )
    return left.join(r, cond, "left" if how == "null_safe" else how).drop("_r_key")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
