"""Shared plumbing: table reading, word splitting, Arrow batches, a broadcast gate and joins with hot keys."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_path, settle

__all__ = ["BROADCAST_ROWS", "SPACE", "WORD", "fresh", "lean", "row_key", "scratch_path", "settle", "skew_join", "small", "table", "tidy"]

#: Words are maximal runs of anything but the space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: A table that is broadcast has been counted first and has at most this many rows.
BROADCAST_ROWS = 100_000

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Arrow batches between the JVM and Python: rows and bytes at most.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def lean(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS and BATCH_BYTES where they are larger: whole texts travel in them,
    and both sides hold a batch for each running task."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def tidy(run):
    """A batch function that gives free memory back to the system when its task ends: workers are reused by later stages."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows at most ``rows`` rows, else df as it is (a shuffle join)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", most: int = 1000, least: int = 1000) -> DataFrame:
    """left joined with right, which has one row for each key. Keys that hold more than ``least`` rows of left, and more
    than its ``most``-th part, meet right's rows by broadcast (``most`` rows at the utmost), so no task gathers such a
    key; rows without a key don't move at all. left is read up to four times: settle it first."""
    whole = [*left.columns, *[c for c in right.columns if c != key]]
    out = []
    if how == "left":
        none = left.filter(F.col(key).isNull())
        out.append(none.select("*", *[F.lit(None).cast(t).alias(c) for c, t in right.dtypes if c != key]))
    left = left.filter(F.col(key).isNotNull())
    heavy = max(least, left.count() // most)
    hot = settle(left.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > heavy).select(key), "hot")
    if hot.isEmpty():
        out.append(left.join(right, key, how))
    else:
        hot = F.broadcast(hot)
        out.append(left.join(hot, key, "left_anti").join(right, key, how))
        out.append(left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, how))
    met = out[0].select(*whole)
    for more in out[1:]:
        met = met.unionByName(more.select(*whole))
    return met


def fresh(name: str, taken: list[str]) -> str:
    """name, with underscores added until no column (names compare without case) has it."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def row_key(df: DataFrame, name: str) -> DataFrame:
    """Number the rows by file split and position: stable when a lost task reads its split again."""
    return df.withColumn(name, F.monotonically_increasing_id())
