"""The shared scratch folder: tables that cut lineage, written where driver and executors both see them.

The folder is the one that ``spark.checkpoint.dir`` names, so a lost executor costs a reread and not a recomputation.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a folder of our own only where the setting is unset and the master is local
    (tests). On a cluster without the setting each executor would write to its own disk, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
        base = f"file://{tempfile.mkdtemp(prefix='tessitura-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{scratch_dir(spark)}/tessitura-{uuid.uuid4().hex}/{tag}"
    _made.append((spark, path.rsplit("/", 1)[0]))
    return path


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: evaluated once, lineage cut."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep() -> None:
    """Delete every scratch folder this process made; runs at exit, and may be called between jobs."""
    while _made:
        spark, path = _made.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session has ended
            return


atexit.register(sweep)
