"""Readers: file listings, CSV, JSON, JSONL, catalogs, job tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


def audio_files(spark: SparkSession, path: str, suffixes: list[str], recursive: bool = True) -> DataFrame:
    """SRC-01/02: path, length and modification time of files by suffix; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    ok = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1)).isin([s.lower() for s in suffixes])
    return files.select("path", "length", "modificationTime").filter(ok)


def csv_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """SRC-03: header CSV, BOM allowed, quoted JSON cells kept whole; a missing path is an empty table."""
    try:
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def jsonl_table(spark: SparkSession, paths: str | list[str], schema: T.StructType | str) -> DataFrame:
    """SRC-04"""
    return spark.read.schema(schema).json(paths)


def json_registry(spark: SparkSession, path: str, value: str, key: str = "track_id") -> DataFrame:
    """SRC-05: a JSON object keyed by id as one row per id; ``value`` is the struct's type."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value}>").alias("m"))
    return doc.select(F.explode("m").alias(key, "_v")).select(key, "_v.*")


def catalog(spark: SparkSession, path: str, expected: DataFrame | None = None, key: str = "track_id", kind: str = "parquet") -> DataFrame:
    """SRC-06: the catalog of (track_id, offset_s, v), Parquet or (registered) npz archives; stale if its ids aren't the
    expected ones."""
    df = spark.read.format(kind).load(path)
    if expected is not None:
        from ..operators.matching import same_ids

        if not same_ids(df.select(key).distinct(), expected.select(key).distinct(), key).first()["equal"]:
            raise ValueError(f"catalog {path} doesn't hold the expected ids")
    return df


def fingerprints(rows: DataFrame, raw: str = "fingerprint_raw", seconds: str = "duration") -> DataFrame:
    """SRC-10: rows with a usable fingerprint (array of uint32 in longs) and a reason for the others."""
    why = (F.when(F.col(raw).isNull() | (F.size(raw) == 0), "EMPTY_FINGERPRINT").when(F.col(seconds) < 10, "TOO_SHORT").when(F.col(seconds) > 1800, "TOO_LONG")
           .when(F.exists(raw, lambda x: x.isNull() | (x < 0) | (x > 0xFFFFFFFF)), "NOT_UINT32"))
    return rows.withColumn("reject", why)


def latest_jobs(events: DataFrame, key: str = "job_id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """SRC-12: the jobs table as the latest event of each id in an append-only log; folded by max_by, no window."""
    cols = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_l")).select(key, "_l.*")
