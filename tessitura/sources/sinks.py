"""Sinks: CSV and JSON reports, keyed caches, resumable appends, atomic replacement, model tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _nested(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.to_json(c) for c, t in df.dtypes if t.startswith(("array", "struct", "map"))})


def csv_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-01: header CSV in as many files as there are tasks; nested columns become JSON cells. ``report`` writes one file
    with a byte order mark."""
    _nested(df).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def json_summary(df: DataFrame, path: str) -> None:
    """SNK-02: a summary of one row as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def cache_key(*parts: Column) -> Column:
    """SNK-03: hash of path, size, time and flags with a separator that no part holds."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)


def cached(keys: DataFrame, path: str, compute, key: str = "cache_key") -> DataFrame:
    """SNK-03: cached rows plus those computed for missing keys, which are appended; a repeated key is computed once, from
    its smallest row."""
    spark = keys.sparkSession
    try:
        held = spark.read.parquet(path)
        missing = keys.join(held.select(key), key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        missing = keys
    compute(_one_each(missing, key)).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(keys.select(key).distinct(), key, "left_semi")


def _one_each(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key by the columns in order (by all, where none is named): folded by min(), not a window."""
    rest = [c for c in rows.columns if c != key]
    ranked = [*order, *[c for c in rest if c not in order]]
    return rows.groupBy(key).agg(F.min(F.struct(*ranked)).alias("_r")).select(*[F.col(key) if c == key else F.col("_r")[c].alias(c) for c in rows.columns]) if rest else rows.distinct()


def append_new(rows: DataFrame, path: str, key: str, order: str, process=lambda df: df) -> None:
    """SNK-04: process and append the rows whose key isn't there yet, of each key the first by ``order``; running it again
    adds nothing."""
    spark = rows.sparkSession
    try:
        rows = rows.join(spark.read.json(path).select(key).distinct(), key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    process(_one_each(rows, key, order)).write.mode("append").json(path)


def _files(spark: SparkSession, path: str):
    """The path's file system and a maker of paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, make = _files(spark, path)
    found = fs.listStatus(make(path)) if fs.exists(make(path)) else []
    return sorted(int(n.removeprefix("ready-")) for n in (str(f.getPath().getName()) for f in found) if n.startswith("ready-"))


def replace_table(df: DataFrame, path: str, keep: int = 2) -> int:
    """SNK-05: write a new version beside the others, then make its marker file; ``current`` reads the newest marked version.

    Making one empty file is atomic in every store, so a reader finds the old table or the new one, never neither, and a
    write that fails leaves no marker. The last ``keep`` versions stay for readers that have begun. Returns the version.
    """
    spark = df.sparkSession
    fs, make = _files(spark, path)
    done = _versions(spark, path)
    new = done[-1] + 1 if done else 1
    df.write.mode("overwrite").parquet(f"{path}/v={new}")
    if not fs.createNewFile(make(f"{path}/ready-{new}")):
        raise OSError(f"version {new} of {path} was made by another writer")
    for old in done[: max(0, len(done) + 1 - keep)]:
        fs.delete(make(f"{path}/ready-{old}"), False)
        fs.delete(make(f"{path}/v={old}"), True)
    return new


def current(spark: SparkSession, path: str) -> str:
    """Path of the newest whole version of a table written by ``replace_table``."""
    done = _versions(spark, path)
    if not done:
        raise FileNotFoundError(path)
    return f"{path}/v={done[-1]}"


def save_model(spark: SparkSession, model: dict, path: str) -> None:
    """SNK-08: coefficients as a one-row JSON table."""
    spark.createDataFrame([(json.dumps(model),)], "model string").coalesce(1).write.mode("overwrite").json(path)


def load_model(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.schema("model string").json(path).first()["model"])
