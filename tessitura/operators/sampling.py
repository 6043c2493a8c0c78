"""Deterministic splits and samples: by hash order, by seeded shuffle of groups, by stratum."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import settle

#: Groups of a seeded shuffle are put in order on the driver; there may be at most so many.
MAX_GROUPS = 1_000_000


def hash48(text: Column) -> Column:
    """First 48 bits of the SHA-256 as an integer."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df with _pos from 1 in a global order: a range sort, then offsets of its partitions, so no task sees all rows.

    The sorted rows are written to the shared scratch folder, numbered as they are written.
    """
    s = settle(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    counts = s.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))  # one row for each partition of the sort
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = s.withColumn("_p", part).join(F.broadcast(before.select("_p", "_before")), "_p")
    return out.withColumn("_pos", F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_p", "_before", "_id")


def hash_split(df: DataFrame, text: Column, shares: dict[str, float], tie: str) -> DataFrame:
    """WIN-07: rows in order of the hash are cut at the cumulative shares of their number (rounded down)."""
    n = df.count()
    pos, total, out = F.col("_pos"), 0.0, None
    names = list(shares)
    for name in names[:-1]:
        total = round(total + shares[name], 9)
        out = (F.when if out is None else out.when)(pos <= int(n * total), name)
    return numbered(df.withColumn("_h", hash48(text)), F.asc("_h"), F.asc(tie)).withColumn("split", out.otherwise(names[-1])).drop("_h", "_pos")


def stratified(df: DataFrame, stratum: str, text: Column, sizes: dict[str, int], default: int, tie: str) -> DataFrame:
    """WIN-08: first n of each stratum in hash order."""
    n = F.lit(default)
    for k, v in sizes.items():
        n = F.when(F.col(stratum) == k, v).otherwise(n)
    w = Window.partitionBy(stratum).orderBy(F.sha2(text, 256), tie)
    most = max([default, *sizes.values()])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most).filter(F.col("_rn") <= n).drop("_rn")


def first_by_hash(df: DataFrame, text: Column, n: int, tie: str) -> DataFrame:
    """First n rows in order of the text's SHA-256."""
    return df.orderBy(F.sha2(text, 256), tie).limit(n)


def cut(groups: list, seed: int, shares: dict[str, float]) -> dict:
    """Sorted groups, shuffled with the seed, cut at the shares; the first part keeps one group back and has one at least."""
    order = sorted(groups)
    random.Random(seed).shuffle(order)
    names, out, at = list(shares), {}, 0
    for i, name in enumerate(names):
        end = len(order) if i == len(names) - 1 else min(len(order) - 1, max(at + 1, round(len(order) * sum(list(shares.values())[: i + 1]))))
        out |= {g: name for g in order[at:end]}
        at = end
    return out


def group_shuffle_split(df: DataFrame, group: str, seed: int, shares: dict[str, float]) -> DataFrame:
    """WIN-09: whole groups are dealt to splits, so no group spans two. Only distinct groups reach the driver."""
    groups = [r[0] for r in df.select(group).filter(F.col(group).isNotNull()).distinct().limit(MAX_GROUPS + 1).collect()]
    if len(groups) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups; use hash_split on the group")
    deal = df.sparkSession.createDataFrame(list(cut(groups, seed, shares).items()), df.select(group).schema.add("split", "string"))
    return df.join(F.broadcast(deal) if len(groups) <= 100_000 else deal, group, "left")


def ordered_slice(df: DataFrame, key: str, start: int, end: int) -> DataFrame:
    """SRT-02: rows start to end (end excluded) in order of key; only the first ``end`` rows meet."""
    return df.orderBy(key).limit(end).orderBy(key).offset(start)


def seeded_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """SRT-03: n keys without replacement from the sorted distinct keys.

    Positions are drawn from their number and only the keys there are fetched, so the driver holds n keys at most.
    """
    s = numbered(df.select(key).distinct(), F.asc(key))
    total = s.count()
    drawn = random.Random(seed).sample(range(1, total + 1), min(n, total))
    at = df.sparkSession.createDataFrame([(p,) for p in drawn], "_pos long")
    got = {r["_pos"]: r[key] for r in s.join(at, "_pos").select("_pos", key).collect()}
    return df.sparkSession.createDataFrame([(got[p],) for p in drawn], df.select(key).schema)
