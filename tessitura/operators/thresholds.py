"""Constrained threshold search, model selection and weight sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def operating_curve(df: DataFrame, positive: Column, score: Column) -> DataFrame:
    """Each distinct score t with the shares of positive and other rows at or above it.

    Rows are counted per score before the cumulative sum, so that sees one row for each distinct score.
    """
    d = df.groupBy(score.alias("t")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"cp": F.sum("p").over(w), "cq": F.sum("q").over(w)})
    whole = Window.partitionBy(F.lit(0))
    return d.select("t", (F.col("cp") / F.sum("p").over(whole)).alias("recall"), (F.col("cq") / F.sum("q").over(whole)).alias("fpr"))


def search(df: DataFrame, positive: Column, score: Column, recall: float = 0.9, fpr: float = 0.05) -> DataFrame:
    """AGG-21: warn = largest t with recall >= target, hold = smallest t with fpr <= target, and whether both exist with warn <= hold."""
    c = operating_curve(df, positive, score)
    g = c.agg(F.max(F.when(F.col("recall") >= recall, F.col("t"))).alias("warn"), F.min(F.when(F.col("fpr") <= fpr, F.col("t"))).alias("hold"))
    return g.withColumn("feasible", F.coalesce(F.col("warn") <= F.col("hold"), F.lit(False)))


def select_model(rows: DataFrame, name: str, low: str, high: str) -> DataFrame:
    """AGG-22: smallest ``low``, then largest ``high``, then the name; candidates without both rates don't count."""
    return rows.filter(F.col(low).isNotNull() & F.col(high).isNotNull()).agg(F.min_by(name, F.struct(F.col(low), -F.col(high), F.col(name))).alias("selected"))


def sweep_weights(df: DataFrame, a: Column, b: Column, hit: Column, key: str, weights: list[float]) -> DataFrame:
    """AGG-23: for each weight the share of keys whose best row by w a + (1 - w) b is a hit; first weight wins ties."""
    w = df.withColumn("w", F.explode(F.array(*map(F.lit, weights))))
    fused = F.round(F.col("w") * a + (1 - F.col("w")) * b, 6)
    best = w.groupBy("w", key).agg(F.max(F.struct(fused.alias("s"), hit.cast("int").alias("hit"))).alias("m"))
    per = best.groupBy("w").agg(F.round(F.avg(F.col("m.hit").cast("double")), 6).alias("top1"))
    return per.agg(F.max_by("w", F.struct("top1", -F.col("w"))).alias("weight"), F.max("top1").alias("top1"))
