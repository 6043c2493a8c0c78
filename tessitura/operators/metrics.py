"""Evaluation metrics as grouped aggregates; denominators of zero give null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import numbered

Z = 1.959963984540054


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    return F.round(F.when(b != 0, a / b), digits)


def share(cond: Column, digits: int = 6) -> Column:
    """Share of the rows where cond is known and true."""
    return F.round(F.avg(cond.cast("double")), digits)


def confusion(df: DataFrame, truth: Column, score: Column, threshold: float | Column, *keys: str) -> DataFrame:
    """AGG-08: counts and rates at score >= threshold."""
    hit = score >= threshold
    d = df.groupBy(*keys).agg(F.count_if(truth & hit).alias("tp"), F.count_if(truth & ~hit).alias("fn"), F.count_if(~truth & hit).alias("fp"), F.count_if(~truth & ~hit).alias("tn"))
    return rates(d)


def rates(d: DataFrame) -> DataFrame:
    """precision, recall, specificity, fpr and f1 from tp, fn, fp, tn."""
    tp, fn, fp, tn = map(F.col, ("tp", "fn", "fp", "tn"))
    return d.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "fpr": ratio(fp, fp + tn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def auc(df: DataFrame, positive: Column, score: Column, *keys: str) -> DataFrame:
    """AGG-12 / JN-15: rank-sum AUC with half credit for ties; null if a side is empty. No pairs are formed."""
    d = df.filter(positive.isNotNull() & score.isNotNull()).groupBy(*keys, score.alias("_s")).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_s") if keys else Window.partitionBy(F.lit(0)).orderBy("_s")
    below = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("_won", F.col("_p") * (below + F.col("_n") / 2))
    g = d.groupBy(*keys).agg(F.sum("_won").alias("_won"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    return g.select(*keys, ratio(F.col("_won"), (F.col("_p") * F.col("_n")).cast("double")).alias("auc"))


def quantiles(df: DataFrame, value: Column, shares: list[float], *keys: str) -> DataFrame:
    """(keys, q): exact quantiles of the non-null values of each group, with linear interpolation, in the order of
    ``shares``. A range sort numbers the values and only the ranks wanted are fetched, so memory doesn't follow the number
    of distinct values or the size of a group; a group without values has no row."""
    rows = numbered(df.select(*keys, value.cast("double").alias("_v")).filter("_v IS NOT NULL"), *[F.asc(k) for k in keys], F.asc("_v"))
    sizes = rows.groupBy(*keys).agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    rank = lambda p: F.lit(p) * (F.col("_n") - 1)
    low = lambda p: F.floor(rank(p))
    ends = lambda i, p: [F.struct(F.lit(i).alias("i"), (F.col("_first") + low(p)).alias("_pos"), (1 - (rank(p) - low(p))).alias("w")), F.struct(F.lit(i).alias("i"), (F.col("_first") + low(p) + 1).alias("_pos"), (rank(p) - low(p)).alias("w"))]
    wanted = sizes.select(F.explode(F.filter(F.array(*[e for i, p in enumerate(shares) for e in ends(i, p)]), lambda e: e["w"] > 0)).alias("e")).select("e.*")
    got = rows.join(wanted, "_pos").groupBy(*keys, "i").agg(F.sum(F.col("_v") * F.col("w")).alias("x"))
    return got.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("q"))


def _with_quantiles(groups: DataFrame, q: DataFrame, names: list[str], *keys: str) -> DataFrame:
    """groups with each group's quantiles as columns, null where it has no values."""
    right = q.select(*[F.col(k).alias(f"_{k}") for k in keys], "q")
    same = F.lit(True)
    for k in keys:
        same &= groups[k].eqNullSafe(right[f"_{k}"])
    return groups.join(right, same, "left").select(*groups.columns, *[F.round(F.get("q", F.lit(i)), 6).alias(n) for i, n in enumerate(names)])


def distribution(df: DataFrame, value: Column, *keys: str) -> DataFrame:
    """AGG-11: count, mean, sample deviation (0 for one value), median, p10, p90 with linear interpolation."""
    sd = F.when(F.count(value) == 1, 0.0).otherwise(F.stddev_samp(value))
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(sd, 4).alias("std"))
    return _with_quantiles(g, quantiles(df, value, [0.5, 0.1, 0.9], *keys), ["median", "p10", "p90"], *keys)


def cohens_d(df: DataFrame, positive: Column, value: Column, *keys: str) -> DataFrame:
    """AGG-13: pooled effect size; null if a side has under two values or no variance."""
    side = lambda f, c: f(F.when(c, value))
    g = df.groupBy(*keys).agg(side(F.count, positive).alias("n1"), side(F.count, ~positive).alias("n0"), side(F.avg, positive).alias("m1"), side(F.avg, ~positive).alias("m0"),
                              side(F.var_samp, positive).alias("v1"), side(F.var_samp, ~positive).alias("v0"))
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2)
    return g.select(*keys, F.round(F.when((F.col("n1") > 1) & (F.col("n0") > 1) & (pooled > 0), (F.col("m1") - F.col("m0")) / F.sqrt(pooled)), 4).alias("cohens_d"))


def wilson(k: Column, n: Column, digits: int = 6) -> tuple[Column, Column]:
    """AGG-14: 95 % Wilson interval of k out of n; null for n = 0."""
    k, n = k.cast("double"), F.when(n > 0, n.cast("double"))
    p, d = k / n, 1 + Z * Z / n
    mid, half = (p + Z * Z / (2 * n)) / d, Z * F.sqrt((p * (1 - p) + Z * Z / (4 * n)) / n) / d
    return F.round(mid - half, digits), F.round(mid + half, digits)


def recall_at(ranks: DataFrame, rank: Column, *ks: int) -> DataFrame:
    """AGG-09/10: recall at each k over all queries (a missing rank is a miss), median and largest rank."""
    cuts = [share(F.coalesce(rank <= k, F.lit(False))).alias(f"recall_{k}") for k in ks]
    hits = [F.count_if(rank <= k).alias(f"hits_{k}") for k in ks]
    g = ranks.agg(F.count("*").alias("n"), *hits, *cuts, F.max(rank).alias("max_rank"))
    return _with_quantiles(g, quantiles(ranks, F.col(rank) if isinstance(rank, str) else rank, [0.5]), ["median_rank"])


#: A node of a digest tree joins so many digests; with LEVELS levels a tree holds FAN to the power of LEVELS of them.
FAN, LEVELS = 1024, 4


def digest_tree(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """AGG-26: (key, digest) of all digests of each key, whatever their order and partitions: sorted, then every FAN of
    them joined and hashed, LEVELS times. A range sort numbers them, so no task holds more than a node's digests."""
    n = numbered(rows.select(key, digest), F.asc(key), F.asc(digest))
    first = n.groupBy(F.col(key).alias("_k")).agg(F.min("_pos").alias("_first"))
    at = n.join(first, n[key].eqNullSafe(first["_k"])).select(key, digest, (F.col("_pos") - F.col("_first")).alias("_i"))
    for _ in range(LEVELS):
        node = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", digest))), lambda x: x[digest]), ""), 256)
        at = at.groupBy(key, F.floor(F.col("_i") / FAN).alias("_n")).agg(node.alias(digest)).withColumnRenamed("_n", "_i")
    return at.select(key, digest)
