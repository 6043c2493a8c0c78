"""Per-track aggregation of window similarities: max, best per window, greedy non-overlap, continuity, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import settle
from .vectors import STEP, Sides

W = 10.0


def best_pair(sides: Sides) -> DataFrame:
    """AGG-01: highest score of each (query, track) with its offsets; ties: lowest query offset, then reference offset."""
    return sides.runs().select("query_id", "track_id", "score", "q_off", "r_off")


def best_per_window(pairs: DataFrame) -> DataFrame:
    """AGG-02: best reference window of every query window in each track; ties: lowest reference offset."""
    top = F.max(F.struct("score", (-F.col("r_off")).alias("r"))).alias("t")
    out = pairs.groupBy("query_id", "track_id", "q_off").agg(top)
    return out.select("query_id", "track_id", "q_off", F.col("t.score").alias("score"), (-F.col("t.r")).alias("r_off"))


def _fold(sorted_items: Column, apart: Column, k: int, kind: str) -> Column:
    empty = F.array().cast(f"array<{kind}>")
    return F.aggregate(sorted_items, empty, lambda kept, x: F.when((F.size(kept) < k) & F.forall(kept, lambda y: apart(x, y)), F.array_append(kept, x)).otherwise(kept))


def greedy_windows(best: DataFrame, k: int = 3, gap: float = W) -> DataFrame:
    """AGG-05: mean of the k best windows at least ``gap`` apart; ties: lowest offset first. segments: those taken."""
    items = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("m"), F.col("q_off").alias("q"), F.col("r_off").alias("r"))))
    kept = best.groupBy("query_id", "track_id").agg(items.alias("items"))
    kept = kept.withColumn("kept", _fold(F.col("items"), lambda x, y: F.abs(x["q"] - y["q"]) >= gap, k, "struct<m:double,q:double,r:double>"))
    mean = -F.aggregate("kept", F.lit(0.0), lambda s, x: s + x["m"]) / F.size("kept")
    return kept.select("query_id", "track_id", F.round(mean, 8).alias("score"), F.transform("kept", lambda x: F.struct(x["q"].alias("q_off"), x["r"].alias("r_off"), (-x["m"]).alias("score"))).alias("segments"))


def greedy_pairs(sides: Sides, k: int = 3, gap: float = W) -> DataFrame:
    """AGG-06: the same over window pairs, apart on both axes; order (score, query, reference) descending.

    The k pairs are found one after another, each round by products of which every cell leaves out what lies too near to
    the pairs taken; no pair of windows is kept between rounds.
    """
    keys, fields = ["query_id", "track_id"], {"scores": "score", "q_taken": "q_off", "r_taken": "r_off"}
    taken = settle(sides.runs(last=True).select(*keys, *[F.array(c).alias(name) for name, c in fields.items()]), "taken")
    for _ in range(k - 1):
        found = sides.runs(last=True, taken=taken.drop("scores"), gap=gap)
        more = [F.when(F.col("windows").isNull(), F.col(name)).otherwise(F.array_append(name, F.col(c))).alias(name) for name, c in fields.items()]
        taken = settle(taken.join(found, keys, "left").select(*keys, *more), "taken")
    return taken.select(*keys, F.round(F.aggregate("scores", F.lit(0.0), lambda s, x: s + x) / F.size("scores"), 8).alias("score"), F.size("scores").cast("long").alias("n"))


def continuity(sides: Sides) -> DataFrame:
    """AGG-07 / JN-16: best mean of three, else two, else one time-aligned windows advancing together by about 5 s.

    Ties: lowest query, then reference offset. continuous_s = 10 + 5 (windows - 1). Windows that advance together lie on one
    diagonal of a cell's products, and stretches hold the two windows that come after them, so runs are found in the cell.
    """
    best = sides.runs(most=3)
    return best.select("query_id", "track_id", F.col("score").alias("continuity_score"), "windows", (W + STEP * (F.col("windows") - 1)).alias("continuous_s"), "q_off", "r_off")


def rank(df: DataFrame, *order: Column, key: str = "query_id", name: str = "rank") -> DataFrame:
    """WIN-01 and kin: row_number within key; the caller's order must break every tie."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def by_score(*first: Column) -> list[Column]:
    return [*first, F.desc("score"), F.asc("track_id")]


def rerank(ranked: DataFrame, k: int, *order: Column, key: str = "query_id") -> DataFrame:
    """WIN-02/03: order again inside the first k; ties keep the earlier rank."""
    return rank(ranked.filter(F.col("rank") <= k), *order, F.asc("rank"), key=key, name="new_rank")
