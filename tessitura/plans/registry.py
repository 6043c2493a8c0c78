"""Registered queries of the analytics operators, with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import policy, retrieval
from . import q_metrics, q_relational, q_retrieval, q_scalars, q_signal, q_streaming
from .base import BEST_SQL, CPAIRS_SQL, GREEDY_SQL, ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES", "flagship", "q_metrics", "q_relational", "q_retrieval", "q_scalars", "q_signal", "q_streaming"]


@query("flagship_verification", CPAIRS_SQL + BEST_SQL + GREEDY_SQL + """, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, track_id)::bigint AS rank FROM seg),
 p AS (SELECT query_id, max(score) AS top_score, arg_min(track_id, rank) AS top_track, round(max(score) - min(score), 6) AS margin FROM rk WHERE rank <= 3 GROUP BY query_id)
 SELECT *, CASE WHEN margin >= 0.05 THEN 'HOLD' WHEN top_score >= 0.3 THEN 'WARN' ELSE 'PASS' END AS decision FROM p""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows to decisions: centre, all pairs, best reference per window, greedy non-overlap top 3, rank, decide."""
    ranked = retrieval.rank(q_retrieval.segments(spark, sf_dir, centred=True).select("query_id", "track_id", "score"), *retrieval.by_score()).filter("rank <= 3")
    top = ranked.groupBy("query_id").agg(F.max("score").alias("top_score"), F.min_by("track_id", "rank").alias("top_track"), F.round(F.max("score") - F.min("score"), 6).alias("margin"))
    return top.withColumn("decision", policy.decide(F.lit(False), F.col("top_score"), F.col("margin"), 0.3, 0.05))
