"""Registration of queries, and the fixture relations they share with their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its DuckDB form."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def windows(spark: SparkSession, sf_dir: str, irregular: bool = False) -> DataFrame:
    """track_id, role, offset_s, v: every fifth vector is a query window; irregular numbering leaves gaps in each role."""
    e = read(spark, sf_dir, "embeddings")
    role = F.when(F.col("vec_id") % 5 == 0, "query").otherwise("reference")
    w = Window.partitionBy("label", *([] if irregular else [role])).orderBy("vec_id")
    return e.select("vec_id", F.col("label").cast("long").alias("track_id"), role.alias("role"), (5.0 * (F.row_number().over(w) - 1)).cast("double").alias("offset_s"),
                    F.col("embedding").cast("array<double>").alias("v"))


def queries_of(w: DataFrame) -> DataFrame:
    return w.filter("role = 'query'").select(F.col("track_id").alias("query_id"), F.col("offset_s").alias("q_off"), "v")


def references_of(w: DataFrame) -> DataFrame:
    return w.filter("role = 'reference'").select("track_id", F.col("offset_s").alias("r_off"), "v")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with two scores: doc_id, family, group_id, positive, score, pair_score, toxic, n_chars."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", F.col("lang").alias("family"), F.col("source").alias("group_id"), (F.col("quality") == 1).alias("positive"),
                    F.round((F.col("n_chars") % 997) / 997.0, 4).alias("score"), F.round((F.col("doc_id") * 37 % 101) / 101.0, 4).alias("pair_score"), "toxic", "n_chars")


WIN_SQL = """win AS (SELECT vec_id, label::bigint AS track_id, CASE WHEN vec_id % 5 = 0 THEN 'query' ELSE 'reference' END AS role,
  5.0::double * (row_number() OVER (PARTITION BY label, vec_id % 5 = 0 ORDER BY vec_id) - 1) AS offset_s, list_transform(embedding, lambda x: x::double) AS v FROM embeddings)"""
WIN_GAPS_SQL = WIN_SQL.replace(", vec_id % 5 = 0 ORDER", " ORDER")
_PAIRS = """, q AS (SELECT track_id AS query_id, offset_s AS q_off, v FROM {w} WHERE role = 'query'), r AS (SELECT track_id, offset_s AS r_off, v FROM {w} WHERE role = 'reference'),
pairs AS (SELECT query_id, q_off, track_id, r_off, round(list_inner_product(q.v, r.v), 6) AS score FROM q, r)"""
PAIRS_SQL = "WITH " + WIN_SQL + _PAIRS.format(w="win")
PAIRS_GAPS_SQL = "WITH " + WIN_GAPS_SQL + _PAIRS.format(w="win")
MEAN_SQL = """, dims AS (SELECT generate_subscripts(v, 1) AS dim, unnest(v) AS x FROM win WHERE role = 'reference'), mean AS (SELECT list(x ORDER BY dim) AS m FROM (SELECT dim, avg(x) AS x FROM dims GROUP BY dim)),
cen0 AS (SELECT track_id, role, offset_s, list_transform(list_zip(v, m), lambda p: p[1] - p[2]) AS v FROM win, mean),
cen AS (SELECT track_id, role, offset_s, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS v FROM cen0)"""
CPAIRS_SQL = "WITH " + WIN_SQL + MEAN_SQL + _PAIRS.format(w="cen")
BEST_SQL = """, best AS (SELECT query_id, track_id, q_off, max(score) AS score, arg_min(r_off, (-score, r_off)) AS r_off FROM pairs GROUP BY ALL)"""
GREEDY_SQL = """, g1 AS (SELECT query_id, track_id, min((-score, q_off)) AS a FROM best GROUP BY ALL),
g2 AS (SELECT g1.query_id, g1.track_id, any_value(a) AS a, min((-b.score, b.q_off)) FILTER (abs(b.q_off - a[2]) >= 10) AS b FROM g1 JOIN best b USING (query_id, track_id) GROUP BY ALL),
g3 AS (SELECT g2.query_id, g2.track_id, any_value(a) AS a, any_value(g2.b) AS b, min((-t.score, t.q_off)) FILTER (abs(t.q_off - a[2]) >= 10 AND abs(t.q_off - g2.b[2]) >= 10) AS c FROM g2 JOIN best t USING (query_id, track_id) GROUP BY ALL),
seg AS (SELECT query_id, track_id, round(-(a[1] + coalesce(b[1], 0) + coalesce(c[1], 0)) / (1 + (b IS NOT NULL)::int + (c IS NOT NULL)::int), 8) AS score FROM g3)"""
SCORED_SQL = """scored AS (SELECT doc_id, lang AS family, source AS group_id, quality = 1 AS positive, round((n_chars % 997) / 997.0::double, 4) AS score,
  round((doc_id * 37 % 101) / 101.0::double, 4) AS pair_score, toxic, n_chars FROM documents JOIN labels USING (doc_id))"""
