"""Retrieval family: similarities, per-track aggregation, ranking, reranking, recall."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, retrieval, vectors
from .base import BEST_SQL, CPAIRS_SQL, GREEDY_SQL, MEAN_SQL, PAIRS_GAPS_SQL, PAIRS_SQL, WIN_SQL, queries_of, query, read, references_of, windows


def both(spark, d, irregular=False, centred=False):
    """Query windows and reference windows."""
    w = windows(spark, d, irregular)
    if centred:
        w = vectors.centred(w, w.filter("role = 'reference'"))
    return queries_of(w), references_of(w)


def best_windows(spark, d, centred=False):
    """The pairs that may be the best of a query window and track."""
    return vectors.best_scores(*both(spark, d, centred=centred))


def sides(spark, d, irregular=False, centred=False):
    return vectors.Sides(*both(spark, d, irregular, centred))


def segments(spark, d, centred=False):
    return retrieval.greedy_windows(retrieval.best_per_window(best_windows(spark, d, centred)))


@query("jn_01_all_pairs", PAIRS_SQL + " SELECT query_id, q_off, track_id, r_off, score FROM pairs")
def all_pairs(spark, d):
    return vectors.pair_scores(*both(spark, d))


@query("agg_01_best_pair", PAIRS_SQL + """ SELECT query_id, track_id, max(score) AS score, arg_min(q_off, (-score, q_off, r_off)) AS q_off, arg_min(r_off, (-score, q_off, r_off)) AS r_off
 FROM pairs GROUP BY query_id, track_id""")
def best_pair(spark, d):
    return retrieval.best_pair(sides(spark, d))


@query("agg_02_best_per_window", PAIRS_SQL + BEST_SQL + " SELECT * FROM best")
def best_window(spark, d):
    return retrieval.best_per_window(best_windows(spark, d))


_MEANS = """, d1 AS (SELECT track_id, role, generate_subscripts(v, 1) AS dim, unnest(v) AS x FROM {w}), m0 AS (SELECT track_id, role, dim, avg(x) AS x FROM d1 GROUP BY ALL),
m AS (SELECT track_id, role, list(x ORDER BY dim) AS v FROM m0 GROUP BY ALL), mn AS (SELECT track_id, role, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS v FROM m),
out AS (SELECT a.track_id AS query_id, b.track_id, round(list_inner_product(a.v, b.v), 6) AS score FROM mn a, mn b WHERE a.role = 'query' AND b.role = 'reference')"""


def mean_embeddings(spark, d, centred=False):
    w = windows(spark, d)
    if centred:
        w = vectors.centred(w, w.filter("role = 'reference'"))
    m = vectors.mean_vector(w, "track_id", "role").withColumn("v", vectors.normalise(F.col("mean")))
    q = m.filter("role = 'query'").select(F.col("track_id").alias("query_id"), F.lit(0.0).alias("q_off"), "v")
    r = m.filter("role = 'reference'").select("track_id", F.lit(0.0).alias("r_off"), "v")
    return vectors.pair_scores(q, r).select("query_id", "track_id", "score")


@query("agg_03_mean_embedding", "WITH " + WIN_SQL + _MEANS.format(w="win") + " SELECT * FROM out")
def mean_embedding(spark, d):
    return mean_embeddings(spark, d)


@query("agg_04_global_mean", "WITH " + WIN_SQL + ", x AS (SELECT generate_subscripts(v, 1) AS dim, unnest(v) AS x FROM win) SELECT dim::bigint AS dim, round(avg(x), 6) AS mean FROM x GROUP BY dim")
def global_mean(spark, d):
    m = vectors.mean_vector(windows(spark, d))
    return m.select(F.posexplode("mean").alias("p", "x")).select((F.col("p") + 1).cast("long").alias("dim"), F.round("x", 6).alias("mean"))


@query("agg_05_greedy_top3", PAIRS_SQL + BEST_SQL + GREEDY_SQL + " SELECT * FROM seg")
def greedy(spark, d):
    return segments(spark, d).select("query_id", "track_id", "score")


@query("agg_06_greedy_pairs", PAIRS_SQL + """, g1 AS (SELECT query_id, track_id, max((score, q_off, r_off)) AS a FROM pairs GROUP BY ALL),
g2 AS (SELECT g1.query_id, g1.track_id, any_value(a) AS a, max((p.score, p.q_off, p.r_off)) FILTER (abs(p.q_off - a[2]) >= 10 AND abs(p.r_off - a[3]) >= 10) AS b FROM g1 JOIN pairs p USING (query_id, track_id) GROUP BY ALL),
g3 AS (SELECT g2.query_id, g2.track_id, any_value(a) AS a, any_value(b) AS b, max((p.score, p.q_off, p.r_off)) FILTER (abs(p.q_off - a[2]) >= 10 AND abs(p.r_off - a[3]) >= 10 AND abs(p.q_off - b[2]) >= 10 AND abs(p.r_off - b[3]) >= 10) AS c
  FROM g2 JOIN pairs p USING (query_id, track_id) GROUP BY ALL)
SELECT query_id, track_id, round((a[1] + coalesce(b[1], 0) + coalesce(c[1], 0)) / (1 + (b IS NOT NULL)::int + (c IS NOT NULL)::int), 8) AS score,
 (1 + (b IS NOT NULL)::int + (c IS NOT NULL)::int)::bigint AS n FROM g3""")
def greedy_two_axes(spark, d):
    return retrieval.greedy_pairs(sides(spark, d))


_CONT = """, qs AS (SELECT query_id, q_off, lead(q_off, 1) OVER w AS q1, lead(q_off, 2) OVER w AS q2 FROM (SELECT DISTINCT query_id, q_off FROM pairs) WINDOW w AS (PARTITION BY query_id ORDER BY q_off)),
rs AS (SELECT track_id, r_off, lead(r_off, 1) OVER w AS r1, lead(r_off, 2) OVER w AS r2 FROM (SELECT DISTINCT track_id, r_off FROM pairs) WINDOW w AS (PARTITION BY track_id ORDER BY r_off)),
c AS (SELECT p.*, a.score AS s1, CASE WHEN abs(q2 - q1 - 5) <= 0.51 AND abs(r2 - r1 - 5) <= 0.51 THEN b.score END AS s2 FROM pairs p JOIN qs USING (query_id, q_off) JOIN rs USING (track_id, r_off)
 LEFT JOIN pairs a ON a.query_id = p.query_id AND a.track_id = p.track_id AND a.q_off = q1 AND a.r_off = r1 AND abs(q1 - p.q_off - 5) <= 0.51 AND abs(r1 - p.r_off - 5) <= 0.51
 LEFT JOIN pairs b ON a.score IS NOT NULL AND b.query_id = p.query_id AND b.track_id = p.track_id AND b.q_off = q2 AND b.r_off = r2),
t AS (SELECT query_id, track_id, min((-round((score + s1 + s2) / 3, 8), q_off, r_off)) FILTER (s1 IS NOT NULL AND s2 IS NOT NULL) AS t3, min((-round((score + s1) / 2, 8), q_off, r_off)) FILTER (s1 IS NOT NULL) AS t2,
  min((-round(score, 8), q_off, r_off)) AS t1 FROM c GROUP BY ALL),
cont AS (SELECT query_id, track_id, -coalesce(t3, t2, t1)[1] AS continuity_score, (CASE WHEN t3 IS NOT NULL THEN 3 WHEN t2 IS NOT NULL THEN 2 ELSE 1 END)::bigint AS windows,
  10 + 5.0::double * (CASE WHEN t3 IS NOT NULL THEN 2 WHEN t2 IS NOT NULL THEN 1 ELSE 0 END) AS continuous_s, coalesce(t3, t2, t1)[2] AS q_off, coalesce(t3, t2, t1)[3] AS r_off FROM t)"""


@query("agg_07_continuity", PAIRS_SQL + _CONT + " SELECT * FROM cont")
def continuity(spark, d):
    return retrieval.continuity(sides(spark, d))


@query("jn_16_aligned_windows", PAIRS_GAPS_SQL + _CONT + " SELECT * FROM cont")
def aligned(spark, d):
    return retrieval.continuity(sides(spark, d, irregular=True))


_MODES = {"max_raw": (False, "SELECT query_id, track_id, max(score) AS score FROM pairs GROUP BY ALL"), "max_centered": (True, "SELECT query_id, track_id, max(score) AS score FROM pairs GROUP BY ALL"),
          "seg_top3_raw": (False, "SELECT * FROM seg"), "seg_top3_centered": (True, "SELECT * FROM seg"), "mean_emb_raw": (False, "SELECT * FROM out"), "mean_emb_centered": (True, "SELECT * FROM out")}


def mode_scores(spark, d, mode):
    """One of the six aggregation modes: query_id, track_id, score."""
    kind, centred = mode.rsplit("_", 1)[0], mode.endswith("centered")
    if kind == "mean_emb":
        return mean_embeddings(spark, d, centred)
    if kind == "max":
        return retrieval.best_pair(sides(spark, d, centred=centred)).select("query_id", "track_id", "score")
    return segments(spark, d, centred).select("query_id", "track_id", "score")


def _mode_sql(mode):
    centred, pick = _MODES[mode]
    if mode.startswith("mean_emb"):
        return "WITH " + WIN_SQL + (MEAN_SQL if centred else "") + _MEANS.format(w="cen" if centred else "win") + f", sc AS ({pick})"
    return (CPAIRS_SQL if centred else PAIRS_SQL) + (BEST_SQL + GREEDY_SQL if mode.startswith("seg") else "") + f", sc AS ({pick})"


_RANK = ", rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, track_id)::bigint AS rank FROM sc)"


def _register(mode):
    @query(f"win_01_rank_{mode}", _mode_sql(mode) + _RANK + " SELECT * FROM rk WHERE rank <= 5")
    def ranked(spark, d):
        return retrieval.rank(mode_scores(spark, d, mode), *retrieval.by_score()).filter("rank <= 5")


for _m in _MODES:
    _register(_m)


_CR = PAIRS_SQL + _CONT + """, sc AS (SELECT query_id, track_id, max(score) AS score FROM pairs GROUP BY ALL)""" + _RANK + """,
rr AS (SELECT rk.query_id, rk.track_id, rk.rank, rk.score, continuity_score, windows, row_number() OVER (PARTITION BY rk.query_id ORDER BY continuity_score DESC, windows DESC, score DESC, rank)::bigint AS new_rank
 FROM rk JOIN cont ON cont.query_id = rk.query_id AND cont.track_id = rk.track_id WHERE rank <= 5)"""


def reranked(spark, d, k=5):
    both_scores = sides(spark, d).scores(1, 3).select("query_id", "track_id", "most_1.score", F.col("most_3.score").alias("continuity_score"), "most_3.windows")
    met = retrieval.rank(both_scores, *retrieval.by_score()).select("query_id", "track_id", "rank", "score", "continuity_score", "windows")
    return retrieval.rerank(met, k, F.desc("continuity_score"), F.desc("windows"), F.desc("score"))


@query("win_02_rerank_in_pool", _CR + " SELECT * FROM rr")
def rerank_pool(spark, d):
    return reranked(spark, d)


@query("win_12_rank_offset", _CR + " SELECT query_id, track_id, rank, new_rank, rank - new_rank AS gained FROM rr")
def rank_offset(spark, d):
    return reranked(spark, d).select("query_id", "track_id", "rank", "new_rank", (F.col("rank") - F.col("new_rank")).alias("gained"))


_POOLS = _mode_sql("max_raw") + _RANK + """, k AS (SELECT unnest([5, 20])::bigint AS pool),
o AS (SELECT pool, query_id, track_id, rank, score, row_number() OVER (PARTITION BY pool, query_id ORDER BY (track_id * 7 % 10) DESC, score DESC, rank)::bigint AS new_rank FROM rk, k WHERE rank <= pool)"""


@query("win_03_rerank_pools", _POOLS + " SELECT * FROM o")
def rerank_pools(spark, d):
    top = retrieval.rank(mode_scores(spark, d, "max_raw"), *retrieval.by_score())
    pools = top.withColumn("pool", F.explode(F.array(F.lit(5).cast("long"), F.lit(20).cast("long")))).filter("rank <= pool")
    from pyspark.sql import Window

    order = Window.partitionBy("pool", "query_id").orderBy(F.desc(F.col("track_id") * 7 % 10), F.desc("score"), "rank")
    return pools.withColumn("new_rank", F.row_number().over(order).cast("long")).select("pool", "query_id", "track_id", "rank", "score", "new_rank")


@query("win_04_verifier_order", _mode_sql("seg_top3_raw") + _RANK + """, v AS (SELECT *, CASE WHEN rank <= 3 THEN round((track_id * 3 % 7) / 7.0::double, 4) END AS verifier, CASE WHEN rank <= 3 THEN round(0.5 * score + 0.05 * track_id, 6) END AS fusion FROM rk)
SELECT query_id, track_id, score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(verifier, 0) DESC, coalesce(fusion, score) DESC, score DESC, track_id)::bigint AS final_rank FROM v""")
def verifier_order(spark, d):
    top = retrieval.rank(mode_scores(spark, d, "seg_top3_raw"), *retrieval.by_score())
    first = F.col("rank") <= 3
    v = top.withColumns({"verifier": F.when(first, F.round((F.col("track_id") * 3 % 7) / 7.0, 4)), "fusion": F.when(first, F.round(0.5 * F.col("score") + 0.05 * F.col("track_id"), 6))})
    order = [F.desc(F.coalesce("verifier", F.lit(0.0))), F.desc(F.coalesce("fusion", "score")), F.desc("score"), F.asc("track_id")]
    return retrieval.rank(v, *order, name="final_rank").select("query_id", "track_id", "score", "final_rank")


_OWN = _mode_sql("seg_top3_centered") + _RANK + ", own AS (SELECT query_id, score, rank FROM rk WHERE track_id = query_id)"


def own_ranks(spark, d):
    return retrieval.rank(mode_scores(spark, d, "seg_top3_centered"), *retrieval.by_score()).filter("track_id = query_id")


@query("agg_09_recall_at_k", _OWN + """ SELECT count(*) AS n, count(*) FILTER (rank <= 1) AS hits_1, count(*) FILTER (rank <= 5) AS hits_5, round(avg((rank <= 1)::int::double), 6) AS recall_1,
 round(avg((rank <= 5)::int::double), 6) AS recall_5, round(quantile_cont(rank, 0.5), 6) AS median_rank, max(rank) AS max_rank FROM own""")
def recall_at(spark, d):
    return metrics.recall_at(own_ranks(spark, d), F.col("rank"), 1, 5)


@query("agg_10_top_counts", _OWN + """ SELECT count(*) AS n, count(*) FILTER (rank <= 1) AS hits_1, count(*) FILTER (rank <= 5) AS hits_5, count(*) FILTER (rank <= 10) AS hits_10, round(avg((rank <= 1)::int::double), 6) AS recall_1,
 round(avg((rank <= 5)::int::double), 6) AS recall_5, round(avg((rank <= 10)::int::double), 6) AS recall_10, round(quantile_cont(rank, 0.5), 6) AS median_rank, max(rank) AS max_rank FROM own""")
def top_counts(spark, d):
    return metrics.recall_at(own_ranks(spark, d), F.col("rank"), 1, 5, 10)


@query("jn_11_expected_source", _mode_sql("max_raw") + _RANK + " SELECT n_nationkey::bigint AS query_id, rk.score, rk.rank, coalesce(rk.rank <= 5, false) AS in_top5 FROM nation LEFT JOIN rk ON rk.query_id = n_nationkey AND rk.track_id = n_nationkey")
def expected_source(spark, d):
    top = retrieval.rank(mode_scores(spark, d, "max_raw"), *retrieval.by_score()).filter("track_id = query_id").select("query_id", "score", "rank")
    asked = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"))
    return asked.join(top, "query_id", "left").select("query_id", "score", "rank", F.coalesce(F.col("rank") <= 5, F.lit(False)).alias("in_top5"))


_TOP = _mode_sql("seg_top3_centered") + _RANK + ", t3 AS (SELECT * FROM rk WHERE rank <= 3)"


@query("agg_33_top1_and_ceiling", _TOP + """ , f AS (SELECT query_id, arg_min(track_id, (-(track_id * 7 % 10), track_id)) AS best, bool_or(track_id = query_id) AS held FROM t3 GROUP BY query_id)
 SELECT round(avg((best = query_id)::int::double), 6) AS top1, round(avg(held::int::double), 6) AS ceiling FROM f""")
def top1_and_ceiling(spark, d):
    t = retrieval.rank(mode_scores(spark, d, "seg_top3_centered"), *retrieval.by_score()).filter("rank <= 3")
    f = t.groupBy("query_id").agg(F.max_by("track_id", F.struct((F.col("track_id") * 7 % 10).alias("v"), -F.col("track_id"))).alias("best"), F.collect_set("track_id").alias("held"))
    return f.select(metrics.share(F.col("best") == F.col("query_id")).alias("top1"), metrics.share(F.array_contains("held", F.col("query_id"))).alias("ceiling"))


@query("agg_34_query_max", _TOP + " SELECT query_id, max(score) AS score FROM t3 GROUP BY query_id")
def query_max(spark, d):
    return retrieval.rank(mode_scores(spark, d, "seg_top3_centered"), *retrieval.by_score()).filter("rank <= 3").groupBy("query_id").agg(F.max("score").alias("score"))
