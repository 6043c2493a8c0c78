"""Metrics, thresholds, breakdowns and counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, thresholds
from .base import SCORED_SQL, query, read, scored

S = "WITH " + SCORED_SQL
HOLD, WARN = 0.9, 0.35


def positive_():
    return F.col("positive")


def _rates(tp="tp", fn="fn", fp="fp", tn="tn"):
    div = lambda a, b: f"round(CASE WHEN {b} <> 0 THEN ({a})::double / ({b}) END, 6)"
    return f"{div(tp, f'{tp}+{fn}')} AS recall, {div(tp, f'{tp}+{fp}')} AS precision, {div(tn, f'{tn}+{fp}')} AS specificity, {div(fp, f'{fp}+{tn}')} AS fpr, {div(f'2*{tp}', f'2*{tp}+{fp}+{fn}')} AS f1"


def _cm(thr, keys="", table="scored"):
    k = f"{keys}, " if keys else ""
    return f"SELECT {k}count(*) FILTER (positive AND score >= {thr}) AS tp, count(*) FILTER (positive AND score < {thr}) AS fn, count(*) FILTER (NOT positive AND score >= {thr}) AS fp, count(*) FILTER (NOT positive AND score < {thr}) AS tn FROM {table}" + (f" GROUP BY {keys}" if keys else "")


@query("agg_08_confusion", S + f", c AS ({_cm(0.5)}) SELECT *, {_rates()} FROM c")
def confusion(spark, d):
    return metrics.confusion(scored(spark, d), positive_(), F.col("score"), 0.5)


@query("agg_08_published_counts", f"WITH c(name, tp, fn, fp, tn) AS (VALUES ('hold', 63::bigint, 0::bigint, 293::bigint, 6::bigint), ('warn', 63, 0, 299, 0), ('empty', 0, 0, 0, 0)) SELECT *, {_rates()} FROM c")
def published_counts(spark, d):
    rows = [("hold", 63, 0, 293, 6), ("warn", 63, 0, 299, 0), ("empty", 0, 0, 0, 0)]
    return metrics.rates(spark.createDataFrame(rows, "name string, tp long, fn long, fp long, tn long"))


@query("agg_11_distribution", S + """ SELECT positive, count(score) AS n, round(avg(score), 6) AS mean, round(CASE WHEN count(score) = 1 THEN 0 ELSE stddev_samp(score) END, 4) AS std, round(quantile_cont(score, 0.5), 6) AS median,
 round(quantile_cont(score, 0.1), 6) AS p10, round(quantile_cont(score, 0.9), 6) AS p90 FROM scored GROUP BY positive""")
def distribution(spark, d):
    return metrics.distribution(scored(spark, d), F.col("score"), "positive")


_AUC = "round(CASE WHEN count(*) FILTER (positive) * count(*) FILTER (NOT positive) > 0 THEN (sum(rk) FILTER (positive) - count(*) FILTER (positive) * (count(*) FILTER (positive) + 1) / 2.0::double) / (count(*) FILTER (positive) * count(*) FILTER (NOT positive))::double END, 6)"


@query("agg_12_auc", S + f", r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::double AS rk FROM scored) SELECT {_AUC} AS auc FROM r")
def auc(spark, d):
    return metrics.auc(scored(spark, d), positive_(), F.col("score"))


@query("jn_15_pairwise_auc", S + """, p AS (SELECT a.family, CASE WHEN a.score > b.score THEN 1.0::double WHEN a.score = b.score THEN 0.5::double ELSE 0 END AS w FROM scored a JOIN scored b ON a.family = b.family AND a.positive AND NOT b.positive)
 SELECT f.family, round(avg(w), 6) AS auc FROM (SELECT DISTINCT family FROM scored) f LEFT JOIN p USING (family) GROUP BY f.family""")
def pairwise_auc(spark, d):
    return metrics.auc(scored(spark, d), positive_(), F.col("score"), "family")


@query("agg_13_cohens_d", S + """, g AS (SELECT family, count(*) FILTER (positive) AS n1, count(*) FILTER (NOT positive) AS n0, avg(score) FILTER (positive) AS m1, avg(score) FILTER (NOT positive) AS m0,
 var_samp(score) FILTER (positive) AS v1, var_samp(score) FILTER (NOT positive) AS v0 FROM scored GROUP BY family)
 SELECT family, round(CASE WHEN n1 > 1 AND n0 > 1 AND ((n1 - 1) * v1 + (n0 - 1) * v0) > 0 THEN (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) END, 4) AS cohens_d FROM g""")
def cohens_d(spark, d):
    return metrics.cohens_d(scored(spark, d), positive_(), F.col("score"), "family")


def _wilson(k, n):
    z = "1.959963984540054::double"
    p, dd = f"({k})::double / ({n})", f"(1 + {z} * {z} / ({n}))"
    mid, half = f"({p} + {z} * {z} / (2 * ({n}))) / {dd}", f"{z} * sqrt(({p} * (1 - {p}) + {z} * {z} / (4 * ({n}))) / ({n})) / {dd}"
    return f"round(CASE WHEN ({n}) > 0 THEN {mid} - {half} END, 6) AS low, round(CASE WHEN ({n}) > 0 THEN {mid} + {half} END, 6) AS high"


@query("agg_14_wilson", S + f", g AS (SELECT family, count(*) FILTER (positive) AS k, count(*) AS n FROM scored GROUP BY family) SELECT family, k, n, {_wilson('k', 'n')} FROM g")
def wilson(spark, d):
    g = scored(spark, d).groupBy("family").agg(F.count_if(positive_()).alias("k"), F.count("*").alias("n"))
    low, high = metrics.wilson(F.col("k"), F.col("n"))
    return g.select("family", "k", "n", low.alias("low"), high.alias("high"))


DECISION = "CASE WHEN toxic = 1 AND pair_score > 0.95 THEN 'BLOCK' WHEN pair_score >= 0.9 THEN 'HOLD' WHEN score >= 0.35 THEN 'WARN' ELSE 'PASS' END"


def decided(spark, d):
    from ..operators.policy import decide

    s = scored(spark, d)
    return s.withColumn("decision", decide((F.col("toxic") == 1) & (F.col("pair_score") > 0.95), F.col("score"), F.col("pair_score"), WARN, HOLD))


D = S + f", dec AS (SELECT *, {DECISION} AS decision FROM scored)"


@query("agg_15_decision_rates", D + ", v AS (SELECT * FROM dec WHERE decision <> 'BLOCK') SELECT decision, count(*) AS n, round(count(*) / (SELECT count(*) FROM v)::double, 6) AS rate FROM v GROUP BY decision")
def decision_rates(spark, d):
    from pyspark.sql import Window

    g = decided(spark, d).filter("decision <> 'BLOCK'").groupBy("decision").agg(F.count("*").alias("n"))
    return g.withColumn("rate", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


@query("agg_16_crosstab", D + " SELECT family, " + ", ".join(f"count(*) FILTER (decision = '{x}') AS {x}" for x in ("PASS", "WARN", "HOLD", "BLOCK")) + " FROM dec GROUP BY family")
def crosstab(spark, d):
    return decided(spark, d).groupBy("family").pivot("decision", ["PASS", "WARN", "HOLD", "BLOCK"]).count().na.fill(0)


@query("agg_17_distinct_counts", S + " SELECT count(DISTINCT family) AS families, count(DISTINCT group_id) AS groups, count(DISTINCT doc_id) AS docs FROM scored")
def distinct_counts(spark, d):
    return scored(spark, d).agg(F.countDistinct("family").alias("families"), F.countDistinct("group_id").alias("groups"), F.countDistinct("doc_id").alias("docs"))


@query("agg_18_mode_metrics", S + """, m AS (SELECT unnest(['score', 'pair_score']) AS aggregation, unnest([score, pair_score]) AS value, positive FROM scored)
 SELECT aggregation, count(*) FILTER (positive) AS positives, count(*) FILTER (NOT positive) AS safes, round(avg((value >= 0.5)::int::double) FILTER (positive), 6) AS positive_recall, round(avg((value >= 0.5)::int::double) FILTER (NOT positive), 6) AS safe_fpr FROM m GROUP BY aggregation""")
def mode_metrics(spark, d):
    m = scored(spark, d).unpivot(["positive"], ["score", "pair_score"], "aggregation", "value")
    hit = F.col("value") >= 0.5
    return m.groupBy("aggregation").agg(F.count_if(positive_()).alias("positives"), F.count_if(~positive_()).alias("safes"), metrics.share(F.when(positive_(), hit)).alias("positive_recall"), metrics.share(F.when(~positive_(), hit)).alias("safe_fpr"))


@query("agg_19_case_breakdown", S + " SELECT k, family, count(*) AS n, round(avg((score >= k / 10.0::double)::int::double), 6) AS rate FROM scored, (SELECT unnest([5, 20])::bigint AS k) GROUP BY k, family")
def case_breakdown(spark, d):
    s = scored(spark, d).withColumn("k", F.explode(F.array(F.lit(5).cast("long"), F.lit(20).cast("long"))))
    return s.groupBy("k", "family").agg(F.count("*").alias("n"), metrics.share(F.col("score") >= F.col("k") / 10.0).alias("rate"))


@query("agg_20_families_with_missing", S + ", f AS (SELECT unnest(['en', 'de', 'xx']) AS family) SELECT f.family, count(doc_id) AS n, round(avg((score >= 0.5)::int::double), 6) AS recall, count(doc_id) = 0 AS missing FROM f LEFT JOIN scored USING (family) GROUP BY f.family")
def families_with_missing(spark, d):
    asked = spark.createDataFrame([("en",), ("de",), ("xx",)], "family string")
    g = F.broadcast(asked).join(scored(spark, d), "family", "left").groupBy("family")
    return g.agg(F.count("doc_id").alias("n"), metrics.share(F.col("score") >= 0.5).alias("recall"), (F.count("doc_id") == 0).alias("missing"))


CURVE = """, c AS (SELECT t, (SELECT avg((score >= t)::int::double) FROM scored WHERE positive) AS recall, (SELECT avg((score >= t)::int::double) FROM scored WHERE NOT positive) AS fpr FROM (SELECT DISTINCT score AS t FROM scored))"""


@query("agg_21_threshold_search", S + CURVE + ", w AS (SELECT max(t) FILTER (recall >= 0.9) AS warn, min(t) FILTER (fpr <= 0.05) AS hold FROM c) SELECT *, coalesce(warn <= hold, false) AS feasible FROM w")
def threshold_search(spark, d):
    return thresholds.search(scored(spark, d), positive_(), F.col("score"))


@query("agg_21_operating_curve", S + CURVE + " SELECT t, round(recall, 6) AS recall, round(fpr, 6) AS fpr FROM c")
def operating_curve(spark, d):
    return thresholds.operating_curve(scored(spark, d), positive_(), F.col("score")).withColumns({"recall": F.round("recall", 6), "fpr": F.round("fpr", 6)})


@query("agg_22_model_selection", S + f", g AS (SELECT family, avg((score >= 0.5)::int::double) FILTER (NOT positive) AS fpr, avg((pair_score >= 0.5)::int::double) FILTER (positive) AS hr FROM scored GROUP BY family) SELECT arg_min(family, (round(fpr, 6), -round(hr, 6), family)) AS selected FROM g WHERE fpr IS NOT NULL AND hr IS NOT NULL")
def model_selection(spark, d):
    s = scored(spark, d)
    g = s.groupBy("family").agg(metrics.share(F.when(~positive_(), F.col("score") >= 0.5)).alias("fpr"), metrics.share(F.when(positive_(), F.col("pair_score") >= 0.5)).alias("hr"))
    return thresholds.select_model(g, "family", "fpr", "hr")


WEIGHTS = [round(0.1 * i, 1) for i in range(1, 10)]


@query("agg_23_weight_sweep", S + f""", w AS (SELECT w, group_id, max((round(w * score + (1 - w) * pair_score, 6), positive::int)) AS m FROM scored, (SELECT unnest({WEIGHTS}::double[]) AS w) GROUP BY w, group_id),
 p AS (SELECT w, round(avg(m[2]::double), 6) AS top1 FROM w GROUP BY w) SELECT arg_max(w, (top1, -w)) AS weight, max(top1) AS top1 FROM p""")
def weight_sweep(spark, d):
    return thresholds.sweep_weights(scored(spark, d), F.col("score"), F.col("pair_score"), positive_(), "group_id", WEIGHTS)


@query("agg_24_all_complete", D + " SELECT bool_and(decision IS NOT NULL) AS complete, bool_and(score > 0.01) AS all_scored FROM dec")
def all_complete(spark, d):
    return decided(spark, d).agg(F.bool_and(F.col("decision").isNotNull()).alias("complete"), F.bool_and(F.col("score") > 0.01).alias("all_scored"))


@query("agg_25_joined_names", "SELECT r_name, string_agg(n_name, ' | ' ORDER BY n_name) AS matched FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def joined_names(spark, d):
    n = read(spark, d, "nation").join(F.broadcast(read(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), " | ").alias("matched"))


def _tree_sql(levels: int = 4, fan: int = 1024) -> str:
    out = "WITH t0 AS (SELECT lang, sha256(coalesce(text, '')) AS h, row_number() OVER (PARTITION BY lang ORDER BY sha256(coalesce(text, ''))) - 1 AS i FROM documents)"
    for k in range(levels):
        out += f", t{k + 1} AS (SELECT lang, sha256(string_agg(h, '' ORDER BY i)) AS h, i // {fan} AS i FROM t{k} GROUP BY lang, i // {fan})"
    return out + f" SELECT lang, h AS digest FROM t{levels}"


@query("agg_26_corpus_digest", _tree_sql())
def corpus_digest(spark, d):
    own = F.sha2(F.coalesce("text", F.lit("")), 256)
    return metrics.digest_tree(read(spark, d, "documents").select("lang", own.alias("h")), "lang", "h").withColumnRenamed("h", "digest")


@query("agg_27_mode_share", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, round(max(n) / sum(n)::double, 6) AS share FROM c GROUP BY user_id")
def mode_share(spark, d):
    c = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.groupBy("user_id").agg(F.round(F.max("n") / F.sum("n"), 6).alias("share"))


@query("agg_28_pitch_histogram", "SELECT user_id, (event_id % 12)::bigint AS pitch_class, round(sum(value), 4) AS weight FROM events GROUP BY ALL")
def pitch_histogram(spark, d):
    e = read(spark, d, "events")
    return e.groupBy("user_id", (F.col("event_id") % 12).alias("pitch_class")).agg(F.round(F.sum("value"), 4).alias("weight"))


@query("agg_29_first_wins_dedupe", """WITH h AS (SELECT doc_id, sha256(text) AS sha FROM documents)
 SELECT doc_id, row_number() OVER (PARTITION BY sha ORDER BY doc_id) = 1 AS kept, CASE WHEN doc_id <> min(doc_id) OVER (PARTITION BY sha) THEN min(doc_id) OVER (PARTITION BY sha) END AS duplicate_of FROM h""")
def first_wins(spark, d):
    from ..operators.matching import first_per_content

    docs = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return first_per_content(docs, "sha", "doc_id").select("doc_id", "kept", "duplicate_of")


@query("snk_07_duplicate_report", """WITH h AS (SELECT doc_id, sha256(text) AS sha, CASE WHEN doc_id % 11 > 0 THEN sha256(text) ELSE 'changed' END AS now FROM documents WHERE text IS NOT NULL), k AS (SELECT sha FROM h WHERE doc_id % 17 = 0),
 f AS (SELECT * FROM h WHERE doc_id % 17 <> 0), w AS (SELECT *, sha IN (SELECT sha FROM k) AS used, min(doc_id) OVER (PARTITION BY sha) AS first FROM f)
 SELECT doc_id, sha, CASE WHEN used THEN 'already_used_or_original_exact_duplicate' ELSE 'internal_exact_duplicate' END AS reason, CASE WHEN NOT used THEN first END AS duplicate_of, now = sha AS still_equal FROM w WHERE used OR doc_id <> first""")
def duplicate_report(spark, d):
    from ..operators.matching import duplicate_report as report

    h = read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("sha"))
    now = h.withColumn("sha", F.when(F.col("doc_id") % 11 > 0, F.col("sha")).otherwise("changed"))
    return report(h.filter("doc_id % 17 <> 0"), h.filter("doc_id % 17 = 0"), now, "doc_id", "sha")


@query("agg_30_latest_per_key", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_per_key(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))


@query("agg_31_searchable_records", "SELECT count(*) AS records, count(*) FILTER (len(string_split(text, ' ')) >= 10) AS searchable, count(*) FILTER (len(string_split(text, ' ')) >= 10) > 0 AS ready FROM documents")
def searchable(spark, d):
    ok = F.count_if(F.size(F.split("text", " ")) >= 10)
    return read(spark, d, "documents").agg(F.count("*").alias("records"), ok.alias("searchable"), (ok > 0).alias("ready"))


@query("agg_32_feature_diagnostics", S + f""", m AS (SELECT unnest(['score', 'pair_score', 'length']) AS feature, unnest([score, pair_score, n_chars::double]) AS value, positive FROM scored),
 r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::double AS rk FROM m)
 SELECT feature, {_AUC} AS auc, round(quantile_cont(value, 0.5) FILTER (positive), 6) AS positive_median, round(quantile_cont(value, 0.5) FILTER (NOT positive), 6) AS safe_median FROM r GROUP BY feature""")
def feature_diagnostics(spark, d):
    m = scored(spark, d).withColumn("length", F.col("n_chars").cast("double")).unpivot(["positive"], ["score", "pair_score", "length"], "feature", "value")
    mid = lambda c: F.round(F.percentile(F.when(c, F.col("value")), F.lit(0.5)), 6)
    g = m.groupBy("feature").agg(mid(positive_()).alias("positive_median"), mid(~positive_()).alias("safe_median"))
    return metrics.auc(m, positive_(), F.col("value"), "feature").join(g, "feature")


@query("agg_35_two_class_points", S + " SELECT family, count(*) FILTER (positive) AS positives, count(*) FILTER (NOT positive) AS safes, round(avg((score >= 0.35)::int::double) FILTER (positive), 6) AS recall, round(avg((score >= 0.35)::int::double) FILTER (NOT positive), 6) AS fpr FROM scored GROUP BY family")
def two_class(spark, d):
    hit = F.col("score") >= WARN
    return scored(spark, d).groupBy("family").agg(F.count_if(positive_()).alias("positives"), F.count_if(~positive_()).alias("safes"), metrics.share(F.when(positive_(), hit)).alias("recall"), metrics.share(F.when(~positive_(), hit)).alias("fpr"))


@query("agg_36_run_summary", D + " SELECT count(*) FILTER (positive) AS positives, count(*) FILTER (NOT positive) AS safes, count(*) FILTER (positive AND decision IN ('WARN', 'HOLD')) AS positive_flagged, count(*) FILTER (NOT positive AND decision IN ('WARN', 'HOLD')) AS safe_flagged, count(*) FILTER (decision = 'BLOCK') AS blocked FROM dec")
def run_summary(spark, d):
    flagged = F.col("decision").isin("WARN", "HOLD")
    return decided(spark, d).agg(F.count_if(positive_()).alias("positives"), F.count_if(~positive_()).alias("safes"), F.count_if(positive_() & flagged).alias("positive_flagged"), F.count_if(~positive_() & flagged).alias("safe_flagged"), F.count_if(F.col("decision") == "BLOCK").alias("blocked"))
