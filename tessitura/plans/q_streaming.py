"""Streaming operators, run to completion with availableNow, and round trips of readers and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..scratch import scratch_path as scratch
from ..sources import readers, sinks
from ..sources.npz import NpzSource
from ..sources.report import ReportSource, append_report
from ..streaming import gate, jobs
from .base import SCORED_SQL, query, read, scored

S = "WITH " + SCORED_SQL


def uploads(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("fingerprint"), F.col("doc_id").alias("seq"))


@query("str_04_upload_gate", "SELECT doc_id AS id, CASE WHEN doc_id = min(doc_id) OVER w THEN 'ACCEPTED' ELSE 'REJECTED' END AS status, CASE WHEN doc_id <> min(doc_id) OVER w THEN min(doc_id) OVER w END AS duplicate_of FROM documents WINDOW w AS (PARTITION BY text)")
def upload_gate(spark, d):
    """Uploads arrive in three parts; the gate is stopped after each and goes on from its checkpoint."""
    base = scratch(spark, "gate")
    src = uploads(spark, d)

    def run(part):
        stream = spark.readStream.schema(src.schema).parquet(f"{base}/in")
        jobs.run_gate(stream, f"{base}/log", f"{base}/checkpoint").awaitTermination()

    jobs.in_parts(src, "id", 3, f"{base}/in", run)
    return spark.read.parquet(f"{base}/log").select("id", "status", "duplicate_of")


def job_log(spark, d):
    names = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(("PENDING", "RUNNING", "SUCCEEDED", "FAILED")) for x in (i, s)]), (F.col("event_id") % 4).cast("int"))
    return read(spark, d, "events").select(F.col("user_id").alias("job_id"), names.alias("state"), F.col("event_id").alias("seq"))


@query("str_02_job_states", """WITH RECURSIVE e AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_id % 4 AS s FROM events),
 r AS (SELECT DISTINCT job_id, 0::bigint AS i, -1::bigint AS s, 0::bigint AS ignored FROM e
  UNION ALL SELECT r.job_id, e.i, CASE WHEN ok THEN e.s ELSE r.s END, r.ignored + CASE WHEN ok THEN 0 ELSE 1 END FROM r JOIN e ON e.job_id = r.job_id AND e.i = r.i + 1, LATERAL (SELECT (r.s, e.s) IN ((-1, 0), (0, 1), (0, 3), (1, 2), (1, 3)) AS ok)),
 l AS (SELECT job_id, arg_max(s, i) AS s, arg_max(ignored, i) AS ignored FROM r GROUP BY job_id)
 SELECT job_id, CASE WHEN s IN (0, 1, 3) THEN 'FAILED' WHEN s = 2 THEN 'SUCCEEDED' END AS state, ignored FROM l""")
def job_states(spark, d):
    """Events arrive in three parts, and the machine goes on from its checkpoint after each; then the process is started
    anew, which fails the jobs that aren't done."""
    base = scratch(spark, "jobs")
    log = job_log(spark, d)

    def run(part=None):
        jobs.run_jobs(spark.readStream.schema(log.schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/checkpoint").awaitTermination()

    jobs.in_parts(log, "seq", 3, f"{base}/in", run)
    live = jobs.job_table(spark, f"{base}/out").filter("state IN ('PENDING', 'RUNNING')")
    live.select("job_id", F.lit(jobs.RESTART).alias("state"), F.lit(0).cast("long").alias("seq")).write.mode("append").parquet(f"{base}/in")
    run()
    return jobs.job_table(spark, f"{base}/out").select("job_id", "state", "ignored")


def arrivals(spark, d):
    """Jobs of each user's queue, in microseconds; they take so long that queues fill."""
    takes = (F.round(F.col("value") * 100) * 9_000_000).cast("long")
    return read(spark, d, "events").select("event_id", F.col("user_id").alias("queue"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("at"), takes.alias("takes"))


@query("str_03_admission", """WITH RECURSIVE a AS (SELECT event_id, user_id AS queue, epoch_us(ts) AS at, (round(value * 100) * 9000000)::bigint AS takes, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 r AS (SELECT DISTINCT queue, 0::bigint AS i, NULL::bigint AS event_id, []::bigint[] AS ends, 0 AS active, 0 AS status FROM a
  UNION ALL SELECT a.queue, a.i, a.event_id, CASE WHEN len(e) < 8 THEN list_append(e, greatest(a.at, coalesce(list_last(e), a.at)) + a.takes) ELSE e END, len(e)::int, CASE WHEN len(e) < 8 THEN 202 ELSE 429 END
  FROM r JOIN a ON a.queue = r.queue AND a.i = r.i + 1, LATERAL (SELECT list_filter(r.ends, lambda x: x > a.at) AS e))
 SELECT event_id, queue, active, status, CASE WHEN status = 202 THEN list_last(ends) END AS ends FROM r WHERE i > 0""")
def admission(spark, d):
    return jobs.admissions(arrivals(spark, d), job="event_id").select("event_id", "queue", "active", "status", "ends")


@query("str_07_resumable", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def resumable(spark, d):
    base = scratch(spark, "resume")
    src = read(spark, d, "events").select("event_id", "user_id", "value")
    work = lambda s: s.withColumn("scored", F.round(F.col("value") * 2, 6))
    for part in range(2):
        src.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{base}/in")
        gate.resume(spark, f"{base}/in", src.schema, f"{base}/out", f"{base}/checkpoint", work)
    return spark.read.parquet(f"{base}/out").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("str_01_event_windows", """WITH m AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 5 MINUTE, ts), time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE]) AS start FROM events)
 SELECT start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM m GROUP BY ALL""")
def event_windows(spark, d):
    g = gate.event_windows(read(spark, d, "events"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


@query("src_03_snk_01_csv_round_trip", S + " SELECT group_id, count(*) AS n, round(max(score), 4) AS top FROM scored GROUP BY group_id")
def csv_round_trip(spark, d):
    base = scratch(spark, "csv")
    m = scored(spark, d).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "score"))).alias("matches"))
    sinks.csv_report(m, base)
    back = readers.csv_table(spark, base, "group_id string, matches string").withColumn("m", F.from_json("matches", "array<struct<doc_id:long,score:double>>"))
    return back.select("group_id", F.size("m").cast("long").alias("n"), F.round(F.array_max(F.transform("m", lambda x: x["score"])), 4).alias("top"))


@query("src_04_snk_04_resumable_jsonl", "WITH h AS (SELECT sha256(text) AS sha, doc_id FROM documents WHERE text IS NOT NULL) SELECT sha, coalesce(min(doc_id) FILTER (doc_id % 2 = 0), min(doc_id)) AS doc_id FROM h GROUP BY sha")
def resumable_jsonl(spark, d):
    base = scratch(spark, "jsonl")
    rows = read(spark, d, "documents").filter("text IS NOT NULL").select(F.sha2("text", 256).alias("sha"), "doc_id")
    sinks.append_new(rows.filter("doc_id % 2 = 0"), base, "sha", "doc_id")
    sinks.append_new(rows, base, "sha", "doc_id")
    sinks.append_new(rows, base, "sha", "doc_id")
    return readers.jsonl_table(spark, base, "sha string, doc_id long")


@query("src_05_json_registry", "SELECT n_name AS track_id, n_nationkey::double AS duration FROM nation")
def json_registry(spark, d):
    base = scratch(spark, "registry")
    n = read(spark, d, "nation").select(F.struct("n_name", F.struct(F.col("n_nationkey").cast("double").alias("duration"))).alias("e"))
    n.agg(F.to_json(F.map_from_entries(F.collect_list("e"))).alias("value")).coalesce(1).write.text(base)
    return readers.json_registry(spark, base, "struct<duration:double>")


@query("src_06_snk_05_catalog", "SELECT label::bigint AS track_id, vec_id FROM embeddings")
def catalog(spark, d):
    base = scratch(spark, "catalog")
    e = read(spark, d, "embeddings").select(F.col("label").cast("long").alias("track_id"), "vec_id")
    sinks.replace_table(e.limit(5), base)
    sinks.replace_table(e, base)
    return readers.catalog(spark, sinks.current(spark, base), e.select("track_id").distinct())


@query("src_06_npz_catalog", "SELECT vec_id, label::bigint AS track_id, len(embedding) AS dims, round(embedding[1]::double, 6) AS first, round(embedding[-1]::double, 6) AS last FROM embeddings")
def npz_catalog(spark, d):
    """Vectors written as NumPy archives and read again by stretches of rows."""
    spark.dataSource.register(NpzSource)
    base = scratch(spark, "npz")
    e = read(spark, d, "embeddings").select(F.col("label").cast("long").alias("track_id"), "vec_id", F.col("embedding").cast("array<float>").alias("vectors"))
    e.write.format("npz").mode("append").save(base)
    back = readers.catalog(spark, base, e.select("track_id").distinct(), kind="npz")
    at = lambda i: F.round(F.element_at("vectors", i).cast("double"), 6)
    return back.select("vec_id", "track_id", F.size("vectors").cast("long").alias("dims"), at(1).alias("first"), at(-1).alias("last"))


@query("snk_01_report", S + " SELECT group_id, count(*) AS n, round(max(score), 4) AS top FROM scored GROUP BY group_id")
def report(spark, d):
    """A report of one file with a byte order mark and one header, appended to once, read again."""
    spark.dataSource.register(ReportSource)
    path = scratch(spark, "report.csv")
    m = scored(spark, d).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "score"))).alias("matches"))
    part = F.pmod(F.xxhash64("group_id"), F.lit(2))
    m.filter(part == 0).write.format("report").mode("overwrite").save(path)
    append_report(m.filter(part == 1), path, "group_id")
    back = readers.csv_table(spark, path, "group_id string, matches string").withColumn("m", F.from_json("matches", "array<struct<doc_id:long,score:double>>"))
    return back.select("group_id", F.size("m").cast("long").alias("n"), F.round(F.array_max(F.transform("m", lambda x: x["score"])), 4).alias("top"))


@query("snk_03_keyed_cache", "SELECT s_suppkey, s_suppkey * 2 AS feature FROM supplier")
def keyed_cache(spark, d):
    base = scratch(spark, "cache")
    keys = read(spark, d, "supplier").select("s_suppkey", sinks.cache_key(F.col("s_name"), F.col("s_acctbal")).alias("cache_key"))
    work = lambda df: df.withColumn("feature", F.col("s_suppkey") * 2)
    sinks.cached(keys.filter("s_suppkey % 2 = 0"), base, work)
    return sinks.cached(keys.union(keys), base, work).select("s_suppkey", "feature")


@query("src_10_fingerprint_checks", "SELECT CASE WHEN n_chars % 30 < 10 THEN 'TOO_SHORT' WHEN doc_id % 7 = 0 THEN 'NOT_UINT32' END AS reject, count(*) AS n FROM documents GROUP BY 1")
def fingerprint_checks(spark, d):
    raw = F.array(F.lit(4294967295), F.col("doc_id"), F.when(F.col("doc_id") % 7 == 0, F.lit(4294967296)).otherwise(F.lit(1).cast("long")))
    rows = read(spark, d, "documents").select(raw.alias("fingerprint_raw"), (F.col("n_chars") % 30).alias("duration"))
    return readers.fingerprints(rows).groupBy("reject").agg(F.count("*").alias("n"))


@query("src_12_latest_jobs", "SELECT user_id AS job_id, max(event_id) AS seq, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY user_id")
def latest_jobs(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    last = readers.latest_jobs(e).select("job_id", "state")
    return last.join(e.groupBy("job_id").agg(F.max("seq").alias("seq")), "job_id").select("job_id", "seq", "state")


@query("src_01_file_listing")
def file_listing(spark, d):
    return readers.audio_files(spark, d, [".parquet", ".PARQUET"]).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")


@query("src_02_flat_listing")
def flat_listing(spark, d):
    return readers.audio_files(spark, f"{d}/nation.parquet", [".parquet"], recursive=False).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")


@query("snk_02_json_summary", S + " SELECT count(*) FILTER (positive AND score >= 0.5) AS tp, count(*) FILTER (NOT positive AND score >= 0.5) AS fp FROM scored")
def json_summary(spark, d):
    base = scratch(spark, "summary")
    hit = F.col("score") >= 0.5
    sinks.json_summary(scored(spark, d).agg(F.count_if(F.col("positive") & hit).alias("tp"), F.count_if(~F.col("positive") & hit).alias("fp")), base)
    return spark.read.schema("tp long, fp long").json(base)


@query("snk_06_append_manifest", "SELECT n_name AS name, n_nationkey AS pos FROM nation")
def append_manifest(spark, d):
    base = scratch(spark, "manifest")
    n = read(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("pos"))
    for part in range(2):
        append_report(n.filter(F.col("pos") % 2 == part), f"{base}/manifest.csv", "name")
    return readers.csv_table(spark, f"{base}/manifest.csv", "name string, pos int")


@query("snk_08_model_table", S + " SELECT doc_id, round(1 / (1 + exp(-(-0.4::double + (score - 0.5) / 0.25 * 1.2))), 6) AS probability FROM scored")
def model_table(spark, d):
    from ..functions.scalars import linear_score

    base = scratch(spark, "model")
    sinks.save_model(spark, {"mean": [0.5], "std": [0.25], "weights": [1.2], "bias": -0.4}, base)
    m = sinks.load_model(spark, base)
    return scored(spark, d).select("doc_id", F.round(linear_score(F.array("score"), m["mean"], m["std"], m["weights"], m["bias"]), 6).alias("probability"))
