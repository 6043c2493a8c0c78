"""Filters, joins, ordered selection and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import matching, policy, sampling
from .base import SCORED_SQL, query, read, scored
from .q_metrics import D, decided

S = "WITH " + SCORED_SQL

# --- filters and projections ---------------------------------------------------------------------

_PATH = "'/in/' || l_orderkey || '_' || l_linenumber || CASE l_linenumber % 4 WHEN 0 THEN '.MP3' WHEN 1 THEN '.wav' WHEN 2 THEN '.txt' ELSE '.webM' END"


def uploads(spark, d):
    n = F.col("l_linenumber") % 4
    ext = F.when(n == 0, ".MP3").when(n == 1, ".wav").when(n == 2, ".txt").otherwise(".webM")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                             F.concat(F.lit("/in/"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"), ext).alias("path"))


@query("flt_01_suffix_whitelist", f"SELECT {_PATH} AS path FROM lineitem WHERE l_linenumber % 4 IN (0, 1, 3)")
def suffix_whitelist(spark, d):
    return uploads(spark, d).filter(policy.suffix(F.col("path")).isin(policy.SUFFIXES)).select("path")


@query("flt_02_reject_codes", f"""WITH u AS (SELECT {_PATH} AS path, l_linenumber % 4 AS n, (l_extendedprice * 10000)::bigint - 9300000 AS b, l_quantity * 40 AS s FROM lineitem)
 SELECT CASE WHEN n = 2 THEN 'UNSUPPORTED_TYPE' WHEN b <= 0 THEN 'EMPTY' WHEN b > 262144000 THEN 'TOO_LARGE' WHEN s < 10 THEN 'TOO_SHORT' WHEN s > 1800 THEN 'TOO_LONG' END AS code, count(*) AS n FROM u GROUP BY 1""")
def reject_codes(spark, d):
    n_bytes = F.round(F.col("l_extendedprice") * 10000).cast("long") - 9300000
    return uploads(spark, d).select(policy.reject_code(F.col("path"), n_bytes, F.col("l_quantity") * 40).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("flt_03_split_predicates", S + " SELECT doc_id, family, score FROM scored WHERE positive AND family = 'en' AND score >= 0.5")
def split_predicates(spark, d):
    return scored(spark, d).filter("positive AND family = 'en' AND score >= 0.5").select("doc_id", "family", "score")


@query("flt_04_path_exists", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def path_exists(spark, d):
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("flt_05_hard_negatives", D + " SELECT doc_id, decision FROM dec WHERE NOT positive AND decision IN ('WARN', 'HOLD')")
def hard_negatives(spark, d):
    return decided(spark, d).filter(~F.col("positive") & F.col("decision").isin("WARN", "HOLD")).select("doc_id", "decision")


@query("flt_06_families", "SELECT CASE WHEN event_type IN ('click', 'view') THEN 'browse' WHEN contains(event_type, 'pur') THEN 'buy' WHEN event_id % 3 = 0 THEN 'third' ELSE 'other' END AS family, count(*) AS n FROM events GROUP BY 1")
def families(spark, d):
    e = F.col("event_type")
    f = F.when(e.isin("click", "view"), "browse").when(e.contains("pur"), "buy").when(F.col("event_id") % 3 == 0, "third").otherwise("other")
    return read(spark, d, "events").groupBy(f.alias("family")).agg(F.count("*").alias("n"))


@query("flt_07_registered_guard", "SELECT count(*) AS already_registered, count(*) > 0 AS refused FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def registered_guard(spark, d):
    known = read(spark, d, "labels").filter("toxic = 1").select("doc_id")
    n = F.count("*")
    return read(spark, d, "documents").select("doc_id").join(known, "doc_id", "left_semi").agg(n.alias("already_registered"), (n > 0).alias("refused"))


@query("flt_08_decision", D + " SELECT doc_id, decision FROM dec")
def decision(spark, d):
    return decided(spark, d).select("doc_id", "decision")


@query("flt_09_registration_policy", D + " SELECT decision, decision <> 'BLOCK' AS issue_signature, decision <> 'BLOCK' AS allow_register, decision = 'HOLD' AS is_hold, count(*) AS n FROM dec GROUP BY ALL")
def registration_policy(spark, d):
    flags = decided(spark, d).select("decision", policy.registration(F.col("decision")).alias("p")).select("decision", "p.*")
    return flags.groupBy(*flags.columns).agg(F.count("*").alias("n"))


@query("flt_10_registration_payload", D + " SELECT doc_id AS trackId, sha256(family || doc_id) AS audioHash, 'v1' AS policyVersion, score AS similarityScore, decision = 'HOLD' AS isHold FROM dec WHERE decision <> 'BLOCK'")
def registration_payload(spark, d):
    h = F.sha2(F.concat("family", F.col("doc_id").cast("string")), 256)
    return decided(spark, d).filter("decision <> 'BLOCK'").select(F.col("doc_id").alias("trackId"), h.alias("audioHash"), F.lit("v1").alias("policyVersion"), F.col("score").alias("similarityScore"), policy.registration(F.col("decision"))["is_hold"].alias("isHold"))


@query("flt_11_public_projection", "SELECT event_id AS eventId, user_id AS userId, json_extract(props, '$.k')::bigint AS k FROM events")
def public_projection(spark, d):
    return read(spark, d, "events").select(F.col("event_id").alias("eventId"), F.col("user_id").alias("userId"), F.from_json("props", "k long")["k"].alias("k"))


@query("flt_12_one_variant_per_source", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1 ORDER BY doc_id LIMIT 10")
def one_variant(spark, d):
    return matching.first_per_key(read(spark, d, "documents").select("source", "doc_id"), "source", F.asc("doc_id")).orderBy("doc_id").limit(10)


_TOP3 = """m AS (SELECT group_id, family, score, doc_id, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, doc_id)::bigint AS rank FROM scored WHERE NOT positive)"""


def matches(spark, d):
    """Of each group the 20 best, as an array: ranked with a limit first, so no group is gathered whole."""
    s = scored(spark, d).filter("NOT positive")
    order = Window.partitionBy("group_id").orderBy(F.desc("score"), "doc_id")
    top = s.withColumn("rn", F.row_number().over(order)).filter("rn <= 20")
    return top.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("m"), "doc_id", "family"))).alias("top_matches"))


@query("flt_13_unnest_matches", S + ", " + _TOP3 + " SELECT group_id, doc_id, score, rank, score * 100 AS start_s, score * 100 + 10 AS end_s FROM m WHERE rank <= 20 AND score >= 0.5")
def unnest_matches(spark, d):
    m = matches(spark, d).select("group_id", F.posexplode("top_matches").alias("pos", "x"))
    m = m.select("group_id", F.col("x.doc_id").alias("doc_id"), (-F.col("x.m")).alias("score"), (F.col("pos") + 1).cast("long").alias("rank"))
    return m.filter("score >= 0.5").withColumns({"start_s": F.col("score") * 100, "end_s": F.col("score") * 100 + 10})


@query("src_07_json_column", "SELECT user_id, sum(json_extract(props, '$.k')::bigint)::bigint AS total, count(*) AS n FROM events GROUP BY user_id")
def json_column(spark, d):
    e = read(spark, d, "events").withColumn("k", F.from_json("props", "k long")["k"])
    return e.groupBy("user_id").agg(F.sum("k").cast("long").alias("total"), F.count("*").alias("n"))


@query("jsn_01_json_round_trip", S + ", " + _TOP3 + " SELECT group_id, rank, doc_id, family FROM m WHERE rank <= 20")
def json_round_trip(spark, d):
    m = matches(spark, d).withColumn("j", F.to_json("top_matches"))
    back = m.select("group_id", F.posexplode(F.from_json("j", "array<struct<m:double,doc_id:long,family:string>>")).alias("pos", "x"))
    return back.select("group_id", (F.col("pos") + 1).cast("long").alias("rank"), F.col("x.doc_id").alias("doc_id"), F.col("x.family").alias("family"))


@query("flt_14_error_rows", r"SELECT CASE WHEN length(regexp_extract(coalesce(text, ''), '\d+')) BETWEEN 1 AND 6 THEN NULL ELSE 'NO_NUMBER' END AS error, count(*) AS n FROM documents GROUP BY 1")
def error_rows(spark, d):
    """Rows whose kernel failed are counted by message and never pass."""
    doc = read(spark, d, "documents").select("doc_id", F.try_to_number(F.regexp_extract("text", r"([0-9]+)", 1), F.lit("999999")).alias("value"))
    out = doc.withColumn("error", F.when(F.col("value").isNull(), "NO_NUMBER"))
    return out.groupBy("error").agg(F.count("*").alias("n"))


# --- joins ---------------------------------------------------------------------------------------



def token_runs(spark, d):
    b = read(spark, d, "benchmark").select(F.col("item_id").alias("needle_id"), F.split("text", " ").alias("needle"))
    h = read(spark, d, "documents").select(F.col("doc_id").alias("hay_id"), F.split("text", " ").alias("hay"))
    return b, h


_RUNS = "hit AS (SELECT b.item_id AS needle_id, d.doc_id AS hay_id FROM benchmark b JOIN documents d ON contains(' ' || d.text || ' ', ' ' || b.text || ' '))"


@query("jn_02_contained_runs", f"WITH {_RUNS} SELECT * FROM hit")
def contained_runs(spark, d):
    return matching.contained(*token_runs(spark, d))


@query("jn_02_first_match", f"WITH {_RUNS} SELECT needle_id, arg_min(hay_id, (hay_id * 7919 % 10007, hay_id)) AS hay_id FROM hit GROUP BY needle_id")
def first_match(spark, d):
    b, h = token_runs(spark, d)
    pos = h.select("hay_id", F.struct((F.col("hay_id") * 7919 % 10007).alias("p"), "hay_id").alias("pos"))
    return matching.first_match(matching.contained(b, h), pos)


@query("jn_03_band_join", """SELECT a.doc_id, b.doc_id AS r_doc_id FROM documents a LEFT JOIN documents b ON sha256(a.text) = sha256(b.text) AND abs(a.n_chars % 50 - b.n_chars % 50 + (a.doc_id % 3) - (b.doc_id % 3)) <= 1""")
def band(spark, d):
    f = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("fp"), (F.col("n_chars") % 50 + F.col("doc_id") % 3).alias("dur"))
    return matching.band_join(f, f, "fp", "dur", 1).select("doc_id", "r_doc_id")


@query("jn_04_exclude_training", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def exclude_training(spark, d):
    return read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels"), "doc_id", "left_anti")


@query("jn_05_exclude_known_hashes", "SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def exclude_known(spark, d):
    h = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return h.join(h.filter("doc_id % 2 = 0").select("sha"), "sha", "left_anti").select("doc_id")


@query("jn_06_reported_clean", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0 AND quality = 1)")
def reported_clean(spark, d):
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").filter("toxic = 0 AND quality = 1"), "doc_id", "left_semi")


@query("jn_07_source_priority", """WITH u AS (SELECT c_custkey AS id, c_name AS name, 1::bigint AS priority FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT s_suppkey, s_name, 2 FROM supplier UNION ALL SELECT n_nationkey, n_name, 3 FROM nation)
 SELECT id, arg_min(name, priority) AS name, min(priority) AS priority FROM u GROUP BY id""")
def source_priority(spark, d):
    pick = lambda t, i, n: read(spark, d, t).select(F.col(i).cast("long").alias("id"), F.col(n).alias("name"))
    return matching.by_priority("id", pick("customer", "c_custkey", "c_name").filter("id % 2 = 0"), pick("supplier", "s_suppkey", "s_name"), pick("nation", "n_nationkey", "n_name"))


@query("jn_08_lookup", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def lookup(spark, d):
    c, n, r = (read(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left").join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left").select("c_custkey", "n_name", "r_name")


@query("jn_09_top1_candidate", "WITH t AS (SELECT l_orderkey, arg_min(l_partkey, (-l_extendedprice, l_partkey)) AS l_partkey FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey, l_partkey FROM orders JOIN t ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def top1_candidate(spark, d):
    t = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct("l_extendedprice", -F.col("l_partkey"))).alias("l_partkey"))
    o = read(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    return o.join(t, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_partkey")


@query("jn_10_family_by_basename", """WITH m(name, family, pos) AS (SELECT 'f' || (n_nationkey % 20) || '.wav', 'fam' || n_nationkey, n_nationkey FROM nation), l AS (SELECT name, arg_max(family, pos) AS family FROM m GROUP BY name)
 SELECT s_suppkey, coalesce(family, 'unknown') AS family FROM supplier LEFT JOIN l ON 'f' || (s_suppkey % 25) || '.wav' = name""")
def family_by_basename(spark, d):
    n = read(spark, d, "nation")
    m = n.select(F.concat(F.lit("f"), (F.col("n_nationkey") % 20).cast("string"), F.lit(".wav")).alias("name"), F.concat(F.lit("fam"), F.col("n_nationkey").cast("string")).alias("family"), "n_nationkey")
    last = m.groupBy("name").agg(F.max_by("family", "n_nationkey").alias("family"))
    path = F.concat(F.lit("C:\\data\\x/"), F.lit("f"), (F.col("s_suppkey") % 25).cast("string"), F.lit(".wav"))
    s = read(spark, d, "supplier").select("s_suppkey", F.element_at(F.split(path, r"[\\/]"), -1).alias("name"))
    return s.join(F.broadcast(last), "name", "left").select("s_suppkey", F.coalesce("family", F.lit("unknown")).alias("family"))


@query("jn_12_first_of_pool", """WITH p AS (SELECT source AS name, min(doc_id) AS doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source)
 SELECT name, doc_id FROM p ORDER BY sha256(name), name LIMIT 8""")
def first_of_pool(spark, d):
    pool = read(spark, d, "documents").select(F.col("source").alias("name"), "doc_id").join(read(spark, d, "labels"), "doc_id", "left_anti")
    return sampling.first_by_hash(matching.first_per_key(pool.select("name", "doc_id"), "name", F.asc("doc_id")), F.col("name"), 8, "name")


@query("jn_13_idempotency", """WITH k AS (SELECT c_custkey AS request_key, c_mktsegment AS payload FROM customer WHERE c_custkey % 3 = 0), r AS (SELECT c_custkey AS request_key, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'OTHER' END AS payload FROM customer)
 SELECT r.request_key, CASE WHEN k.request_key IS NULL THEN 'NEW' WHEN r.payload = k.payload THEN 'EXISTING' ELSE 'REQUEST_ID_CONFLICT' END AS admission FROM r LEFT JOIN k USING (request_key)""")
def idempotency(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("request_key"), F.col("c_mktsegment").alias("payload"))
    r = c.withColumn("payload", F.when(F.col("request_key") % 2 == 0, F.col("payload")).otherwise("OTHER"))
    return policy.admit(r, c.filter("request_key % 3 = 0")).select("request_key", "admission")


@query("jn_14_frozen_config", "SELECT sha256(string_agg(r_name, ',' ORDER BY r_name)) AS digest, count(*) = 5 AS unchanged FROM region")
def frozen_config(spark, d):
    g = read(spark, d, "region").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("r_name")), ","), 256).alias("digest"), F.count("*").alias("n"))
    return g.select("digest", (F.col("n") == 5).alias("unchanged"))


@query("jn_17_registry_merge", """SELECT coalesce(s_suppkey, c_custkey) AS id, coalesce(s_name, c_name) AS name, CASE WHEN c_custkey IS NULL THEN 'inserted' WHEN s_suppkey IS NULL THEN 'retained' ELSE 'updated' END AS state
 FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) FULL JOIN supplier ON c_custkey = s_suppkey""")
def registry_merge(spark, d):
    old = read(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return matching.merge_registry(old, new, "id", ["name"])


# --- ordered selection -----------------------------------------------------------------------------

_REG = "e AS (SELECT user_id, event_id, ts, value, value - lag(value) OVER w AS delta, lead(value) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query("win_05_step_validity", f"WITH {_REG} SELECT event_id, round(delta, 6) AS delta, coalesce(abs(delta - 5) <= 0.51, false) AS regular FROM e")
def step_validity(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    delta = F.col("value") - F.lag("value").over(w)
    return read(spark, d, "events").withColumn("d", delta).select("event_id", F.round("d", 6).alias("delta"), F.coalesce(F.abs(F.col("d") - 5) <= 0.51, F.lit(False)).alias("regular"))


@query("win_06_ordered_chain", """WITH o AS (SELECT user_id, ts, event_id, value, CASE WHEN value >= lag(value) OVER w THEN 0 ELSE 1 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 i AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM o), c AS (SELECT user_id, isl, count(*) AS n FROM i GROUP BY ALL)
 SELECT user_id, max(n) AS longest, round((sum(n) - count(*)) / greatest(1, sum(n) - 1)::double, 6) AS ordered_fraction FROM c GROUP BY user_id""")
def ordered_chain(spark, d):
    from ..operators import temporal

    e = read(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "value")
    return temporal.chains(e, "user_id", "at", "value")


@query("win_07_hash_split", """WITH h AS (SELECT doc_id, source, row_number() OVER (ORDER BY ('0x' || substr(sha256(doc_id::varchar), 1, 12))::bigint, doc_id) AS rn, count(*) OVER () AS n FROM documents)
 SELECT doc_id, CASE WHEN rn <= floor(n * 0.6) THEN 'train' WHEN rn <= floor(n * 0.8) THEN 'validation' ELSE 'test' END AS split FROM h""")
def hash_split(spark, d):
    return sampling.hash_split(read(spark, d, "documents").select("doc_id"), F.col("doc_id").cast("string"), {"train": 0.6, "validation": 0.2, "test": 0.2}, "doc_id").select("doc_id", "split")


@query("win_08_stratified_first_n", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::varchar), doc_id) AS rn FROM documents) WHERE rn <= CASE lang WHEN 'en' THEN 12 WHEN 'de' THEN 8 ELSE 10 END")
def stratified(spark, d):
    return sampling.stratified(read(spark, d, "documents").select("lang", "doc_id"), "lang", F.col("doc_id").cast("string"), {"en": 12, "de": 8}, 10, "doc_id")


# What Python's seeded generator deals of the twenty sources to "tune" (seed 20260930), and draws (seed 7).
_TUNE = ["src1", "src6", "src7", "src8", "src10", "src11", "src12", "src13", "src14", "src16", "src18", "src19"]
_DRAWN = ["src1", "src2", "src10", "src12", "src18"]


@query("win_09_group_shuffle_split", f"SELECT doc_id, source, CASE WHEN source IN {tuple(_TUNE)} THEN 'tune' ELSE 'test' END AS split FROM documents")
def group_shuffle(spark, d):
    return sampling.group_shuffle_split(read(spark, d, "documents").select("doc_id", "source"), "source", 20260930, {"tune": 0.6, "test": 0.4})


@query("win_10_first_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def first_key(spark, d):
    return matching.first_per_key(read(spark, d, "events"), "user_id", F.asc("ts"), F.asc("event_id")).select("user_id", "event_id", "event_type")


@query("srt_01_global_sort", "SELECT n_name, row_number() OVER (ORDER BY n_name)::bigint AS pos FROM nation")
def global_sort(spark, d):
    return sampling.numbered(read(spark, d, "nation").select("n_name"), F.asc("n_name")).select("n_name", F.col("_pos").alias("pos"))


@query("srt_02_shard_slice", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 75 OFFSET 75")
def shard_slice(spark, d):
    return sampling.ordered_slice(read(spark, d, "documents").select("doc_id"), "doc_id", 75, 150)


@query("srt_03_seeded_sample", f"SELECT DISTINCT source FROM documents WHERE source IN {tuple(_DRAWN)}")
def seeded_sample(spark, d):
    return sampling.seeded_sample(read(spark, d, "documents").select("source").distinct(), "source", 7, 5)


@query("set_01_union_all", "SELECT c_custkey AS id, 'customer' AS dataset, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, 'supplier', NULL FROM supplier")
def union_all(spark, d):
    a = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("dataset"), F.col("c_mktsegment").alias("segment"))
    b = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("dataset"))
    return a.unionByName(b, allowMissingColumns=True)


@query("set_02_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT s_suppkey FROM supplier")
def difference(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id")).distinct().join(read(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), "id", "left_anti")


@query("set_03_union", "SELECT c_nationkey::bigint AS id FROM customer UNION SELECT s_nationkey FROM supplier")
def union(spark, d):
    return read(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("id")).union(read(spark, d, "supplier").select(F.col("s_nationkey").cast("long"))).distinct()


@query("set_04_candidate_thresholds", S + " SELECT score AS t FROM scored WHERE positive UNION SELECT score FROM scored WHERE NOT positive")
def candidate_thresholds(spark, d):
    s = scored(spark, d)
    return s.filter("positive").select(F.col("score").alias("t")).union(s.filter("NOT positive").select("score")).distinct()


@query("set_05_equal_sets", "WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer), b AS (SELECT n_nationkey AS k FROM nation) SELECT (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) = 0 AND (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) = 0 AS equal")
def equal_sets(spark, d):
    return matching.same_ids(read(spark, d, "customer").select(F.col("c_nationkey").alias("k")), read(spark, d, "nation").select(F.col("n_nationkey").alias("k")), "k")


@query("set_06_equal_sequences", "SELECT bool_and(a.c_name IS NOT DISTINCT FROM b.c_name) AND count(*) = (SELECT count(*) FROM customer) AS in_sync FROM customer a JOIN customer b USING (c_custkey)")
def equal_sequences(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_name")
    return matching.same_sequence(c, c, "c_custkey", "c_name")
