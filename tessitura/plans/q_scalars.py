"""Scalar, array and signal-free functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import temporal, vectors
from ..operators.bits import bound
from .base import SCORED_SQL, WIN_SQL, MEAN_SQL, query, read, scored, windows

S = "WITH " + SCORED_SQL
_LONG = "unnest(v) AS x, generate_subscripts(v, 1)::bigint AS dim"


def exploded(df, *keys):
    return df.select(*keys, F.posexplode("v").alias("p", "x")).select(*keys, (F.col("p") + 1).cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query("scl_01_l2_normalise", "WITH " + WIN_SQL + f", n AS (SELECT vec_id, list_transform(v, lambda x: 3 * x / greatest(sqrt(9 * list_inner_product(v, v)), 1e-12)) AS v FROM win), o AS (SELECT vec_id, {_LONG} FROM n) SELECT vec_id, dim, round(x, 6) AS x FROM o")
def l2_normalise(spark, d):
    w = windows(spark, d).withColumn("v", F.transform("v", lambda x: 3 * x))
    return exploded(w.withColumn("v", vectors.normalise(F.col("v"))), "vec_id")


@query("scl_02_centre_normalise", "WITH " + WIN_SQL + MEAN_SQL + f", o AS (SELECT track_id, role, offset_s, {_LONG} FROM cen) SELECT track_id, role, offset_s, dim, round(x, 6) AS x FROM o")
def centre_normalise(spark, d):
    w = windows(spark, d)
    return exploded(vectors.centred(w, w.filter("role = 'reference'")), "track_id", "role", "offset_s")


_DUR = "d AS (SELECT doc_id, (n_chars % 400) / 10.0::double AS dur FROM documents)"


def durations(spark, d):
    return read(spark, d, "documents").select("doc_id", ((F.col("n_chars") % 400) / 10.0).alias("dur"))


_STARTS = """, s AS (SELECT doc_id, dur - 10 AS last, unnest(list_transform(range(0, floor((dur - 10 + 0.001) / 5)::bigint + 1), lambda i: i * 5.0::double)) AS start FROM d WHERE dur >= 10),
 t AS (SELECT doc_id, start FROM s UNION ALL SELECT doc_id, last FROM s GROUP BY doc_id, last HAVING abs(last - max(start)) > 0.001)"""


@query("scl_03_window_starts", "WITH " + _DUR + _STARTS + " SELECT doc_id, round(start, 3) AS start FROM t")
def window_starts(spark, d):
    return durations(spark, d).select("doc_id", F.explode(fn.window_starts(F.col("dur"))).alias("start")).withColumn("start", F.round("start", 3))


@query("str_01_media_windows", "WITH " + _DUR + _STARTS + " SELECT round(start, 3) AS start, round(start + 10, 3) AS stop, count(*) AS n FROM t GROUP BY ALL")
def media_windows(spark, d):
    s = durations(spark, d).select(F.explode(fn.window_starts(F.col("dur"))).alias("start")).withColumn("start", F.round("start", 3))
    return s.groupBy("start", F.round(F.col("start") + 10, 3).alias("stop")).agg(F.count("*").alias("n"))


@query("scl_04_even_starts", "WITH " + _DUR + ", s AS (SELECT doc_id, unnest(list_distinct(list_transform(range(0, 5), lambda i: round(i * (dur - 10) / 4, 3)))) AS start FROM d WHERE dur >= 10) SELECT doc_id, start FROM s")
def even_starts(spark, d):
    return durations(spark, d).select("doc_id", F.explode(fn.even_starts(F.col("dur"), 5)).alias("start"))


@query("scl_05_full_windows", "SELECT doc_id, unnest(range(0, n_chars - 480 + 1, 240)) AS start FROM documents WHERE n_chars >= 480")
def full_windows(spark, d):
    return read(spark, d, "documents").select("doc_id", F.explode(fn.full_windows(F.col("n_chars"), 480, 240)).alias("start"))


@query("scl_10_pitch_class", "SELECT event_id, ((round_even(69 + 12 * log2((value + 20) / 440.0::double), 0)::bigint % 12) + 12) % 12 AS pc FROM events")
def pitch_class(spark, d):
    return read(spark, d, "events").select("event_id", fn.pitch_class(F.col("value") + 20).alias("pc"))


@query("scl_11_midi_to_hz", "SELECT n_nationkey AS note, round(440.0::double * pow(2.0::double, (n_nationkey * 4 - 69) / 12.0::double), 4) AS hz FROM nation")
def midi_to_hz(spark, d):
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("note"), F.round(fn.midi_hz(F.col("n_nationkey") * 4), 4).alias("hz"))


def _fold_sql(first: str, last: str) -> str:
    """Components first to last (excluded), their sizes summed by their number modulo 12."""
    return f"list_transform(range(0, 12), lambda i: list_sum(list_transform(range({first}, {last}), lambda j: CASE WHEN j % 12 = i THEN abs(embedding[j + 1]::double) ELSE 0 END)))"


_CHROMA = f"ch AS (SELECT vec_id, {_fold_sql('0', 'len(embedding) // 2')} AS a, {_fold_sql('len(embedding) // 2', 'len(embedding)')} AS b FROM embeddings)"


def chroma(spark, d):
    """Both halves of every vector as 12 classes: the sizes of all components, by their number modulo 12."""
    v = F.col("embedding").cast("array<double>")
    half = F.floor(F.size(v) / 2).cast("int")
    own = lambda v, inside, i: F.filter(v, lambda x, j: (j % 12 == i) & inside(j))
    fold = lambda inside: bound(v, lambda v: F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.aggregate(own(v, inside, i), F.lit(0.0), lambda s, x: s + F.abs(x))))
    return read(spark, d, "embeddings").select("vec_id", fold(lambda j: j < half).alias("a"), fold(lambda j: j >= half).alias("b"))


@query("scl_12_best_roll", "WITH " + _CHROMA + """, r AS (SELECT vec_id, s, round(list_inner_product(a, list_concat(list_slice(b, 13 - s, 12), list_slice(b, 1, 12 - s))), 6) AS x FROM ch, (SELECT unnest(range(0, 12)) AS s))
 SELECT vec_id, max(x) AS score, arg_min(s, (-x, s)) AS shift FROM r GROUP BY vec_id""")
def best_roll(spark, d):
    top, shift = fn.best_roll(F.col("a"), F.col("b"))
    return chroma(spark, d).select("vec_id", top.alias("score"), shift.alias("shift"))


_SEG = """seg AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, round(value % 60, 3) AS q, round((value * 7) % 60, 3) AS r, event_id % 3 AS shift,
   round((event_id % 7) / 7.0::double, 4) AS pitch, round((event_id % 5) / 5.0::double, 4) AS rhythm, round((event_id % 11) / 11.0::double, 4) AS chroma FROM events),
 s5 AS (SELECT *, row_number() OVER w AS k, q - lag(q) OVER w AS dq, r - lag(r) OVER w AS dr FROM seg WINDOW w AS (PARTITION BY user_id ORDER BY q, r, shift)),
 isl AS (SELECT *, sum(CASE WHEN dr >= 0 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS isl FROM s5),
 runs AS (SELECT user_id, max(n) AS longest FROM (SELECT user_id, isl, count(*) AS n FROM isl GROUP BY ALL) GROUP BY user_id),
 md AS (SELECT user_id, max(n) AS m FROM (SELECT user_id, shift, count(*) AS n FROM s5 GROUP BY ALL) GROUP BY user_id),
 f AS (SELECT user_id, count(*) AS n, count(*) FILTER (dr >= 0) / greatest(1, count(*) - 1)::double AS ordered, CASE count(*) FILTER (dq > 0 AND dr > 0) WHEN 0 THEN 0.0::double WHEN 1 THEN 1.0::double
   ELSE exp(-stddev_pop(ln(dr / dq)) FILTER (dq > 0 AND dr > 0)) END AS tempo, max(q) AS mq FROM s5 GROUP BY user_id),
 tf AS (SELECT user_id, n, ordered, m / greatest(1, n)::double AS shift_consistency, tempo AS tempo_consistency, longest, least(1, 10.0::double * longest / greatest(10, mq + 10)) AS coverage FROM f JOIN runs USING (user_id) JOIN md USING (user_id))"""


def segment_lists(spark, d, *more):
    seg = F.struct(F.round(F.col("value") % 60, 3).alias("q"), F.round((F.col("value") * 7) % 60, 3).alias("r"), (F.col("event_id") % 3).alias("shift"), *more)
    return read(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(seg)).alias("segments"))


@query("scl_17_temporal_evidence", "WITH " + _SEG + """, ev AS (SELECT user_id, count(*) AS matched, avg(pitch) AS pitch, avg(rhythm) AS rhythm, avg(chroma) AS chroma, median(dq / dr) FILTER (dq > 0 AND dr > 0) AS tempo_median,
   bool_and(coalesce(dr >= 0, true)) AS in_order, arg_max(r, k) AS last_r, 30.0::double + user_id % 50 AS secs FROM s5 GROUP BY user_id)
 SELECT user_id, matched, round(ordered, 6) AS ordered_fraction, in_order AS ordered, round(shift_consistency, 6) AS shift_consistency, round(coalesce(tempo_median, 1), 4) AS tempo_median, round(tempo_consistency, 4) AS tempo_consistency,
   least(10.0::double * longest, secs) AS chain_s, round(least(10.0::double * matched, secs) / secs, 6) AS query_coverage, round(least(1, least(10.0::double * matched, secs) / (last_r + 10)), 6) AS reference_coverage,
   round(pitch, 6) AS pitch, round(rhythm, 6) AS rhythm, round(chroma, 6) AS chroma FROM tf JOIN ev USING (user_id)""")
def temporal_evidence(spark, d):
    part = lambda k, name: F.round((F.col("event_id") % k) / float(k), 4).alias(name)
    s = segment_lists(spark, d, part(7, "pitch"), part(5, "rhythm"), part(11, "chroma"))
    e = s.select("user_id", temporal.evidence_record(F.col("segments"), 30.0 + F.col("user_id") % 50).alias("e")).select("user_id", "e.*")
    digits = {"tempo_consistency": 4, "tempo_median": 4}
    return e.select("user_id", *[F.round(c, digits.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in e.drop("user_id").dtypes])


_PV = """, pv AS (SELECT user_id, round((user_id % 11) / 11.0::double, 4) AS sc, round((user_id % 7) / 7.0::double, 4) AS p, round((user_id % 5) / 5.0::double, 4) AS rh, round((user_id % 3) / 3.0::double, 4) AS c, tf.* EXCLUDE (user_id) FROM tf),
 vec AS (SELECT user_id, [sc, p, rh, c, p * rh, rh * c, least(p, rh, c), ordered, shift_consistency, tempo_consistency, coverage, n / 3.0::double] AS v FROM pv)"""


def pair_vectors(spark, d):
    part = lambda k: F.round((F.col("user_id") % k) / float(k), 4)
    return segment_lists(spark, d).select("user_id", temporal.pair_vector(part(11), part(7), part(5), part(3), F.col("segments")).alias("v"))


@query("scl_18_pair_vector", "WITH " + _SEG + _PV + " SELECT user_id, dim, round(x, 4) AS x FROM (SELECT user_id, unnest(v) AS x, generate_subscripts(v, 1)::bigint AS dim FROM vec)")
def pair_vector(spark, d):
    return pair_vectors(spark, d).select("user_id", F.posexplode("v").alias("p", "x")).select("user_id", (F.col("p") + 1).cast("long").alias("dim"), F.round("x", 4).alias("x"))


@query("win_11_query_vector", "WITH " + _SEG + _PV + """, v3 AS (SELECT user_id // 3 AS query_id, list(list_transform(v, lambda x: round(x, 4)) ORDER BY round(v[1], 4) DESC, list_transform(v, lambda x: round(x, 4)) DESC) AS z FROM vec GROUP BY 1 HAVING count(*) = 3),
 j AS (SELECT query_id, z, unnest(range(1, 13)) AS j FROM v3),
 q AS (SELECT query_id, j + 12 * (k - 1) AS dim, z[k][j] AS x FROM j, (SELECT unnest([1, 2, 3]) AS k) UNION ALL SELECT query_id, 36 + j, greatest(z[1][j], z[2][j], z[3][j]) FROM j UNION ALL SELECT query_id, 48 + j, (z[1][j] + z[2][j] + z[3][j]) / 3 FROM j
  UNION ALL SELECT query_id, 60 + j, list_stddev_pop([z[1][j], z[2][j], z[3][j]]) FROM j UNION ALL SELECT query_id, 72 + j, z[1][j] - z[2][j] FROM j UNION ALL SELECT query_id, 84 + j, z[2][j] - z[3][j] FROM j)
 SELECT query_id, dim::bigint AS dim, round(x, 4) AS x FROM q""")
def query_vector(spark, d):
    v = pair_vectors(spark, d).withColumn("v", F.transform("v", lambda x: F.round(x, 4)))
    g = v.groupBy(F.floor(F.col("user_id") / 3).alias("query_id")).agg(F.collect_list("v").alias("vs"))
    q = g.withColumn("v", temporal.query_vector(F.col("vs"))).filter("v IS NOT NULL")
    return q.select("query_id", F.posexplode("v").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("long").alias("dim"), F.round("x", 4).alias("x"))


@query("scl_19_fusion", S + " SELECT doc_id, round(0.5::double * score + 0.5::double * (0.4::double * pair_score + 0.35::double * score + 0.25::double * (n_chars % 10) / 10.0::double), 8) AS fusion FROM scored")
def fusion(spark, d):
    f = fn.feature_score(F.col("pair_score"), F.col("score"), (F.col("n_chars") % 10) / 10.0)
    return scored(spark, d).select("doc_id", F.round(fn.fusion(F.col("score"), f), 8).alias("fusion"))


_COEF = ([0.5, 0.5], [0.2, 0.0], [1.5, -0.7e-8], 0.3)


@query("scl_20_linear_score", S + " SELECT doc_id, round(1 / (1 + exp(-greatest(-30, least(30, 0.3::double + (score - 0.5) / 0.2::double * 1.5 + (pair_score - 0.5) / 1e-8::double * -0.7e-8::double)))), 6) AS p FROM scored")
def linear_score(spark, d):
    return scored(spark, d).select("doc_id", F.round(fn.linear_score(F.array("score", "pair_score"), *_COEF), 6).alias("p"))


_PROFILES = "prof(key, p) AS (VALUES " + ", ".join(f"('{k}', {p}::double[])" for k, p in fn.key_profiles()) + ")"


@query("scl_21_key_estimate", f"WITH {_CHROMA}, {_PROFILES}, " + """cw AS (SELECT vec_id, list_transform(list_zip(a, b), lambda p: p[1] + p[2]) AS a FROM ch), dv AS (SELECT vec_id, list_transform(a, lambda x: x - list_avg(a)) AS v FROM cw), c AS (SELECT vec_id, key, round(list_inner_product(v, p) / sqrt(list_inner_product(v, v)), 6) AS r FROM dv, prof)
 SELECT vec_id, arg_min(key, (-r, key)) AS key FROM c GROUP BY vec_id""")
def key_estimate(spark, d):
    whole = chroma(spark, d).select("vec_id", F.zip_with("a", "b", lambda x, y: x + y).alias("c"))
    return whole.select("vec_id", fn.estimate_key(F.col("c")).alias("key"))


_NAME = "p_name || '_seg' || p_partkey || '_' || lpad((p_partkey % 5000)::varchar, 6, '0') || CASE WHEN p_partkey % 3 = 0 THEN 's' ELSE 'x' END"


def part_names(spark, d):
    k = F.col("p_partkey")
    return read(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit("_seg"), k.cast("string"), F.lit("_"), F.lpad((k % 5000).cast("string"), 6, "0"), F.when(k % 3 == 0, "s").otherwise("x")).alias("name"))


@query("scl_22_segment_names", f"SELECT p_partkey, coalesce(nullif(regexp_extract({_NAME}, '_(\\d{{6}})s', 1), '')::double, 0) AS seconds, regexp_replace(p_name || '_SEG' || p_partkey, '(?i)_seg(?:ment)?_?\\d+$', '') AS track FROM part")
def segment_names(spark, d):
    n = part_names(spark, d).join(read(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")
    return n.select("p_partkey", fn.segment_seconds(F.col("name")).alias("seconds"), fn.strip_segment(F.concat("p_name", F.lit("_SEG"), F.col("p_partkey").cast("string"))).alias("track"))


@query("scl_23_paths", r"SELECT p_partkey, p_partkey || '.a.wav' AS base, p_partkey || '.a' AS stem FROM part")
def paths(spark, d):
    path = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("C:\\x\\y\\"), F.col("p_partkey").cast("string"), F.lit(".a.wav"))).otherwise(F.concat(F.lit("/x/y/"), F.col("p_partkey").cast("string"), F.lit(".a.wav")))
    return read(spark, d, "part").select("p_partkey", fn.basename(path).alias("base"), fn.stem(path).alias("stem"))


@query("scl_24_safe_names", r"""WITH p AS (SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN ' . ' WHEN 1 THEN NULL ELSE ' .' || p_name || '?*' || p_partkey || '. ' END AS n FROM part)
 SELECT p_partkey, coalesce(nullif(substr(regexp_replace(regexp_replace(n, '[<>:"/\\|?*\x00-\x1F]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g'), 1, 180), ''), 'upload') AS safe FROM p""")
def safe_names(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 10 == 0, "/a/ . ").when(k % 10 == 1, F.lit(None)).otherwise(F.concat(F.lit("/a/ ."), "p_name", F.lit("?*"), k.cast("string"), F.lit(". ")))
    return read(spark, d, "part").select("p_partkey", fn.safe_name(name).alias("safe"))


@query("scl_25_hashes", "SELECT doc_id, sha256(text) AS sha, ('0x' || substr(sha256(text), 1, 12))::bigint AS prefix48 FROM documents")
def hashes(spark, d):
    from ..operators.sampling import hash48

    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), hash48(F.col("text")).alias("prefix48"))


@query("scl_26_peak_normalise", "WITH w AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS v FROM embeddings), n AS (SELECT vec_id, list_transform(v, lambda x: x * 0.98 / list_max(list_transform(v, lambda y: abs(y)))) AS v FROM w) SELECT vec_id, dim, round(x, 6) AS x FROM (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1)::bigint AS dim FROM n)")
def peak_normalise(spark, d):
    return exploded(windows(spark, d).withColumn("v", fn.peak_normalise(F.col("v"))), "vec_id")


@query("scl_27_reorder_blocks", "WITH w AS (SELECT vec_id, embedding AS v FROM embeddings), o AS (SELECT vec_id, list_concat(v[21:40], v[1:20], v[41:60], v[21:40]) AS v FROM w) SELECT vec_id, dim, round(x::double, 6) AS x FROM (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1)::bigint AS dim FROM o)")
def reorder_blocks(spark, d):
    return exploded(windows(spark, d).withColumn("v", fn.reorder_blocks(F.col("v"), 20, [1, 0, 2, 3, 1])), "vec_id")


@query("scl_30_excerpts", "WITH " + _DUR + """, p AS (SELECT doc_id, unnest([0, 1, 2]) AS i, greatest(0, dur - 12) AS last FROM d)
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sha256(doc_id || ':' || i))::integer AS variant, round(list_extract([0.15, 0.5, 0.8]::double[], i + 1) * last, 3) AS start FROM p""")
def excerpts(spark, d):
    e = durations(spark, d).select("doc_id", F.posexplode(fn.excerpt_starts(F.col("dur"), 12.0, F.col("doc_id"))).alias("p", "start"))
    return e.select("doc_id", (F.col("p") + 1).alias("variant"), "start")


@query("scl_31_half_even_rounding", "SELECT event_id, round_even(event_id / 8.0::double, 2) AS rounded FROM events")
def half_even(spark, d):
    return read(spark, d, "events").select("event_id", F.bround(F.col("event_id") / 8.0, 2).alias("rounded"))


@query("str_05_content_hash", "SELECT page_id, sha256(coalesce(html, '')) AS audio_hash FROM pages")
def content_hash(spark, d):
    return read(spark, d, "pages").select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("audio_hash"))


@query("src_09_durations", "SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN (doc_id % 3) * 3600 + (n_chars % 60) * 60 + (doc_id % 60) + 0.25::double END AS seconds FROM documents")
def container_durations(spark, d):
    c = lambda x: x.cast("string")
    text = F.concat(F.lit("Input #0\n  Duration: "), c(F.col("doc_id") % 3), F.lit(":"), c(F.col("n_chars") % 60), F.lit(":"), c(F.col("doc_id") % 60), F.lit(".25, start: 0"))
    return read(spark, d, "documents").select("doc_id", fn.hms_seconds(F.when(F.col("doc_id") % 5 > 0, text).otherwise("Duration: N/A")).alias("seconds"))


_DRAW = "(('0x' || substr(sha256(p_partkey || ':{}'), 1, 12))::bigint / 281474976710656.0::double)"


def _within(name: str, span: tuple[float, float], digits: int) -> str:
    return f"(round({span[0]}::double + {_DRAW.format(name)} * ({span[1]}::double - {span[0]}::double), {digits}) + 0.0::double)"


EDITS_SQL = f"""p AS (SELECT p_partkey, p_partkey % 3 AS c, 2 + p_size % 5 AS n FROM part),
 o AS (SELECT *, list_transform(list_sort(list_transform(range(0, n), lambda i: struct_pack(h := sha256(p_partkey || ':' || i), i := i))), lambda k: k.i) AS o, floor({_DRAW.format("place")} * (n + 1))::bigint AS place, floor({_DRAW.format("repeat")} * n)::bigint AS rep FROM p),
 m AS (SELECT p_partkey, c, list_concat(list_slice(o, 1, place), [list_extract(o, rep + 1)], list_slice(o, place + 1, n)) AS o, {_within("ratio", fn.RATIO, 4)} AS ratio, {_within("eq", fn.EQ_DB, 1)} AS eq, {_within("tempo", fn.TEMPO, 4)} AS tempo, {_within("bass", fn.BASS_DB, 1)} AS bass FROM o)"""


@query("scl_28_edit_manifest", "WITH " + EDITS_SQL + """ SELECT p_partkey, CASE c WHEN 0 THEN 24 END AS section_seconds, CASE c WHEN 0 THEN array_to_string(o, ',') END AS section_order, CASE c WHEN 1 THEN ratio END AS ratio, CASE c WHEN 1 THEN eq END AS eq, CASE c WHEN 2 THEN tempo END AS tempo, CASE c WHEN 2 THEN bass END AS bass,
   CASE c WHEN 2 THEN 'mild' END AS echo, CASE c WHEN 1 THEN 'asetrate=22050*' || ratio || ',aresample=22050,equalizer=f=1200:t=q:w=1:g=' || eq WHEN 2 THEN 'atempo=' || tempo || ',equalizer=f=180:t=q:w=1:g=' || bass || ',aecho=0.8:0.75:70:0.12' END AS filters FROM m""")
def edit_manifest(spark, d):
    j = edits(spark, d)
    return j.select("p_partkey", "j.section_seconds", F.array_join(F.col("j.section_order").cast("array<string>"), ",").alias("section_order"), F.col("j.speed_and_pitch_ratio").alias("ratio"), F.col("j.eq_1200hz_db").alias("eq"),
                    F.col("j.tempo_rate").alias("tempo"), F.col("j.bass_eq_db").alias("bass"), "j.echo", "filters")


def edits(spark, d):
    """Parts with their edit's parameters j and filter chain."""
    k = F.col("p_partkey")
    case = F.when(k % 3 == 0, "section_edit").when(k % 3 == 1, "tempo_pitch_eq").otherwise("remix_fx")
    parameters, filters = fn.edit_manifest(case, k, 2 + F.col("p_size") % 5)
    schema = "section_seconds int, section_order array<int>, speed_and_pitch_ratio double, eq_1200hz_db double, tempo_rate double, bass_eq_db double, echo string"
    return read(spark, d, "part").select("p_partkey", F.from_json(parameters, schema).alias("j"), filters.alias("filters"))
