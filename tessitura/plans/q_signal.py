"""Signal kernels and model operators."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import dsp, matching, models, signal, vectors
from ..scratch import settle
from ..sources import containers
from .base import SCORED_SQL, query, read, scored
from .q_metrics import D, decided
from .q_scalars import EDITS_SQL, edits, pair_vectors

S = "WITH " + SCORED_SQL
RATE = 8000


def _frames(v):
    return np.abs(np.pad(np.array(v, dtype=np.float64), (0, -len(v) % 12))).reshape(-1, 12)


def _struct(fields: str) -> str:
    """name type, ... as the fields of a struct type."""
    return re.sub(r"(^|, )(\w+) ", r"\1\2: ", fields)


def frames(spark, d):
    """Chroma frames of 12 made of each vector, padded with zeros, and of its neighbour within the label."""
    e = read(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return signal.spread(e.withColumn("other", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).filter("other IS NOT NULL").drop("label"))


def kernel(spark, d, f, kind="double"):
    return signal.apply_kernel(frames(spark, d), ["vec_id"], ["embedding", "other"], f, kind)


@query("scl_14_dtw")
def dtw(spark, d):
    def run(a, b):
        score, shift = signal.dtw(signal._unit(_frames(a)), signal._unit(_frames(b)))
        return {"score": score, "shift": shift}

    return kernel(spark, d, run, "struct<score: double, shift: int>").select("vec_id", F.round("value.score", 6).alias("similarity"), "value.shift", "error")


def unpacked(df):
    """vec_id, the fields of value with doubles rounded, error."""
    flat = df.select("vec_id", "value.*", "error")
    return flat.select(*[F.round(c, 6).alias(c) if t == "double" else F.to_json(c).alias(c) if t.startswith("array<struct") else F.col(c) for c, t in flat.dtypes])


@query("scl_15_aligned_dtw")
def aligned(spark, d):
    long = lambda v: signal._unit(np.tile(_frames(v), (40, 1)))
    return unpacked(kernel(spark, d, lambda a, b: signal.aligned_dtw(long(a), long(b)), f"struct<{_struct(signal.ALIGNED)}>"))


@query("scl_16_compare_chroma")
def compare(spark, d):
    long = lambda v: signal._unit(np.tile(_frames(v), (60, 1)))
    return unpacked(kernel(spark, d, lambda a, b: signal.compare_chroma(long(a), long(b)), f"struct<{_struct(signal.COMPARED)}>"))


@query("scl_06_chroma_windows", "WITH e AS (SELECT vec_id, label, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS o FROM embeddings) SELECT vec_id, unnest([0, 54, 108, 162, 192]) AS start FROM e WHERE o IS NOT NULL")
def chroma_windows(spark, d):
    starts = lambda a, b: [int(s) for s, _ in signal.chroma_windows(np.tile(_frames(a), (50, 1)))]
    return kernel(spark, d, starts, "array<int>").select("vec_id", F.explode("value").alias("start"))


@query("scl_07_chroma_bins", "WITH e AS (SELECT vec_id, label, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS o FROM embeddings) SELECT vec_id, unnest([0, 5, 10, 15, 18]) AS first_bin FROM e WHERE o IS NOT NULL")
def chroma_bins(spark, d):
    starts = lambda a, b: [int(s) for s, _ in signal.bins(np.tile(_frames(a), (50, 1)))]
    return kernel(spark, d, starts, "array<int>").select("vec_id", F.explode("value").alias("first_bin"))


def pcm(spark, d):
    """A WAV file of one second for each nation: a note whose pitch follows the key, every seventh broken."""
    def make(k):
        return b"no container" if k % 7 == 6 else signal.wav_bytes(signal.tone(440.0 * 2 ** ((k % 12) / 12), 1.0, RATE), RATE)

    return signal.apply_kernel(read(spark, d, "nation"), ["n_nationkey"], ["n_nationkey"], make, "binary").select("n_nationkey", F.col("value").alias("content"))


_FINE = "FROM nation WHERE n_nationkey % 7 < 6"


@query("src_08_decode_wav", "SELECT n_nationkey, CASE WHEN n_nationkey % 7 < 6 THEN 8000 END::bigint AS samples, CASE WHEN n_nationkey % 7 < 6 THEN true END AS audible, CASE WHEN n_nationkey % 7 = 6 THEN 'ValueError' END AS error FROM nation")
def decode(spark, d):
    out = signal.apply_kernel(pcm(spark, d), ["n_nationkey"], ["content"], lambda c: [len(x := signal.decode(c, RATE)), float(np.abs(x).max())], "array<double>")
    return out.select("n_nationkey", F.col("value")[0].cast("long").alias("samples"), (F.col("value")[1] > 0.1).alias("audible"), F.split("error", ":")[0].alias("error"))


@query("scl_08_stft_chroma", f"SELECT n_nationkey, (n_nationkey + 9) % 12 AS pitch_class {_FINE}")
def stft_chroma(spark, d):
    out = signal.apply_kernel(pcm(spark, d), ["n_nationkey"], ["content"], lambda c: int(signal.chroma(signal.decode(c, RATE), RATE).mean(axis=0).argmax()), "int")
    return out.filter("error IS NULL").select("n_nationkey", F.col("value").alias("pitch_class"))


@query("scl_09_spectral_evidence", f"SELECT n_nationkey, (n_nationkey + 9) % 12 AS pitch_class, 1 AS onset_frames {_FINE}")
def spectral(spark, d):
    """The strongest pitch class, and how many frames of a note after half a second of silence have a large onset."""
    def found(c):
        x = signal.decode(c, RATE)
        onset = signal.evidence(np.r_[np.zeros(4096), x[2000:6000]], RATE)[2]
        return [int(signal.evidence(x, RATE)[0].argmax()), int((onset > 0.5).sum())]

    out = signal.apply_kernel(pcm(spark, d), ["n_nationkey"], ["content"], found, "array<int>")
    return out.filter("error IS NULL").select("n_nationkey", F.col("value")[0].alias("pitch_class"), F.col("value")[1].alias("onset_frames"))


@query("scl_13_rhythm")
def rhythm(spark, d):
    def score(c):
        x = signal.decode(c, RATE)
        beat = np.concatenate([x[:2000], np.zeros(2000)] * 8)
        return signal.rhythm_score(signal.evidence(beat, RATE)[2], signal.evidence(np.roll(beat, 512), RATE)[2])

    return signal.apply_kernel(pcm(spark, d), ["n_nationkey"], ["content"], score, "double").filter("error IS NULL").select("n_nationkey", F.round("value", 4).alias("rhythm"))


@query("scl_29_layered_mix", f"SELECT n_nationkey, 0.98::double AS peak {_FINE}")
def layered(spark, d):
    def mixed(c):
        x = signal.decode(c, RATE)
        return float(np.abs(signal.layer(x, signal.tone(220.0, 0.5, RATE))).max())

    return signal.apply_kernel(pcm(spark, d), ["n_nationkey"], ["content"], mixed, "double").filter("error IS NULL").select("n_nationkey", F.round("value", 6).alias("peak"))


def melody(key):
    """Eleven seconds of notes that follow the key."""
    return np.concatenate([signal.tone(440.0 * 2 ** (((7 * key + i * i * (key + 3)) % 12) / 12), 0.55, RATE) for i in range(20)])


@query("src_10_fingerprints", f"WITH n AS (SELECT n_nationkey AS k {_FINE}) SELECT a.k AS clip, b.k AS source FROM n a JOIN n b ON a.k % 12 = b.k % 12")
def fingerprints(spark, d):
    """Which melodies hold a clip of a melody, found by their fingerprints' words; the clip is quieter and begins later. Keys
    that are twelve apart have one melody."""
    n = read(spark, d, "nation").filter("n_nationkey % 7 < 6").select("n_nationkey")

    def words(key, part):
        x = melody(key)
        return signal.fingerprint(0.5 * x[3 * 1365 :] if part else x, RATE, least_s=10.0)

    both = n.withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
    out = settle(signal.apply_kernel(both, ["n_nationkey", "part"], ["n_nationkey", "part"], words, "array<bigint>").filter("error IS NULL"), "words")
    side = lambda k, key, name: out.filter(F.col("part") == k).select(F.col("n_nationkey").alias(key), F.col("value").alias(name))
    met = matching.contained(side(1, "needle_id", "needle"), side(0, "hay_id", "hay"))
    return met.select(F.col("needle_id").alias("clip"), F.col("hay_id").alias("source"))


@query("scl_28_filtered", """WITH """ + EDITS_SQL + """, n AS (SELECT *, 3000 + 17 * (p_partkey % 50) AS n FROM m WHERE c > 0)
 SELECT p_partkey, CASE c WHEN 1 THEN (n * 10000 + round(ratio * 10000)::bigint - 1) // round(ratio * 10000)::bigint ELSE round_even(n / tempo, 0)::bigint + 1544 END AS samples, true AS audible FROM n""")
def filtered(spark, d):
    """The edit manifest's chains run on a tone for each part; what comes out has the length that its edit gives."""
    p = signal.spread(edits(spark, d).filter("filters IS NOT NULL").select("p_partkey", "filters"))

    note = signal.tone(440.0, 1.0, 22_050)

    def run(key, chain):
        y = dsp.apply_filters(note[: 3000 + 17 * (key % 50)], 22_050, chain)
        return [float(len(y)), float(np.abs(y).max())]

    out = signal.apply_kernel(p, ["p_partkey"], ["p_partkey", "filters"], run, "array<double>")
    return out.select("p_partkey", F.col("value")[0].cast("long").alias("samples"), (F.col("value")[1] > 0.05).alias("audible"))


def made_start(key):
    """(first bytes, size) of an audio file of 1 + key / 8 seconds, of which all other bytes are zero: by key one of four
    containers, every eleventh cut off."""
    n = 8000 + 1000 * key
    if key % 4 == 0:
        start, fill = signal.wav_header(n, 8000), 2 * n
    elif key % 4 == 1:
        packed = 8000 << 44 | 15 << 36 | n
        start, fill = b"fLaC" + b"\0\0\0\x22" + bytes(10) + packed.to_bytes(8, "big"), 16
    elif key % 4 == 2:
        page = lambda flags, at, body: b"OggS\0" + bytes([flags]) + at.to_bytes(8, "little") + bytes(12) + b"\1" + bytes([len(body)]) + body
        start, fill = page(2, 0, b"\x01vorbis" + bytes(4) + b"\1" + (8000).to_bytes(4, "little") + bytes(14)) + page(4, n, b"x"), 0
    else:
        start, fill = b"ID3\4\0\0" + bytes(3) + b"\5" + bytes(5) + b"\xff\xfb\x10\xc0", 1000 * (8 + key) // 2 - 4  # 32 kbit/s, one channel
    size = len(start) + fill
    size = size // 2 if key % 11 == 10 else size
    return start[:size], size


def made_file(key):
    start, size = made_start(key)
    return start + bytes(size - len(start))


def made_ends(key):
    """(first block, last block, size) of the file, without what lies between."""
    start, size = made_start(key)
    head = start + bytes(min(containers.HEAD, size) - len(start))
    return head, head[-containers.TAIL :] if size <= containers.HEAD else bytes(containers.TAIL), size


@query("src_09_headers", """SELECT s_suppkey, CASE WHEN s_suppkey % 11 < 10 THEN 1 + s_suppkey / 8.0::double WHEN s_suppkey % 4 = 3 THEN (1000 * (8 + s_suppkey) // 2 + 15) // 2 / 4000.0::double - 15 / 4000.0::double END AS seconds,
 CASE WHEN s_suppkey % 11 = 10 AND s_suppkey % 4 < 3 THEN 'ValueError' END AS error FROM supplier""")
def headers(spark, d):
    """Files grow with their key, so a row's ends are made, read and dropped one after another, and no file becomes a value."""
    out = signal.apply_kernel(read(spark, d, "supplier"), ["s_suppkey"], ["s_suppkey"], lambda k: containers.duration(*made_ends(k)), "double")
    return out.select("s_suppkey", F.col("value").alias("seconds"), F.split("error", ":")[0].alias("error"))


@query("udf_01_embed", f"SELECT n_nationkey, 64 AS dim, 1.0::double AS norm {_FINE}")
def embedded(spark, d):
    x = signal.apply_kernel(pcm(spark, d), ["n_nationkey"], ["content"], lambda c: [float(v) for v in signal.decode(c, RATE)], "array<double>").filter("error IS NULL")
    out = signal.embed_windows(x.select("n_nationkey", F.col("value").alias("pcm")), ["n_nationkey"], "pcm", RATE)
    return out.select("n_nationkey", F.size("value").alias("dim"), F.round(F.sqrt(F.aggregate("value", F.lit(0.0), lambda s, v: s + v * v)), 6).alias("norm"))


# --- models --------------------------------------------------------------------------------------


def labelled(spark, d):
    return pair_vectors(spark, d).withColumns({"y": ((F.col("user_id") * 5 % 13) > 6).cast("double"), "family": (F.col("user_id") % 3).cast("string")})


@query("udf_02_pair_verifier")
def pair_verifier(spark, d):
    rows = settle(labelled(spark, d), "pairs")
    return models.score_pairs(rows, models.fit_pair_verifier(rows)).select("user_id", "y", F.round("probability", 4).alias("probability"))


@query("udf_03_pair_classifiers")
def pair_classifiers(spark, d):
    rows = settle(labelled(spark, d), "pairs")
    out = models.fit_all(rows.filter("user_id % 2 = 0"), rows.filter("user_id % 2 = 1"), models.PAIR_LEVEL)
    return out.select("model", "user_id", "y", F.round("probability", 4).alias("probability"))


@query("udf_04_query_classifiers")
def query_classifiers(spark, d):
    from ..operators import temporal

    g = labelled(spark, d).groupBy(F.floor(F.col("user_id") / 3).alias("query_id")).agg(F.collect_list("v").alias("vs"), F.max("y").alias("y"))
    rows = g.withColumn("v", temporal.query_vector(F.col("vs"))).filter("v IS NOT NULL").drop("vs")
    rows = settle(rows, "queries")
    out = models.fit_all(rows.filter("query_id % 5 < 3"), rows.filter("query_id % 5 >= 3"), models.QUERY_LEVEL)
    return out.select("model", "query_id", "y", F.round("probability", 4).alias("probability"))


_COEF = ([0.5, 0.5], [0.25, 0.25], [1.2, 0.8], -0.4)


@query("udf_05_predict_proba", S + " SELECT doc_id, round(1 / (1 + exp(-(-0.4::double + (score - 0.5) / 0.25 * 1.2 + (pair_score - 0.5) / 0.25 * 0.8))), 6) AS probability FROM scored")
def predict(spark, d):
    return scored(spark, d).select("doc_id", F.round(fn.linear_score(F.array("score", "pair_score"), *_COEF), 6).alias("probability"))


@query("udf_06_leave_one_family_out")
def lofo(spark, d):
    return models.leave_one_family_out(settle(labelled(spark, d), "pairs"), "family").select("family", "user_id", "y", F.round("probability", 4).alias("probability"))


@query("udf_07_contrastive_loss", """WITH v AS (SELECT vec_id, vec_id // 128 AS batch, label, list_transform(embedding, lambda x: x::double / greatest(sqrt(list_inner_product(embedding::double[], embedding::double[])), 1e-12)) AS v FROM embeddings),
 l AS (SELECT a.batch, a.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v) / 0.07::double AS x FROM v a JOIN v b ON a.batch = b.batch AND a.vec_id <> b.vec_id),
 p AS (SELECT batch, vec_id, ln(sum(exp(x))) - avg(x) FILTER (same) AS loss FROM l GROUP BY batch, vec_id)
 SELECT batch, count(loss) AS anchors, round(avg(loss), 6) AS loss FROM p GROUP BY batch""")
def contrastive(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "label", F.floor(F.col("vec_id") / 128).alias("batch"), F.col("embedding").cast("array<double>").alias("v"))
    return models.contrastive_loss(e, "batch", "vec_id", "label").select("batch", "anchors", F.round("loss", 6).alias("loss"))


@query("udf_08_hybrid_policy", D + """, p AS (SELECT *, unnest(CASE WHEN family = 'en' THEN ['all', 'ai'] ELSE ['all', 'premusic'] END) AS part FROM dec)
 SELECT part, count(*) AS n, round(avg((decision <> 'PASS')::int::double) FILTER (positive), 6) AS recall, round(avg((decision <> 'PASS')::int::double) FILTER (NOT positive), 6) AS fpr,
 round(avg((decision IN ('HOLD', 'BLOCK'))::int::double) FILTER (positive), 6) AS hold_recall, round(avg((decision IN ('HOLD', 'BLOCK'))::int::double) FILTER (NOT positive), 6) AS hold_fpr, count(*) FILTER (positive AND decision = 'PASS') AS missed FROM p GROUP BY part""")
def hybrid(spark, d):
    part = F.when(F.col("family") == "en", F.array(F.lit("all"), F.lit("ai"))).otherwise(F.array(F.lit("all"), F.lit("premusic")))
    return models.hybrid_report(decided(spark, d).withColumn("parts", part))


@query("udf_09_training_pairs", S + """, t AS (SELECT group_id AS query_id, doc_id AS track, score, row_number() OVER (PARTITION BY positive, group_id ORDER BY score DESC, doc_id) AS rk, positive FROM scored)
 SELECT query_id, track, score, CASE WHEN positive AND track % 4 = 0 THEN 1 ELSE 0 END::bigint AS label FROM t WHERE rk <= 3""")
def training_pairs(spark, d):
    s = scored(spark, d)
    order = Window.partitionBy("positive", "group_id").orderBy(F.desc("score"), "doc_id")
    best = s.withColumn("rn", F.row_number().over(order)).filter("rn <= 3")
    top = best.groupBy("positive", F.col("group_id").alias("query_id")).agg(F.collect_list(F.struct(F.col("doc_id").alias("track"), "score")).alias("top3"))
    # of each query one candidate at most is its source; here every candidate with an id divisible by four is, so each gets a row of its own
    one = top.filter("positive").select("query_id", F.explode("top3").alias("c")).select("query_id", F.when(F.col("c.track") % 4 == 0, F.col("c.track")).alias("expected"), F.array("c").alias("top3"))
    return models.training_pairs(one, top.filter("NOT positive").select("query_id", "top3"))
