"""Operators against small hand-made cases, published counts and invariants."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessitura.functions import scalars as fn
from tessitura.operators import matching, metrics, policy, retrieval, sampling, signal, temporal, thresholds
from tessitura.sources import readers, sinks
from tessitura.streaming import gate


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


@pytest.mark.parametrize(("hay", "needle", "want"), [
    ([1, 2, 3], [1, 2, 3], True), ([1, 2, 3], [1, 2], True), ([1, 2, 3], [2], True), ([1, 2, 3], [2, 3], True), ([1, 2], [1, 2, 3], False),
    ([1, 2], [], False), ([1, 1, 1, 2], [1, 1, 2], True), ([4294967295, 5], [4294967295], True), ([1, 2, 3], [1, 3], False)])
def test_contains_run(spark, hay, needle, want):
    a = lambda x: F.array(*map(F.lit, x)).cast("array<bigint>")
    assert one(spark, matching.contains_run(a(hay), a(needle)))[0] is want


def test_contained_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    hays = [(i, rng.integers(0, 4, rng.integers(0, 30)).tolist()) for i in range(40)]
    needles = [(i, rng.integers(0, 4, rng.integers(1, 11)).tolist()) for i in range(30)] + [(99, hays[3][1][:9] or [1])]
    got = matching.contained(spark.createDataFrame(needles, "needle_id long, needle array<long>"), spark.createDataFrame(hays, "hay_id long, hay array<long>"))
    want = {(n, h) for n, x in needles for h, y in hays if any(y[i : i + len(x)] == x for i in range(len(y) - len(x) + 1))}
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize(("duration", "want"), [(9.99, []), (10.0, [0]), (12.0, [0, 2]), (15.0, [0, 5]), (15.0005, [0, 5]), (22.3, [0, 5, 10, 12.3])])
def test_window_starts(spark, duration, want):
    assert np.allclose(one(spark, fn.window_starts(F.lit(duration)))[0], want)


def best(spark, rows):
    return spark.createDataFrame([("q", "t", float(o), float(s), 0.0) for o, s in rows], "query_id string, track_id string, q_off double, score double, r_off double")


@pytest.mark.parametrize(("rows", "want"), [([(0, 0.9), (5, 0.95), (10, 0.8), (20, 0.1)], (0.95 + 0.1) / 2), ([(0, 0.5)], 0.5), ([(0, 0.5), (5, 0.5), (10, 0.5), (15, 0.5), (20, 0.5)], 0.5),
                                            ([(0, 0.9), (10, 0.8), (20, 0.7), (30, 0.6)], 0.8)])
def test_greedy(spark, rows, want):
    assert retrieval.greedy_windows(best(spark, rows)).first()["score"] == pytest.approx(want, abs=1e-6)


def test_published_counts(spark):
    rows = spark.createDataFrame([(63, 0, 293, 6), (63, 0, 299, 0), (0, 0, 0, 0)], "tp long, fn long, fp long, tn long")
    a, b, c = metrics.rates(rows).collect()
    assert (a["precision"], a["fpr"], a["f1"]) == (0.176966, 0.979933, 0.300716) and b["fpr"] == 1.0 and b["specificity"] == 0.0 and c["precision"] is None


@pytest.mark.parametrize(("k", "n", "low", "high"), [(58, 300, 0.15263726685545376, 0.2417837554956011), (3, 300, 0.003406618437715286, 0.02898349336233983)])
def test_wilson(spark, k, n, low, high):
    a = one(spark, *metrics.wilson(F.lit(k), F.lit(n), 12))
    assert a[0] == pytest.approx(low, abs=1e-11) and a[1] == pytest.approx(high, abs=1e-11)


def test_wilson_of_nothing(spark):
    assert tuple(one(spark, *metrics.wilson(F.lit(0), F.lit(0)))) == (None, None)


@given(st.lists(st.tuples(st.booleans(), st.integers(0, 5)), min_size=1, max_size=25))
@settings(max_examples=8, deadline=None)
def test_auc_is_the_pairwise_share(spark, rows):
    got = metrics.auc(spark.createDataFrame([(p, float(s)) for p, s in rows], "p boolean, s double"), F.col("p"), F.col("s")).first()["auc"]
    pairs = [1.0 if a > b else 0.5 if a == b else 0.0 for p, a in rows if p for q, b in rows if not q]
    assert got is None if not pairs else got == pytest.approx(np.mean(pairs), abs=1e-6)


def test_effect_size_edges(spark):
    d = lambda rows: metrics.cohens_d(spark.createDataFrame(rows, "p boolean, v double"), F.col("p"), F.col("v")).first()[0]
    assert d([(True, 1.0), (False, 2.0)]) is None and d([(True, 1.0), (True, 1.0), (False, 1.0), (False, 1.0)]) is None
    assert d([(True, 2.0), (True, 4.0), (False, 1.0), (False, 3.0)]) == pytest.approx(1 / math.sqrt(2), abs=1e-4)


def test_thresholds(spark):
    s = lambda rows, **k: thresholds.search(spark.createDataFrame(rows, "p boolean, v double"), F.col("p"), F.col("v"), **k).first()
    a = s([(True, 0.9), (True, 0.8), (False, 0.1), (False, 0.85)], recall=1.0, fpr=0.0)
    assert (a["warn"], a["hold"], a["feasible"]) == (0.8, 0.9, True)
    b = s([(True, 0.9), (False, 0.95)], fpr=0.0)
    assert b["hold"] is None and b["feasible"] is False


@pytest.mark.parametrize(("dup", "query", "pair", "want"), [(True, 1.0, 1.0, "BLOCK"), (False, 0.0, 0.9, "HOLD"), (False, 0.35, 0.89, "WARN"), (False, 0.349, 0.0, "PASS"), (False, 0.9, 0.9, "HOLD")])
def test_decision_grid(spark, dup, query, pair, want):
    assert one(spark, policy.decide(F.lit(dup), F.lit(query), F.lit(pair), 0.35, 0.9))[0] == want


def numpy_temporal(seg):
    seg = sorted(seg)
    q, r, s = (np.array([x[i] for x in seg], dtype=float) for i in range(3))
    n = len(seg)
    runs, run = [1], 1
    for a, b in zip(r, r[1:]):
        run = run + 1 if b >= a else 1
        runs.append(run)
    ratios = [math.log(b / a) for a, b in zip(np.diff(q), np.diff(r)) if a > 0 and b > 0]
    tempo = math.exp(-np.std(ratios)) if len(ratios) > 1 else float(len(ratios))
    return [sum(np.diff(r) >= 0) / max(1, n - 1), max(sum(s == v) for v in s) / n, tempo, max(runs), min(1, 10 * max(runs) / max(10, max(q) + 10))]


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40), st.integers(0, 2)), min_size=1, max_size=6))
@settings(max_examples=8, deadline=None)
def test_temporal_features(spark, seg):
    df = spark.createDataFrame([([(float(a), float(b), c) for a, b, c in seg],)], "s array<struct<q:double,r:double,shift:int>>")
    f = temporal.features(F.col("s"))
    got = df.select(*[f[k].alias(k) for k in ("ordered", "shift_consistency", "tempo_consistency", "longest", "coverage")]).first()
    assert np.allclose(list(got), numpy_temporal([(float(a), float(b), c) for a, b, c in seg]), atol=1e-9)


def test_no_segments(spark):
    df = spark.createDataFrame([([],)], "s array<struct<q:double,r:double,shift:int>>")
    v = df.select(temporal.pair_vector(*[F.lit(0.5)] * 4, F.col("s")).alias("v")).first()["v"]
    assert v[7:] == [0.0, 0.0, 0.0, 1.0, 0.0]  # the longest chain counts one window even so


@given(st.lists(st.integers(0, 30), min_size=3, max_size=60), st.integers(0, 5))
@settings(max_examples=15, deadline=None)
def test_groups_never_span_splits(rows, seed):
    deal = sampling.cut(sorted(set(rows)), seed, {"a": 0.6, "b": 0.4})
    assert set(deal) == set(rows) and (len(deal) < 2 or set(deal.values()) == {"a", "b"})


def test_numbered_is_a_global_order(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1009).alias("k"))
    got = sampling.numbered(df, F.asc("k"), F.asc("id")).orderBy("_pos").select("k", "_pos").collect()
    assert [r["_pos"] for r in got] == list(range(1, 1001)) and [r["k"] for r in got] == sorted(r["k"] for r in got)


@pytest.mark.parametrize("s", range(12))
def test_rotated_chroma(s):
    rng = np.random.default_rng(s)
    a = signal._unit(np.abs(rng.normal(size=(10, 12))))
    score, shift = signal.dtw(a, np.roll(a, s, axis=1))
    assert score == pytest.approx(1.0) and shift == s
    v = signal._unit(np.abs(rng.normal(size=12)))
    score, shift = signal.rolled_cosine(v, np.roll(v, -s))
    assert score == pytest.approx(1.0) and shift == s


def test_signal_edges():
    assert np.isfinite(signal.chroma(np.zeros(9000))).all() and signal.rhythm_score(np.zeros(5), np.zeros(5)) == 0.0
    assert signal.dtw(np.zeros((0, 12)), np.ones((2, 12))) == (0.0, 0)
    silent = signal.aligned_dtw(np.zeros((3, 12)), np.ones((3, 12)))
    assert silent["dtw_score"] == silent["coarse_score"] == 0.0 and silent["windows"] == silent["query_windows"] == 1
    with pytest.raises(ValueError, match="too short"):
        signal.evidence(np.zeros(2047))
    for empty in (lambda: signal.bins(np.zeros((0, 12))), lambda: signal.compare_chroma(np.zeros((0, 12)), np.ones((9, 12)))):
        with pytest.raises(ValueError, match="no chroma"):
            empty()
    x = signal.tone(440, 0.5, 8000)
    assert np.abs(signal.decode_wav(signal.wav_bytes(x, 8000), 8000) - x).max() < 1e-3
    assert signal.chroma(x, 8000, low=200).mean(axis=0).argmax() == 9
    assert [s for s, _ in signal.chroma_windows(np.ones((200, 12)))] == [0, 54, 92]


def test_bins_keep_the_rest_and_the_tail():
    frames = signal._unit(np.abs(np.random.default_rng(0).normal(size=(11 * 17 + 4, 12))))
    got = signal.bins(frames)
    assert [s for s, _ in got] == [0, 5, 8] and np.allclose(got[-1][1][-1], signal._unit(frames[-4:].mean(axis=0)))
    (start, window), = signal.bins(frames[:25])
    assert start == 0 and window.shape == (10, 12) and not window[3:].any() and window[:3].any(axis=1).all()


def plain_dtw(a, b):
    """Cheapest monotone path by recursion over prefixes."""
    from functools import cache

    @cache
    def cost(i, j):
        if i < 0 or j < 0:
            return 0.0 if i == j == -1 else np.inf
        return 1 - min(1.0, max(0.0, float(a[i] @ b[j]))) + min(cost(i - 1, j), cost(i, j - 1), cost(i - 1, j - 1))

    return max(0.0, 1 - cost(len(a) - 1, len(b) - 1) / max(len(a), len(b)))


@given(st.integers(0, 10_000), st.integers(1, 9), st.integers(1, 9))
@settings(max_examples=30, deadline=None)
def test_dtw_is_the_cheapest_path(seed, n, m):
    rng = np.random.default_rng(seed)
    a, b = (signal._unit(np.abs(rng.normal(size=(k, 12)))) for k in (n, m))
    score, shift = signal.dtw(a, b)
    assert score == pytest.approx(plain_dtw(a, np.roll(b, -shift, axis=1)))
    means = [float(a.mean(axis=0) @ np.roll(b.mean(axis=0), -s)) for s in range(12)]
    assert means[shift] == pytest.approx(max(means))


def test_aligned_windows_advance_together():
    rng = np.random.default_rng(3)
    frames = signal._unit(np.abs(rng.normal(size=(11 * 45, 12))))
    got = signal.aligned_dtw(frames, np.roll(frames[110:], 4, axis=1))
    assert got["windows"] == 3 and got["dtw_score"] > 0.99 and got["shifts"] == [4] * 3 and got["query_s"] - got["candidate_s"] == pytest.approx(110 * 2048 / 22_050)
    assert (got["match_s"], got["query_windows"], got["candidate_windows"]) == (20.0, 8, 6)
    # two windows whose step isn't about five seconds don't count as a pair
    short = signal.aligned_dtw(frames[: 11 * 12], frames[: 11 * 12])
    assert short["windows"] == 1 and short["match_s"] == 10.0


def test_selected_chroma_windows_lie_apart():
    rng = np.random.default_rng(4)
    frames = signal._unit(np.abs(rng.normal(size=(700, 12))))
    got = signal.compare_chroma(frames, frames)
    at = [(x["query_s"], x["candidate_s"]) for x in got["selected"]]
    assert len(at) == 3 and all(abs(p[k] - q[k]) >= 10 for i, p in enumerate(at) for q in at[:i] for k in (0, 1))
    assert got["best_segment"] == pytest.approx(1.0) and got["top3_mean"] == pytest.approx(1.0) and got["query_segments"] == got["candidate_segments"] == 12


def test_evidence_without_segments(spark):
    kind = "array<struct<q:double,r:double,shift:int,pitch:double,rhythm:double,chroma:double>>"
    df = spark.createDataFrame([(1, []), (2, [(20.0, 40.0, 1, 0.5, 0.25, 1.0), (5.0, 10.0, 1, 0.5, 0.75, 0.0)]), (3, [(0.0, 3.0, 2, 1.0, 1.0, 1.0)])], f"id int, s {kind}")
    got = {r["id"]: r["e"] and r["e"].asDict() for r in df.select("id", temporal.evidence_record(F.col("s"), F.lit(16.0)).alias("e")).collect()}
    assert got[1] is None and got[3]["tempo_median"] == 1.0 and got[3]["tempo_consistency"] == 0.0 and got[3]["ordered"] and got[3]["reference_coverage"] == pytest.approx(10 / 13)
    assert got[2] == {"matched": 2, "ordered_fraction": 1.0, "ordered": True, "shift_consistency": 1.0, "tempo_median": 0.5, "tempo_consistency": 1.0, "chain_s": 16.0, "query_coverage": 1.0, "reference_coverage": 16 / 50,
                      "pitch": 0.5, "rhythm": 0.5, "chroma": 0.5}


@pytest.mark.parametrize(("decision", "flags"), [("PASS", (True, True, False)), ("WARN", (True, True, False)), ("HOLD", (True, True, True)), ("BLOCK", (False, False, False))])
def test_registration_flags(spark, decision, flags):
    assert tuple(one(spark, policy.registration(F.lit(decision)))[0]) == flags


def test_accepted_suffixes(spark):
    names = [f"a{s.upper()}" for s in (".mp3", ".wav", ".webm", ".flac", ".m4a", ".aac", ".ogg", ".wma")] + ["a.txt", "mp3"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert [r[0] for r in df.select(policy.suffix(F.col("p")).isin(policy.SUFFIXES)).collect()] == [True] * 8 + [False] * 2


def test_gate_within_one_batch(spark):
    reg = spark.createDataFrame([(1, "a", 1)], "id long, fingerprint string, seq long")
    new = spark.createDataFrame([(2, "a", 2), (3, "b", 3), (4, "b", 4), (5, "c", 5)], "id long, fingerprint string, seq long")
    got = {r["id"]: (r["status"], r["duplicate_of"]) for r in gate.gate_batch(new, reg).collect()}
    assert got == {2: ("REJECTED", 1), 3: ("ACCEPTED", None), 4: ("REJECTED", 3), 5: ("ACCEPTED", None)}


def test_job_states(spark):
    rows = [(1, "PENDING", 1), (1, "RUNNING", 2), (1, "SUCCEEDED", 3), (1, "RUNNING", 4), (2, "RUNNING", 1), (3, "PENDING", 1)]
    got = {r["job_id"]: (r["state"], r["ignored"]) for r in gate.restart(gate.job_states(spark.createDataFrame(rows, "job_id long, state string, seq long"))).collect()}
    assert got == {1: ("SUCCEEDED", 1), 2: (None, 1), 3: ("FAILED", 0)}


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n in ("a.WAV", "b.txt", "sub/c.mp3"):
        (tmp_path / n).write_bytes(b"x")
    names = lambda r: sorted(p["path"].rsplit("/", 1)[-1] for p in readers.audio_files(spark, str(tmp_path), [".wav", ".mp3"], r).collect())
    assert names(True) == ["a.WAV", "c.mp3"]
    assert readers.csv_table(spark, str(tmp_path / "none.csv"), "a string").count() == 0
    (tmp_path / "x.csv").write_text('﻿name,cell\nn,"{""a"": [1, 2]}"\n', encoding="utf-8")
    r = readers.csv_table(spark, str(tmp_path / "x.csv"), "name string, cell string").first()
    assert (r["name"], r["cell"]) == ("n", '{"a": [1, 2]}')


def test_sinks(spark, tmp_path):
    sinks.save_model(spark, {"weights": [1.5], "bias": -2}, str(tmp_path / "m"))
    assert sinks.load_model(spark, str(tmp_path / "m")) == {"weights": [1.5], "bias": -2}
    sinks.csv_report(spark.range(2), str(tmp_path / "c"))
    sinks.csv_report(spark.range(3), str(tmp_path / "c"), "append")
    assert readers.csv_table(spark, str(tmp_path / "c"), "id long").count() == 5
    sinks.json_summary(spark.range(1), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_replaced_tables_are_whole(spark, tmp_path):
    base = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        sinks.current(spark, base)
    for n in (3, 5, 7):
        sinks.replace_table(spark.range(n), base)
        assert spark.read.parquet(sinks.current(spark, base)).count() == n
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")) == ["ready-2", "ready-3", "v=2", "v=3"]
    spark.range(9).write.parquet(f"{base}/v=4")  # a writer that died before its marker
    assert spark.read.parquet(sinks.current(spark, base)).count() == 7


def test_missing_keys_are_computed_once(spark, tmp_path):
    keys = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "cache_key string, x int")
    out = sinks.cached(keys, str(tmp_path / "c"), lambda df: df.withColumn("y", F.col("x") * 10))
    assert sorted(map(tuple, out.collect())) == [("a", 1, 10), ("b", 2, 20)]
    for _ in range(2):
        sinks.append_new(keys, str(tmp_path / "l"), "cache_key", "x")
    assert sorted((r["cache_key"], r["x"]) for r in spark.read.json(str(tmp_path / "l")).collect()) == [("a", 1), ("b", 2)]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from tessitura import scratch

    held = {}
    made = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: held.get(k, d), set=held.__setitem__), sparkContext=SimpleNamespace(master="yarn"))
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://host:7077"):
        made.sparkContext.master = master
        with pytest.raises(ValueError, match="checkpoint"):
            scratch.scratch_dir(made)
    made.sparkContext.master = "local[4]"
    assert scratch.scratch_dir(made).startswith("file://") and held


def test_other_containers_go_to_the_given_decoder():
    assert signal.decode(b"OggS...", 8000, lambda data, rate: np.ones(rate)).sum() == 8000
    with pytest.raises(ValueError, match="WAV"):
        signal.decode(b"OggS...")


def test_best_scores_reduce_pairs(spark, monkeypatch):
    from tessitura.operators import vectors

    rng = np.random.default_rng(2)
    rows = lambda n, k: [(int(i % 3), float(5 * (i // 3)), [float(x) for x in rng.normal(size=4).round(1)]) for i in range(n)]
    q, r = spark.createDataFrame(rows(20, 3), "query_id long, q_off double, v array<double>"), spark.createDataFrame(rows(50, 3), "track_id long, r_off double, v array<double>").repartition(3)
    want = sorted(map(tuple, retrieval.best_per_window(vectors.pair_scores(q, r)).collect()))
    for limit in (20_000, 5):
        monkeypatch.setattr(vectors, "QUERY_ROWS", limit)
        monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
        monkeypatch.setattr(vectors, "REF_BLOCK", 11)
        best = vectors.best_scores(q, r)
        assert best.count() < 20 * 50 and sorted(map(tuple, retrieval.best_per_window(best).collect())) == want


@pytest.mark.parametrize("name", ["jn_01_all_pairs", "agg_01_best_pair", "agg_02_best_per_window", "agg_06_greedy_pairs", "agg_07_continuity", "jn_16_aligned_windows", "win_01_rank_seg_top3_centered", "win_02_rerank_in_pool"])
def test_blocks_of_one_table(spark, monkeypatch, name):
    """Beyond one block, sides that come from one table give what SQL gives."""
    from conftest import DATA
    from oracle import connect, rows_of, rows_of_sql

    from tessitura.operators import vectors
    from tessitura.plans import registry

    for k, v in {"QUERY_ROWS": 5, "QUERY_BLOCK": 60, "REF_BLOCK": 150, "STRETCH": 8, "PAIRS": 2000, "LISTED": 6000}.items():
        monkeypatch.setattr(vectors, k, v)
    assert rows_of(registry.QUERIES[name](spark, f"{DATA}/sf0.001")) == rows_of_sql(connect(f"{DATA}/sf0.001"), registry.ORACLES[name])[1]


def test_conflicts(spark):
    known = spark.createDataFrame([("k", "p"), ("n", None)], "request_key string, payload string")
    req = spark.createDataFrame([("k", "p"), ("k2", "p"), ("n", None), ("n", "q")], "request_key string, payload string")
    assert sorted(r["admission"] for r in policy.admit(req, known).collect()) == ["EXISTING", "EXISTING", "NEW", "REQUEST_ID_CONFLICT"]


def test_seeded_sample_draws_from_all_keys(spark, monkeypatch):
    import random

    monkeypatch.setattr(sampling, "MAX_GROUPS", 10)
    df = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    want = random.Random(7).sample(range(0, 3000, 3), 40)
    for parts in (1, 7):
        assert [r[0] for r in sampling.seeded_sample(df.union(df).repartition(parts), "k", 7, 40).collect()] == want
    assert sorted(r[0] for r in sampling.seeded_sample(df.limit(5), "k", 7, 9).collect()) == [0, 3, 6, 9, 12]
    assert sampling.seeded_sample(df.limit(0), "k", 7, 9).count() == 0


def test_exact_quantiles(spark):
    from tessitura.operators import metrics

    rng = np.random.default_rng(3)
    rows = [(["a", "b", None][int(k)], float(x)) for k, x in zip(rng.integers(0, 3, 500), rng.normal(size=500).round(1), strict=True)] + [("one", 2.5), ("none", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    shares = [0.5, 0.1, 0.9, 0.0, 1.0]
    got = {r["k"]: r["q"] for r in metrics.quantiles(df, F.col("x"), shares, "k").collect()}
    want = {k: np.quantile([x for j, x in rows if j == k], shares) for k in ("a", "b", None, "one")}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)
    whole = metrics.quantiles(df, F.col("x"), [0.5]).collect()
    assert len(whole) == 1 and abs(whole[0]["q"][0] - np.median([x for _, x in rows if x is not None])) < 1e-12
    assert metrics.quantiles(df.limit(0), F.col("x"), [0.5], "k").count() == 0
    none = [r for r in metrics.distribution(df, F.col("x"), "k").collect() if r["k"] == "none"][0]
    assert none["n"] == 0 and none["median"] is None
