"""Registered queries cover whole tables: counted and worked out here without their SQL."""

from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import DATA

from tessitura.operators import signal
from tessitura.plans import q_signal, registry

FOLDER = f"{DATA}/sf0.001"


def table(name):
    return pq.read_table(f"{FOLDER}/{name}.parquet").to_pylist()


def run(spark, name):
    return registry.QUERIES[name](spark, FOLDER).collect()


@pytest.mark.parametrize(("name", "of"), [("scl_01_l2_normalise", lambda v: v / np.sqrt(v @ v)), ("scl_26_peak_normalise", lambda v: v * 0.98 / np.abs(v).max()), ("scl_27_reorder_blocks", lambda v: np.concatenate([v[20:40], v[:20], v[40:60], v[20:40]]))])
def test_every_vector(spark, name, of):
    got = {(r["vec_id"], r["dim"]): r["x"] for r in run(spark, name)}
    want = {(e["vec_id"], i + 1): x for e in table("embeddings") for i, x in enumerate(of(np.array(e["embedding"], dtype=np.float64)))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_every_window_is_centred(spark):
    e = sorted(table("embeddings"), key=lambda r: r["vec_id"])
    mean = np.mean([r["embedding"] for r in e if r["vec_id"] % 5], axis=0, dtype=np.float64)
    at, want = {}, {}
    for r in e:
        k = (r["label"], "reference" if r["vec_id"] % 5 else "query")
        v = np.array(r["embedding"], dtype=np.float64) - mean
        want |= {(*k, 5.0 * at.get(k, 0), i + 1): x for i, x in enumerate(v / np.sqrt(v @ v))}
        at[k] = at.get(k, 0) + 1
    got = {(r["track_id"], r["role"], r["offset_s"], r["dim"]): r["x"] for r in run(spark, "scl_02_centre_normalise")}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_windows_of_long_documents_and_every_event(spark):
    want = {(r["doc_id"], s) for r in table("documents") for s in range(0, r["n_chars"] - 479, 240)}
    assert max(s for _, s in want) > 3000 and {tuple(r) for r in run(spark, "scl_05_full_windows")} == want
    assert {(r["event_id"], float(r["rounded"])) for r in run(spark, "scl_31_half_even_rounding")} == {(r["event_id"], round(r["event_id"] / 8, 2)) for r in table("events")}


def test_chroma_of_every_pair(spark):
    by = {}
    for r in sorted(table("embeddings"), key=lambda r: r["vec_id"]):
        by.setdefault(r["label"], []).append(r)
    pairs = {a["vec_id"]: (a["embedding"], b["embedding"]) for v in by.values() for a, b in zip(v, v[1:], strict=False)}
    got = {r["vec_id"]: r for r in run(spark, "scl_16_compare_chroma")}
    assert got.keys() == pairs.keys() and all(r["error"] is None for r in got.values())
    long = lambda v: signal._unit(np.tile(q_signal._frames(v), (60, 1)))
    for i in sorted(pairs)[-5:]:
        want = signal.compare_chroma(long(pairs[i][0]), long(pairs[i][1]))
        assert all(abs(got[i][k] - want[k]) < 2e-6 for k in ("top3_mean", "best_segment", "best_query_s", "best_candidate_s"))


def test_every_pair_of_windows(spark):
    e = sorted(table("embeddings"), key=lambda r: r["vec_id"])
    at, rows = {}, []
    for r in e:
        k = (r["label"], r["vec_id"] % 5 == 0)
        rows.append((k[1], r["label"], 5.0 * at.get(k, 0), np.array(r["embedding"], dtype=np.float64)))
        at[k] = at.get(k, 0) + 1
    want = {(a, i, b, j): x @ y for q, a, i, x in rows if q for p, b, j, y in rows if not p}
    got = {(r["query_id"], r["q_off"], r["track_id"], r["r_off"]): r["score"] for r in run(spark, "jn_01_all_pairs")}
    assert got.keys() == want.keys() and min(got.values()) < 0 and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def descent(x, y):
    """Probabilities of any rows after 6,000 steps, in exact form: coefficients as one vector over (features, 1)."""
    unit = lambda v: np.c_[(v - x.mean(0)) / np.maximum(x.std(0), 1e-6), np.ones(len(v))]
    chance = lambda v, t: 1 / (1 + np.exp(-np.clip(unit(v) @ t, -30, 30)))
    by_row = np.where(y == 1, max(1.0, (y == 0).sum() / max(1, (y == 1).sum())), 1.0)
    theta = np.zeros(x.shape[1] + 1)
    for k in range(6000):
        slope = np.average(unit(x) * (chance(x, theta) - y)[:, None], axis=0, weights=by_row)
        slope[:-1] += 0.002 * theta[:-1]
        theta -= 0.08 / (1 + k / 2000) * slope
    return lambda v: chance(v, theta)


def test_verifiers_take_all_steps(spark):
    rows = {r["user_id"]: r for r in q_signal.labelled(spark, FOLDER).collect()}
    x, y = np.array([r["v"] for r in rows.values()]), np.array([r["y"] for r in rows.values()])
    want = dict(zip(rows, descent(x, y)(x), strict=True))
    got = {r["user_id"]: r["probability"] for r in run(spark, "udf_02_pair_verifier")}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-4 for k in want)
    family, want = np.array([r["family"] for r in rows.values()]), {}
    for f in set(family):
        want |= dict(zip(np.array(list(rows))[family == f], descent(x[family != f], y[family != f])(x[family == f]), strict=True))
    got = {r["user_id"]: r["probability"] for r in run(spark, "udf_06_leave_one_family_out")}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-4 for k in want)


def test_features_of_every_event(spark):
    by = {}
    for r in table("events"):
        by.setdefault(r["user_id"], []).append((round(r["value"] % 60, 3), round((r["value"] * 7) % 60, 3), r["event_id"] % 3))
    assert max(map(len, by.values())) > 6
    got = {r["user_id"]: r for r in run(spark, "scl_17_temporal_evidence")}
    assert got.keys() == by.keys()
    for user, segments in by.items():
        q, r, shift = zip(*sorted(segments), strict=True)
        n, up = len(q), [b >= a for a, b in zip(r, r[1:], strict=False)]
        best = length = 1
        for x in up:
            length = length + 1 if x else 1
            best = max(best, length)
        assert got[user]["matched"] == n and got[user]["chain_s"] == min(10.0 * best, 30 + user % 50) and abs(got[user]["ordered_fraction"] - sum(up) / max(1, n - 1)) < 2e-6
        assert abs(got[user]["shift_consistency"] - max(map(shift.count, shift)) / n) < 2e-6
