"""Pair queries beyond one block: what the grid's cells fold, move and find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from oracle import connect, rows_of, rows_of_sql

from tessitura.operators import retrieval, vectors
from tessitura.plans import registry

BLOCKS = {"QUERY_BLOCK": 60, "REF_BLOCK": 150, "STRETCH": 8, "PAIRS": 2000, "LISTED": 6000}
NAMES = [
    "agg_02_best_per_window",
    "agg_07_continuity",
    "agg_05_greedy_top3",
    "agg_10_top_counts",
    "agg_33_top1_and_ceiling",
    "jn_11_expected_source",
    "jn_16_aligned_windows",
    "win_01_rank_max_centered",
    "win_01_rank_max_raw",
    "win_01_rank_seg_top3_centered",
    "win_01_rank_seg_top3_raw",
    "win_03_rerank_pools",
    "win_12_rank_offset",
    "win_02_rerank_in_pool",
]


@pytest.mark.parametrize("name", NAMES)
def test_beyond_one_block_as_in_sql(spark, monkeypatch, name):
    monkeypatch.setattr(vectors, "QUERY_ROWS", 5)
    for k, v in BLOCKS.items():
        monkeypatch.setattr(vectors, k, v)
    assert rows_of(registry.QUERIES[name](spark, f"{DATA}/sf0.001")) == rows_of_sql(connect(f"{DATA}/sf0.001"), registry.ORACLES[name])[1]


def test_blocks_grow_before_cells_do():
    assert vectors._sides(100, 100) == (1, 1) and vectors._sides(20_513, 82_051) == (6, 11)
    a, b = vectors._sides(123_077, 492_307)
    assert a * b < 300 and 2 * a < -(-123_077 // vectors.QUERY_BLOCK)
    a, b = vectors._sides(123_077, 492_307, tracks=0.5)  # tracks of two windows
    assert 123_077 / a * 492_307 / b * 0.5 < 1.1 * vectors.LISTED


def test_what_moves_follows_tracks_plus_blocks(spark, monkeypatch):
    for k, v in {**BLOCKS, "REF_BLOCK": 20}.items():
        monkeypatch.setattr(vectors, k, v)
    rows = lambda n: [(int(i % 8), float(5 * (i // 8)), [float(i % 3), float(i % 5)]) for i in range(n)]
    q, r = spark.createDataFrame(rows(40), "query_id long, q_off double, v array<double>"), spark.createDataFrame(rows(400), "track_id long, r_off double, v array<double>")
    best = vectors.best_scores(q, r)
    assert 40 * 8 <= best.count() <= 40 * (8 + 2 * 20)  # 20 blocks; each once held all 8 tracks
    assert retrieval.best_per_window(best).count() == 40 * 8


def test_more_partitions_than_blocks_move_no_more(spark, monkeypatch):
    rows = [(int(i % 3), float(5 * (i // 3)), [float(i % 3), float(i % 7)]) for i in range(200)]
    q, r = spark.createDataFrame(rows[:20], "query_id long, q_off double, v array<double>"), spark.createDataFrame(rows, "track_id long, r_off double, v array<double>")
    want = sorted(map(tuple, retrieval.best_per_window(vectors.pair_scores(q, r)).collect()))
    monkeypatch.setattr(type(r), "repartitionByRange", lambda self, n, *columns, f=type(r).repartitionByRange: f(self, 50, *columns))
    best = vectors.best_scores(q, r)
    assert best.count() == 20 * 3 and sorted(map(tuple, retrieval.best_per_window(best).collect())) == want


def side(rng, key, off, groups, **more):
    """Windows of few values in one stretch a group, some steps irregular, with the marks that a side carries."""
    out = []
    for g, n in enumerate(groups):
        at = np.cumsum(np.where(rng.random(n) < 0.7, 5.0, 9.0))
        one = np.r_[np.abs(np.diff(at) - 5) <= 0.51, False]
        two = one & np.r_[one[1:], False]
        out += [{key: g, off: float(at[i]), "v": [float(x) for x in rng.integers(-3, 4, 3) / 7], "n": i, "part": 0, "core": True, "one": bool(one[i]), "two": bool(two[i]), "reach": int(1 + (one + 0 + two).max()), **more} for i in range(n)]
    return out


@pytest.mark.parametrize(("tile", "most", "last"), [(8, 1, False), (8, 1, True), (600, 3, False), (8, 3, False), (10**6, 3, False)])
def test_folds_of_one_cell(monkeypatch, tile, most, last):
    """Against all pairs, with many ties after rounding, in tiles of any size."""
    monkeypatch.setattr(vectors, "PAIRS", tile)
    rng = np.random.default_rng(tile + most + last)
    extra = [("q_taken", pa.list_(pa.float64())), ("r_taken", pa.list_(pa.float64()))]
    marks = [("n", pa.int64()), ("part", pa.int64()), ("core", pa.bool_()), ("one", pa.bool_()), ("two", pa.bool_()), ("reach", pa.int32())]
    table = lambda rows, key, off, more: pa.Table.from_pylist(rows, pa.schema([(key, pa.int64()), (off, pa.float64()), ("v", pa.list_(pa.float64())), *marks, *more]))
    q, r = side(rng, "query_id", "q_off", [30, 1, 2, 9], track_id=None), side(rng, "track_id", "r_off", [1, 25, 2, 40])
    taken = {"query_id": 0, "track_id": 3, "q_taken": [q[4]["q_off"]], "r_taken": [r[50]["r_off"]]}
    ask = [*q, *([taken] if most == 1 else [])]
    schema = pa.schema([("query_id", pa.int64()), ("track_id", pa.int64()), ("windows", pa.int64()), ("score", pa.float64()), ("q_off", pa.float64()), ("r_off", pa.float64())])
    qt, rt = table(ask, "query_id", "q_off", [("track_id", pa.int64()), *extra]), table(r, "track_id", "r_off", [])
    got = {}
    for x in vectors._runs(qt, rt, 1, most, last, 10.0, schema).to_pylist():
        key, sign = (x["query_id"], x["track_id"]), 1 if last else -1
        got[key] = max(got.get(key, ()), (x["windows"], x["score"], sign * x["q_off"], sign * x["r_off"]))
    flag, want = {2: "one", 3: "two"}, {}
    for i, a in enumerate(q):
        for j, b in enumerate(r):
            key = (a["query_id"], b["track_id"])
            if most == 1 and key == (0, 3) and (abs(a["q_off"] - taken["q_taken"][0]) < 10 or abs(b["r_off"] - taken["r_taken"][0]) < 10):
                continue
            for k in range(1, most + 1):
                if k == 1 or (a[flag[k]] and b[flag[k]]):
                    s = sum(np.round(np.dot(q[i + m]["v"], r[j + m]["v"]), 1) for m in range(k))
                    want[key] = max(want.get(key, ()), (k, float(np.round(s / k, 8)), sign * a["q_off"], sign * b["r_off"]))
    assert got == want
    best = {(x["query_id"], x["track_id"], x["q_off"]): (x["score"], x["r_off"]) for x in vectors._best(qt.slice(0, len(q)).drop(["track_id"]), rt, 1).to_pylist()}
    every = {}
    for a in q:
        for b in r:
            key = (a["query_id"], b["track_id"], a["q_off"])
            x = (float(np.round(np.dot(a["v"], b["v"]), 1)), -b["r_off"])
            every[key] = max(every.get(key, x), x)
    assert {k: (s, -o) for k, (s, o) in best.items()} == every


def cell(rng, groups, width, scale, key, off, **more):
    """A side of one cell: windows with steps that are regular most times, in stretches of 8."""
    rows = []
    for x in side(rng, key, off, groups, **more):
        rows.append({**x, "v": [float(y) * scale for y in rng.integers(-3, 4, width) / 7 + rng.choice([0.0, 1e-4], width)]})
    return rows


@pytest.mark.parametrize(("scale", "digits", "screened"), [(1.0, 6, True), (1.0, 1, True), (0.01, 6, True), (3e4, 6, True), (1e16, 6, False), (float("nan"), 6, False)])
@pytest.mark.parametrize("most", [1, 3, (1, 3)])
@pytest.mark.parametrize("last", [False, True])
def test_screened_columns_hold_the_best(monkeypatch, scale, digits, screened, most, last):
    """Products in float32 say which columns are taken whole; what a cell finds is the same as without them."""
    monkeypatch.setattr(vectors, "PAIRS", 200)
    rng = np.random.default_rng(5)
    marks = [("n", pa.int64()), ("part", pa.int64()), ("core", pa.bool_()), ("one", pa.bool_()), ("two", pa.bool_()), ("reach", pa.int32())]
    none = [("track_id", pa.int64()), ("q_taken", pa.list_(pa.float64())), ("r_taken", pa.list_(pa.float64()))]
    table = lambda rows, key, off, more: pa.Table.from_pylist(rows, pa.schema([(key, pa.int64()), (off, pa.float64()), ("v", pa.list_(pa.float64())), *marks, *more]))
    q = table(cell(rng, [60, 40, 3], 6, scale, "query_id", "q_off", track_id=None), "query_id", "q_off", none)
    r = cell(rng, [1, 90, 70], 6, scale, "track_id", "r_off")
    r = table([{**x, "part": x["n"] // 10, "one": x["one"] and x["n"] % 10 < 9, "two": x["two"] and x["n"] % 10 < 8} for x in r], "track_id", "r_off", [])
    fields = ["query_id", "track_id", "windows", "score", "q_off", "r_off", "most"]
    schema = pa.schema([(f, pa.float64() if f in ("score", "q_off", "r_off") else pa.int64()) for f in fields])
    seen, real = [], vectors._candidates

    def watched(*args):
        seen.append((real(*args), args[0].shape[1]))
        return seen[-1][0]

    def best(found):
        out, sign = {}, 1 if last else -1
        for x in found.to_pylist():
            key = (x["query_id"], x["track_id"], x["most"])
            out[key] = max(out.get(key, ()), (x["windows"], x["score"], sign * x["q_off"], sign * x["r_off"]))
        return out

    monkeypatch.setattr(vectors, "_candidates", watched)
    got = best(vectors._runs(q, r, digits, most, last, 0.0, schema))
    (few, n), = seen
    assert (few is not None) == screened
    if digits == 6 and screened and scale == 1.0:
        assert all(2 * sum(map(len, x)) < n * len(x) for x in few.values())
    monkeypatch.setattr(vectors, "_candidates", lambda *args: None)
    assert got == best(vectors._runs(q, r, digits, most, last, 0.0, schema)) and (got or scale != scale)


@pytest.mark.parametrize("name", ["win_02_rerank_in_pool", "win_12_rank_offset"])
def test_reranking_makes_products_once(spark, monkeypatch, name):
    made, real = [], vectors._grid
    monkeypatch.setattr(vectors, "_grid", lambda *args: made.append(1) or real(*args))
    rows = rows_of(registry.QUERIES[name](spark, f"{DATA}/sf0.001"))
    assert len(made) == 1 and rows == rows_of_sql(connect(f"{DATA}/sf0.001"), registry.ORACLES[name])[1]


def test_listing_copies_few_windows():
    """What moves where all pairs are listed: at 615,384 vectors each window was copied 121 or 126 times, 77 million rows."""
    moved = lambda q, r, slots: (lambda nq, nr: q * nr + r * nq)(*vectors._listing(q, r, slots))
    assert moved(123_077, 492_307, 12) < 6e6 and moved(20_513, 82_051, 12) < 1.1e6 and moved(1, 0, 8) >= 1
    nq, nr = vectors._listing(10_000_000, 40_000_000, 12)
    assert 10_000_000 / nq <= vectors.PAIR_BLOCK and 40_000_000 / nr <= vectors.PAIR_BLOCK


def test_cells_list_every_pair_in_pieces(spark, monkeypatch):
    """Several cells, each of which sends many pieces; queries and tracks without partner make no rows."""
    for k, v in {"QUERY_ROWS": 5, "PAIR_BLOCK": 30, "SHARE": 1, "PAIRS": 100}.items():
        monkeypatch.setattr(vectors, k, v)
    rows = lambda n, m: [(f"k{i % m}", float(i // m), [float(i % 3), float(i % 5) - 2, 0.5]) for i in range(n)]
    q, r = spark.createDataFrame(rows(70, 4), "query_id string, q_off double, v array<double>"), spark.createDataFrame(rows(100, 6), "track_id string, r_off double, v array<double>")
    got = {tuple(x)[:4]: x["score"] for x in vectors.pair_scores(q, r).collect()}
    want = {(*a[:2], *b[:2]): float(np.dot(a[2], b[2])) for a in rows(70, 4) for b in rows(100, 6)}
    assert len(want) == 7000 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert vectors.pair_scores(q, r.limit(0)).count() == 0
