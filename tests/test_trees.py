"""Tree ensembles against plain versions with the same draws and bins, and the classifier queries end to end."""

from __future__ import annotations

import math
import random
import struct

import numpy as np
import pytest
import xxhash
from conftest import DATA

from tessitura.operators import models, trees
from tessitura.plans import registry

M = (1 << 64) - 1


def spark_hash(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64(struct.pack("<q", v), seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def some_rows(n, width, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = float(rng.random() < 0.3)
        v = [round(rng.gauss(y * (f % 3), 1), 3 if f % 2 else 0) for f in range(width - 1)] + [7.0]  # the last is constant
        rows.append((i, v, y))
    return rows


def plain_extra_tree(rows, t, leaf, share, depth, seed):
    """rows: (v, y, w). Nodes by number: (f, cut, value, n)."""
    width, out = len(rows[0][0]), {}
    todo = [(0, rows)]
    while todo:
        node, own = todo.pop()
        w, p = sum(r[2] for r in own), sum(r[2] for r in own if r[1])
        best = None
        level = (node + 1).bit_length() - 1
        if len(own) >= 2 * leaf and 0 < sum(r[1] for r in own) < len(own) and level < depth:
            drawn = []
            for f in range(width):
                low, high = min(r[0][f] for r in own), max(r[0][f] for r in own)
                if low < high:
                    cut = low + (spark_hash(seed, t, node, f) & (1 << 53) - 1) / 2**53 * (high - low)
                    drawn.append((spark_hash(seed + 1, t, node, f), f, cut if cut < high else low))
            for j, (_, f, cut) in enumerate(sorted(drawn)[: max(1, int(share * width))]):
                left, right = [r for r in own if r[0][f] <= cut], [r for r in own if r[0][f] > cut]
                if min(len(left), len(right)) >= leaf:
                    gain = 0.0
                    for side in (left, right):
                        sw, sp = sum(r[2] for r in side), sum(r[2] for r in side if r[1])
                        gain += (sp * sp + (sw - sp) ** 2) / sw
                    if best is None or (round(gain, 9), -j) > best[0]:
                        best = ((round(gain, 9), -j), f, cut, left, right)
        out[node] = (best and best[1], best and best[2], p / w, len(own))
        if best:
            todo += [(2 * node + 1, best[3]), (2 * node + 2, best[4])]
    return out


@pytest.mark.parametrize(("depth", "subtree"), [(None, 0), (3, 0), (None, 40), (3, 40), (None, 8192), (3, 8192)])
def test_extra_trees_equal_a_plain_version_by_subtrees(spark, monkeypatch, depth, subtree):
    """By levels alone, by levels and then in groups, in groups alone; in groups a forest takes few jobs, however deep."""
    monkeypatch.setattr(trees, "SUBTREE", subtree)
    tables = []
    monkeypatch.setattr(trees, "settle", lambda df, tag, f=trees.settle: tables.append(tag) or f(df, tag))
    test_extra_trees_equal_a_plain_version(spark, depth)
    assert len(tables) == 4 if subtree == 8192 else len(tables) > 8


@pytest.mark.parametrize("depth", [None, 3])
def test_extra_trees_equal_a_plain_version(spark, depth):
    rows = some_rows(300, 7, 1)
    frame = trees.balanced(spark.createDataFrame([*rows], "id long, v array<double>, y double").repartition(3))
    n, ones = len(rows), sum(r[2] for r in rows)
    weighted = [(v, y > 0, n / (2 * (ones if y else n - ones))) for _, v, y in rows]
    forest = trees.fit_extra_trees(frame, 8, leaf=3, share=0.75, depth=depth, seed=5)
    got = {}
    for r in forest.collect():
        got.setdefault(r["tree"], {})[r["node"]] = (r["f"], r["cut"], r["value"], r["n"])
    want = {t: plain_extra_tree(weighted, t, 3, 0.75, 60 if depth is None else depth, 5) for t in range(8)}
    assert {t: {k: v[0] for k, v in x.items()} for t, x in got.items()} == {t: {k: v[0] for k, v in x.items()} for t, x in want.items()}
    assert all(got[t][k][3] == v[3] and math.isclose(got[t][k][2], v[2], abs_tol=1e-9) and (v[1] is None or math.isclose(got[t][k][1], v[1], rel_tol=1e-12)) for t, x in want.items() for k, v in x.items())
    assert max(len(x) for x in want.values()) > (15 if depth is None else 7) and len({x[0][1] for x in want.values()}) == 8

    def walk(t, v):
        k = 0
        while want[t][k][0] is not None:
            k = 2 * k + (1 if v[want[t][k][0]] <= want[t][k][1] else 2)
        return want[t][k][2]

    test = [*some_rows(40, 7, 2), (99, None, 0.0)]
    scored = {r["id"]: r["probability"] for r in trees.score_extra_trees(spark.createDataFrame(test, "id long, v array<double>, y double"), forest).collect()}
    assert scored.pop(99) is None and all(math.isclose(p, sum(walk(t, test[i][1]) for t in range(8)) / 8, abs_tol=1e-9) for i, p in scored.items()) and len(scored) == 40


def test_forest_in_chunks_and_empty(spark, monkeypatch):
    frame = trees.balanced(spark.createDataFrame(some_rows(60, 4, 3), "id long, v array<double>, y double"))
    forest = trees.fit_extra_trees(frame, 5, leaf=2)
    once = {r["id"]: r["probability"] for r in trees.score_extra_trees(frame, forest).collect()}
    monkeypatch.setattr(trees, "NODES", 10)
    again = {r["id"]: r["probability"] for r in trees.score_extra_trees(frame, forest).collect()}
    assert once.keys() == again.keys() and all(math.isclose(once[k], again[k], abs_tol=1e-12) for k in once)
    none = trees.fit_extra_trees(frame.limit(0), 5)
    assert none.count() == 0 and trees.score_extra_trees(frame, none).filter("probability IS NULL").count() == 60


def plain_boost(x, y, w, edges, rounds, rate, leaves, leaf, l2):
    """Raw scores of the rows of x after all rounds, by loops over rows."""
    n, width = len(x), len(x[0])
    bins = [[sum(e < x[i][f] for e in edges[f]) for f in range(width)] for i in range(n)]
    mean = sum(a * b for a, b in zip(y, w, strict=True)) / sum(w)
    raw = [math.log(mean / (1 - mean))] * n
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-r)) for r in raw]
        g, h = [w[i] * (p[i] - y[i]) for i in range(n)], [w[i] * p[i] * (1 - p[i]) for i in range(n)]

        def best(rows, g=g, h=h):
            total, hess = sum(g[i] for i in rows), sum(h[i] for i in rows)
            found = (0.0, None, None)
            for f in range(width):
                for b in range(len(edges[f])):
                    left = [i for i in rows if bins[i][f] <= b]
                    gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                    if min(len(left), len(rows) - len(left)) < leaf or min(hl, hess - hl) < 1e-3:
                        continue
                    gain = round(gl**2 / (hl + l2) + (total - gl) ** 2 / (hess - hl + l2) - total**2 / (hess + l2), 9)
                    if gain > found[0]:
                        found = (gain, f, b)
            return found

        open_ = [(best(range(n)), list(range(n)))]
        while len(open_) < leaves:
            k = max(range(len(open_)), key=lambda i: open_[i][0][0])
            gain, f, b = open_[k][0]
            if gain <= 0:
                break
            rows = open_.pop(k)[1]
            for side in ([i for i in rows if bins[i][f] <= b], [i for i in rows if bins[i][f] > b]):
                open_.append((best(side), side))
        for _, rows in open_:
            step = -sum(g[i] for i in rows) / (sum(h[i] for i in rows) + l2) * rate
            for i in rows:
                raw[i] += step
    return raw


@pytest.mark.parametrize(("seed", "bins", "leaves"), [(1, 255, 6), (2, 4, 3), (3, 8, 12)])
def test_boosting_equals_a_plain_version(spark, seed, bins, leaves):
    rows = some_rows(70, 4, seed)
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    w = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    model = trees.boost(x, y, w, 12, 0.1, leaves, 4, 1.0, bins)
    want = plain_boost(x.tolist(), y.tolist(), w.tolist(), trees.bin_edges(x, bins), 12, 0.1, leaves, 4, 1.0)
    got = {r["id"]: r["probability"] for r in trees.score_boosted(spark.createDataFrame([*rows, (500, None, 0.0)], "id long, v array<double>, y double"), model).collect()}
    assert got.pop(500) is None and all(math.isclose(got[i], 1 / (1 + math.exp(-r)), abs_tol=1e-9) for i, r in enumerate(want))
    assert len(model["roots"]) == 12 and max(len(e) for e in trees.bin_edges(x, bins)) < bins


def test_one_class_and_quantile_bins():
    x = np.arange(1000.0)[:, None]
    assert len(trees.bin_edges(x, 10)[0]) == 9 and abs(trees.bin_edges(x, 10)[0][4] - 499.5) < 1
    only = trees.boost(x[:20], np.ones(20), np.ones(20), 5, 0.1, 4, 2, 1.0)
    assert len(only["roots"]) == 0


@pytest.mark.parametrize("level", [models.PAIR_LEVEL, models.QUERY_LEVEL])
def test_classifiers_fit_and_score(spark, level):
    """All four tell held-out rows apart; the logistic model is where its weighted objective has no slope."""
    how = {**level, "trees": 20, "rounds": 30}
    train, test = (spark.createDataFrame(some_rows(n, 5, s), "id long, v array<double>, y double") for n, s in ((300, 1), (120, 2)))
    got = {}
    for r in models.fit_all(train, test, how).collect():
        got.setdefault(r["model"], {})[r["id"]] = (r["y"], r["probability"])
    assert {m: len(x) for m, x in got.items()} == dict.fromkeys(("logistic", "forest", "extra", "boosted"), 120)
    for m, x in got.items():
        pos, neg = [p for y, p in x.values() if y], [p for y, p in x.values() if not y]
        assert sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg)) > 0.8, m
        assert 0.3 < np.mean(pos + neg) < 0.6, m  # classes weigh the same, though three rows in ten are positive


@pytest.mark.parametrize(("name", "key"), [("udf_03_pair_classifiers", "user_id"), ("udf_04_query_classifiers", "query_id")])
def test_classifier_queries(spark, monkeypatch, name, key):
    """Parameters are the reference's; the query runs whole, with fewer trees and rounds to spare time."""
    assert (models.PAIR_LEVEL["trees"], models.QUERY_LEVEL["trees"], models.PAIR_LEVEL["rounds"]) == (500, 800, 250)
    for level in ("PAIR_LEVEL", "QUERY_LEVEL"):
        monkeypatch.setattr(models, level, {**getattr(models, level), "trees": 10, "rounds": 10})
    rows = registry.QUERIES[name](spark, f"{DATA}/sf0.01").collect()
    ids = {m: sorted(r[key] for r in rows if r["model"] == m) for m in ("logistic", "forest", "extra", "boosted")}
    assert len(rows) == sum(map(len, ids.values())) and len(set(map(tuple, ids.values()))) == 1 and len(ids["extra"]) > 15
    assert all(0 <= r["probability"] <= 1 for r in rows)
