"""Random forests against a plain version with the same bags and draws, by levels, in groups and whole."""

from __future__ import annotations

import math

import pytest
from test_trees import some_rows, spark_hash

from tessitura.operators import models, trees


def bag(tree, ids, seed):
    """Poisson draws of mean 1, by their cumulative shares."""
    out = {}
    for i in ids:
        u, k, share = (spark_hash(seed + 2, tree, i) & (1 << 53) - 1) / 2**53, 0, math.exp(-1)
        below = share
        while u >= below and k < 18:
            k += 1
            share /= k
            below += share
        out[i] = k
    return out


def plain_tree(rows, t, leaf, share, depth, seed):
    """rows: (v, y, id). Nodes by number: (f, cut, value, n)."""
    k = bag(t, [r[2] for r in rows], seed)
    whole, ones = sum(k.values()), sum(k[i] for _, y, i in rows if y)
    own = [(v, y, k[i] * whole / (2 * (ones if y else whole - ones))) for v, y, i in rows if k[i]]
    width, out, todo = len(rows[0][0]), {}, [(0, own)]
    while todo:
        node, own = todo.pop()
        w, p = sum(r[2] for r in own), sum(r[2] for r in own if r[1])
        best = None
        if len(own) >= 2 * leaf and 0 < sum(r[1] for r in own) < len(own) and (node + 1).bit_length() - 1 < depth:
            drawn = sorted((spark_hash(seed + 1, t, node, f), f) for f in range(width) if len({r[0][f] for r in own}) > 1)
            for j, (_, f) in enumerate(drawn[: max(1, int(share * width))]):
                values = sorted({r[0][f] for r in own})
                for a, b in zip(values, values[1:], strict=False):
                    left, right = [r for r in own if r[0][f] <= a], [r for r in own if r[0][f] > a]
                    if min(len(left), len(right)) >= leaf:
                        gain = 0.0
                        for side in (left, right):
                            sw, sp = sum(r[2] for r in side), sum(r[2] for r in side if r[1])
                            gain += (sp * sp + (sw - sp) ** 2) / sw
                        if best is None or (round(gain, 9), -j, -a) > best[0]:
                            best = ((round(gain, 9), -j, -a), f, (a + b) / 2, left, right)
        out[node] = (best and best[1], best and best[2], p / w, len(own))
        if best:
            todo += [(2 * node + 1, best[3]), (2 * node + 2, best[4])]
    return out


def walk(tree, v):
    k = 0
    while tree[k][0] is not None:
        k = 2 * k + (1 if v[tree[k][0]] <= tree[k][1] else 2)
    return tree[k][2]


@pytest.mark.parametrize(("depth", "subtree"), [(3, 0), (None, 40), (None, 8192)])
def test_forest_equals_a_plain_version(spark, monkeypatch, depth, subtree):
    """Copies of a row have draws of their own; all rows and values count, and no node is fitted on a driver."""
    raw = [*some_rows(150, 5, 1), *some_rows(40, 5, 1)]
    frame = trees.told_apart(spark.createDataFrame([*raw, (0, None, 1.0)], "id long, v array<double>, y double").repartition(3))
    rows = [(r["v"], r["y"] > 0, r["id"]) for r in frame.collect()]
    assert len(rows) == 190 and len({r[2] for r in rows}) == 190 and len({str(r[:2]) for r in rows}) == 150
    want = [plain_tree(rows, t, 3, 0.75, 60 if depth is None else depth, 5) for t in range(6)]
    assert len({len(x) for x in want}) > 1 and all(5 < len(x) for x in want) and {x[0][3] for x in want} != {190}

    test = [*some_rows(40, 5, 2), (99, None, 0.0)]
    asked = spark.createDataFrame(test, "id long, v array<double>, y double")
    chance = {i: sum(walk(x, v) for x in want) / 6 for i, v, _ in test if v}
    monkeypatch.setattr(trees, "SUBTREE", subtree)
    got = {}
    for r in trees.fit_forest(frame, 6, leaf=3, share=0.75, depth=depth, seed=5).collect():
        got.setdefault(r["tree"], {})[r["node"]] = r
    assert {t: {k: r["f"] for k, r in x.items()} for t, x in got.items()} == {t: {k: v[0] for k, v in x.items()} for t, x in enumerate(want)}
    assert all(got[t][k]["n"] == v[3] and math.isclose(got[t][k]["value"], v[2], abs_tol=1e-9) and (v[1] is None or math.isclose(got[t][k]["cut"], v[1], abs_tol=1e-12)) for t, x in enumerate(want) for k, v in x.items())
    for held in (trees.HELD, 0):
        monkeypatch.setattr(trees, "HELD", held)
        scored = {r["id"]: r["probability"] for r in trees.grow_and_score(trees.balanced(frame), asked, 6, 3, 0.75, depth, 5, True).collect()}
        assert scored.pop(99) is None and scored.keys() == chance.keys() and all(math.isclose(scored[i], p, abs_tol=1e-9) for i, p in chance.items())


def test_extra_trees_grown_whole_equal_those_of_groups(spark, monkeypatch):
    frame = trees.balanced(trees.told_apart(spark.createDataFrame(some_rows(300, 7, 1), "id long, v array<double>, y double")))
    test = spark.createDataFrame(some_rows(40, 7, 2), "id long, v array<double>, y double").repartition(3)
    got = []
    for held in (trees.HELD, 0):
        monkeypatch.setattr(trees, "HELD", held)
        got.append({r["id"]: r["probability"] for r in trees.grow_and_score(frame, test, 8, 3, 0.75, None, 5, False).collect()})
    assert len(got[0]) == 40 and got[0].keys() == got[1].keys() and all(math.isclose(p, got[1][i], abs_tol=1e-9) for i, p in got[0].items())


def test_classifiers_gather_no_forest(spark, monkeypatch):
    """The driver meets no nodes of the 500 and 800 trees: none are collected, and Spark's own forest, whose nodes lie there, isn't used."""
    monkeypatch.setattr(trees, "score_extra_trees", None)
    assert not hasattr(models, "RandomForestClassifier")
    train, test = (spark.createDataFrame(some_rows(n, 5, s), "id long, v array<double>, y double") for n, s in ((120, 1), (60, 2)))
    rows = models.fit_all(train, test, {**models.PAIR_LEVEL, "trees": 20, "rounds": 10}).filter("model IN ('forest', 'extra')").collect()
    assert len(rows) == 120 and all(0 <= r["probability"] <= 1 for r in rows)
    monkeypatch.undo()
    assert trees.grow_and_score(trees.balanced(trees.told_apart(train.limit(0))), test, 5, 3, 0.75, None, 5, True).filter("probability IS NULL").count() == 60
