"""Boosting of tables against that of one matrix."""

from __future__ import annotations

import numpy as np
import pytest
from test_trees import some_rows

from tessitura.operators import models, trees

HOW = {"rounds": 15, "rate": 0.1, "leaves": 6, "boosted_leaf": 4, "l2": 1.0}


def matrix(rows):
    known = [r for r in rows if r[1]]
    y = np.array([r[2] for r in known])
    w = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    return np.array([r[1] for r in known]), y, w


@pytest.mark.parametrize(("held", "fold"), [(trees.BOOST_HELD, 10), (0, 4)])
def test_boosting_takes_all_rows(spark, monkeypatch, held, fold):
    """More rows than were fitted on a driver, which took a sample beyond: every row counts, by jobs as in one task."""
    monkeypatch.setattr(models, "FIT_ROWS", 50)
    monkeypatch.setattr(trees, "BOOST_HELD", held)
    monkeypatch.setattr(trees, "FOLD", fold)
    rows = [*some_rows(300, 5, 1), *some_rows(20, 5, 1), (0, None, 1.0)]
    x, y, w = matrix(rows)
    frame = trees.balanced(spark.createDataFrame(rows, "id long, v array<double>, y double").filter("v IS NOT NULL").repartition(3))
    got = models.fit_boosted(frame, HOW)
    want = trees.boost(x, y, w, 15, 0.1, 6, 4, 1.0)
    assert len(want["roots"]) == 15 and max(len(e) for e in trees.bin_edges(x)) > 200
    assert got["f"].tolist() == want["f"].tolist() and got["left"].tolist() == want["left"].tolist() and got["roots"].tolist() == want["roots"].tolist()
    assert all(np.allclose(got[k], want[k], atol=1e-9) for k in ("start", "cut", "value"))


@pytest.mark.parametrize("bins", [255, 10, 4])
def test_bin_edges_of_all_rows(spark, bins):
    rows = some_rows(500, 5, 2)
    got = trees.all_bin_edges(spark.createDataFrame(rows, "id long, v array<double>, y double").repartition(5), bins)
    want = trees.bin_edges(matrix(rows)[0], bins)
    assert len(got) == len(want) == 5 and all(a.tolist() == b.tolist() for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("held", [trees.BOOST_HELD, 0])
def test_boosting_one_class(spark, monkeypatch, held):
    monkeypatch.setattr(trees, "BOOST_HELD", held)
    frame = trees.balanced(spark.createDataFrame([(i, [float(i)], 1.0) for i in range(30)], "id long, v array<double>, y double"))
    assert len(models.fit_boosted(frame, HOW)["roots"]) == 0
