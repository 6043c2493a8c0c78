"""Count vectors of shingle sets and R-trees over them.

A set's shingles are hashed into G groups, G a power of two of about the set's size (``LEAST`` to ``MOST``), and counted.
The overlap of two sets is at most the sum of their smaller counts. Counts are kept as bit planes (plane t tells where a
count exceeds t): the sum of minima is then the number of bits two vectors share, and an R-tree node's largest counts are
the bits that any of its points has. Vectors of 2 G groups fold into G by adding halves, so neighbouring sizes compare.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .shingles import U

LEAST, MOST, LEAF, ALL_PAIRS, CHUNK = 64, 4096, 16, 16, 1 << 14


def group_count(n: np.ndarray) -> np.ndarray:
    """Groups of sets of n shingles: the power of two at n or above."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), LEAST, MOST)


def count_vectors(flat: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Counts of each set's groups, one byte each, or two where a count needs them."""
    n = np.diff(offsets)
    g = group_count(n)
    base = np.r_[0, np.cumsum(g)]
    owner = np.repeat(np.arange(len(n)), n)
    counts = np.bincount(base[owner] + ((flat >> U(24)).astype(np.int64) & (g[owner] - 1)), minlength=int(base[-1]))
    return [(v.astype(np.uint8) if v.max(initial=0) < 256 else v.astype("<u2")).tobytes() for v in (counts[a:b] for a, b in zip(base[:-1], base[1:], strict=True))]


def _planes(counts: np.ndarray) -> np.ndarray:
    top = max(1, int(counts.max(initial=0)))
    return np.concatenate([np.packbits(counts > t, axis=1) for t in range(top)], axis=1).view(U)


class CountTree:
    """R-tree over bit planes, bulk loaded by size; nodes keep the largest counts and the sizes they span."""

    def __init__(self, planes: np.ndarray, sizes: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        n = sizes[self.order]
        self.levels = [(planes[self.order], n, n)]
        while len(self.levels[-1][1]) > 1:
            top, low, high = self.levels[-1]
            starts = np.arange(0, len(low), LEAF)
            self.levels.append((np.bitwise_or.reduceat(top, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)))

    def _open(self, depth: int, q: np.ndarray, n: np.ndarray, qi: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
        """Which (query, node) may hold a point that reaches the threshold."""
        top, low, high = self.levels[depth]
        need = percent * (n[qi] + low[at])
        keep = (100 + percent) * np.minimum(high[at], n[qi]) >= need
        for s in range(0, len(qi), CHUNK):
            k = s + np.flatnonzero(keep[s : s + CHUNK])
            keep[k] = (100 + percent) * np.bitwise_count(top[at[k]] & q[qi[k]]).sum(axis=1, dtype=np.int64) >= need[k]
        return keep

    def reaching(self, q: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) of every pair whose summed minima reach the threshold."""
        left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        step = max(1, (1 << 20) // len(self.order))
        for s in range(0, len(n), step):
            qi = np.arange(s, min(len(n), s + step))
            at = np.zeros(len(qi), dtype=np.int64)
            for depth in range(len(self.levels) - 1, -1, -1):
                keep = self._open(depth, q, n, qi, at, percent)
                qi, at = qi[keep], at[keep]
                if depth:
                    qi, at = np.repeat(qi, LEAF), (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                    inside = at < len(self.levels[depth - 1][1])
                    qi, at = qi[inside], at[inside]
            left.append(qi)
            right.append(self.order[at])
        return np.concatenate(left), np.concatenate(right)


def reaching_pairs(vectors: list, n: np.ndarray, label: np.ndarray, part: np.ndarray, percent: int = 80) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the pairs i < j of one label and, where parts differ within a label, of two parts, whose summed
    minima reach the threshold; score is that bound over the overlap needed. label must be sorted."""
    g = group_count(n)
    begin = np.flatnonzero(np.r_[True, label[1:] != label[:-1]]) if len(label) else np.zeros(0, dtype=np.int64)
    end = np.r_[begin[1:], len(label)].astype(np.int64)
    across = np.repeat(np.minimum.reduceat(part, begin) != np.maximum.reduceat(part, begin), end - begin) if len(begin) else np.zeros(0, dtype=bool)
    size = np.repeat(end - begin, end - begin)
    out = []
    for res in np.unique(g).tolist():
        # points at this resolution: those of its own and the next sizes up that may still link with them
        idx = np.flatnonzero((g == res) | ((g == 2 * res) & (4 * n <= 5 * res)))
        raw = [np.frombuffer(vectors[i], dtype=np.uint8 if len(vectors[i]) == g[i] else "<u2") for i in idx]
        planes = _planes(np.stack([v.reshape(-1, res).sum(axis=0, dtype=np.uint32) if len(v) > res else v for v in raw]))
        own, where = g[idx] == res, np.full(len(n), -1)
        where[idx] = np.arange(len(idx))
        # small blocks: all pairs, all blocks at once
        few = np.flatnonzero(size[idx] <= ALL_PAIRS)
        last = np.searchsorted(label[idx[few]], label[idx[few]], side="right")
        more = last - np.arange(len(few)) - 1
        a = np.repeat(np.arange(len(few)), more)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(more) - more, more)
        pairs = [(few[a], few[b])]
        for s, e in zip(begin[end - begin > ALL_PAIRS].tolist(), end[end - begin > ALL_PAIRS].tolist(), strict=True):
            here = where[s:e][where[s:e] >= 0]
            asks = here[own[here]]
            if len(asks):
                qi, at = CountTree(planes[here], n[idx[here]]).reaching(planes[asks], n[idx[asks]], percent)
                qi, at = asks[qi], here[at]
                once = (qi < at) | ~own[at]
                pairs.append((np.minimum(qi, at)[once], np.maximum(qi, at)[once]))
        a, b = (np.concatenate([p[k] for p in pairs]) for k in range(2))
        x, y = idx[a], idx[b]
        fit = (own[a] | own[b]) & (~across[x] | (part[x] != part[y])) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        a, b, x, y = a[fit], b[fit], x[fit], y[fit]
        for s in range(0, len(a), CHUNK):
            k = slice(s, s + CHUNK)
            need = percent * (n[x[k]] + n[y[k]])
            bound = np.minimum(np.bitwise_count(planes[a[k]] & planes[b[k]]).sum(axis=1, dtype=np.int64), np.minimum(n[x[k]], n[y[k]]))
            ok = (100 + percent) * bound >= need
            out.append((x[k][ok], y[k][ok], (100 + percent) * bound[ok] / need[ok]))
    none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
    return tuple(np.concatenate([none[k], *(o[k] for o in out)]) for k in range(3))


def by_pivots(label: np.ndarray, least: int, near: Callable[[int, np.ndarray], np.ndarray], rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(component, its first position, of each; whether a label's members are one component) from comparisons with a few
    pivots: near(i, others) tells which of others reach i. Labels of ``least`` members and more; label must be sorted.

    A label whose members all join needs no pairs: a pair of joined members can't change a component. A pivot that joins
    few ends its label's rounds, which leaves all pairs of it open.
    """
    comp, whole = np.arange(len(label)), np.zeros(len(label), dtype=bool)
    begin = np.flatnonzero(np.r_[True, label[1:] != label[:-1]]) if len(label) else np.zeros(0, dtype=np.int64)
    for s, e in zip(begin.tolist(), [*begin[1:].tolist(), len(label)], strict=True):
        if e - s < least:
            continue
        own = comp[s:e]  # a view
        for turn in range(rounds):
            pivot = 0 if turn == 0 else int(np.flatnonzero(own != own[0])[0])  # the first outside the first one's component
            others = np.flatnonzero(own != own[pivot])
            hit = others[near(s + pivot, s + others)]
            joined = np.isin(own, np.r_[own[pivot], own[hit]])
            own[joined] = own[joined].min()
            if (own == own[0]).all():
                whole[s:e] = True
                break
            if 8 * len(hit) < len(others):
                break
    return comp, whole


def bounds_reach(vectors: list, n: np.ndarray, percent: int = 80) -> Callable[[int, np.ndarray], np.ndarray]:
    """near() of ``by_pivots`` by summed minima of count vectors, folded to the coarser of the two."""
    g = group_count(n)
    counts = lambda i: np.frombuffer(vectors[i], dtype=np.uint8 if len(vectors[i]) == g[i] else "<u2").astype(np.int64)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        p, out = counts(i), np.zeros(len(others), dtype=bool)
        fit = 100 * np.minimum(n[i], n[others]) >= percent * np.maximum(n[i], n[others])
        for k in np.flatnonzero(fit).tolist():
            j = int(others[k])
            res = min(len(p), g[j])
            both = np.minimum(p.reshape(-1, res).sum(axis=0), counts(j).reshape(-1, res).sum(axis=0)).sum()
            out[k] = (100 + percent) * both >= percent * (n[i] + n[j])
        return out

    return near


def roots(k: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest node that the edges a-b reach from each of k nodes, starting from an earlier answer if there is one."""
    label = np.arange(k) if label is None else label.copy()
    while True:
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if np.array_equal(low, high):
            return label
        np.minimum.at(label, high, low)
        while not np.array_equal(jumped := label[label], label):
            label = jumped
