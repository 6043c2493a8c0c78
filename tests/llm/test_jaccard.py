"""N-gram Jaccard join against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from fixtures import DOC, brute_components, clashing, docs, shingle_set
from hypothesis import given, settings
from hypothesis import strategies as st

from tessitura.llm import count_tree, jaccard_join, shingles

ODD = ["", None, " ", "a", "a b c d", "a b c d e", "A B C D e f", " a\tb\x0bc d e", "x" * 300_000, " ".join(f"w{i % 7}" for i in range(90_000)), "\xa0a b", "é É e f g h", "😀 a b c d 😀", "a b c d e a b c d e"]


@pytest.mark.parametrize("piece", [64, 1 << 20])
def test_shingles(piece, monkeypatch):
    monkeypatch.setattr(shingles, "PIECE", piece)
    flat, offsets = shingles.shingle_sets(pa.array(ODD))
    for i, a in enumerate(ODD):
        assert offsets[i + 1] - offsets[i] == len(shingle_set(a))
        for j in range(i):
            common = np.intersect1d(flat[offsets[i] : offsets[i + 1]], flat[offsets[j] : offsets[j + 1]])
            assert len(common) == len(shingle_set(a) & shingle_set(ODD[j]))


def test_shingles_of_a_slice():
    whole = pa.array(["p q r s t u", *ODD])
    a, b = shingles.shingle_sets(whole.slice(1)), shingles.shingle_sets(pa.array(ODD))
    assert all((x == y).all() for x, y in zip(a, b, strict=True))


def near_copies(seed, groups=12, copies=6, passages=0.15):
    """Groups of copies of many grades, long and short, some with a passage that all share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    passage = " ".join(word() for _ in range(60))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice((4, 6, 9, 20, 60, 150, 400)))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 60 + 1)):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                w += [word() for _ in range(rng.randrange(1, 1 + max(1, len(w) // 5)))]
            out.append(" ".join(w) + (" " + passage if rng.random() < passages else ""))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "all_pairs", "small", "local", "hot", "copies"), [(1, 16, 64, 1000, 1000, 6), (2, 2, 3, 1000, 1000, 30), (3, 2, 3, 2, 1000, 30), (4, 4, 8, 3, 5, 30), (5, 16, 64, 32, 3, 8)])
def test_components(spark, monkeypatch, seed, all_pairs, small, local, hot, copies):
    monkeypatch.setattr(count_tree, "ALL_PAIRS", all_pairs)
    monkeypatch.setattr(count_tree, "LEAF", 3)
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "LEAST_PART", 3 if small < 64 else 128)
    texts = near_copies(seed, copies=copies, passages=0.4 if hot < 10 else 0.15) + ODD[:10] + ["a b c d", "A  b c D"]
    ids = random.Random(seed).sample(range(10_000), len(texts))
    got = jaccard_join.near_components(clashing(docs(spark, texts, ids)).repartition(3), local=local, hot=hot)
    assert sorted(tuple(r)[:3] for r in got.collect()) == sorted(brute_components(texts, ids))


def test_join_edges(spark):
    assert jaccard_join.near_components(docs(spark, ["a"]).limit(0)).count() == 0
    got = sorted(tuple(r)[:3] for r in jaccard_join.near_components(docs(spark, ["a b", "a b", None], [3, 3, 5])).collect())
    assert got == [(3, 1, 3), (3, 1, 3), (5, 0, 5)]
    nulls = spark.createDataFrame([(None, "a b c d e f", "en", "s", 1), (7, "a b c d e f", "en", "s", 1)], DOC)
    assert {(r["doc_id"], r["component_id"]) for r in jaccard_join.near_components(nulls).collect()} == {(None, 7), (7, 7)}


@given(st.integers(4, 120), st.integers(0, 30), st.integers(0, 30), st.integers(0, 10_000), st.booleans())
@settings(max_examples=150, deadline=None)
def test_linking_pairs_are_filed_together(n, cut, add, seed, some_late):
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(1, 1 << 63, n + add + 5, dtype=np.uint64))
    a, b = pool[:n], np.r_[pool[min(cut, n - 1) : n], pool[n : n + add]]
    common = len(np.intersect1d(a, b))
    if not jaccard_join.links(len(a), len(b), common) or np.array_equal(np.sort(a), np.sort(b)):
        return
    both = np.r_[np.sort(a), np.sort(b)], np.array([0, len(a), len(a) + len(b)])
    late = np.unique(jaccard_join.file_sets(*both)[0])[:: 2 if some_late else 1_000_000][: None if some_late else 0]
    keys, sets = jaccard_join.file_sets(*both, late)
    assert len(np.intersect1d(keys[sets == 0], keys[sets == 1]))


@given(st.integers(0, 10_000), st.sampled_from([2, 16]), st.booleans())
@settings(max_examples=60, deadline=None)
def test_bounds_and_links_lose_nothing(seed, few, dealt):
    """reaching_pairs holds every linking pair once; link_sets gives the components of a cell."""
    was, count_tree.ALL_PAIRS = count_tree.ALL_PAIRS, few
    rng = np.random.default_rng(seed)
    base = [np.unique(rng.integers(1, 1 << 48, n, dtype=np.uint64)) for n in rng.choice([1, 4, 30, 62, 70, 130, 300, 5000], 4)]
    sets = [np.unique(np.r_[b[rng.random(len(b)) < rng.choice([1, 0.95, 0.85])], rng.integers(1, 1 << 48, rng.integers(0, 2 + len(b) // 8), dtype=np.uint64)]) for b in base for _ in range(7)]
    sets = [s if len(s) else base[0] for s in sets]
    label = np.sort(rng.integers(0, 3, len(sets)))
    part = rng.integers(0, 2, len(sets)) if dealt else np.zeros(len(sets), dtype=np.int64)
    n = np.array([len(s) for s in sets])
    a, b, _ = count_tree.reaching_pairs(count_tree.count_vectors(np.concatenate(sets), np.r_[0, np.cumsum(n)]), n, label, part)
    got = list(zip(a.tolist(), b.tolist(), strict=True))
    two = {x: len(set(part[label == x])) == 2 for x in set(label.tolist())}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if label[i] == label[j] and (not two[label[i]] or part[i] != part[j])
            and jaccard_join.links(n[i], n[j], len(np.intersect1d(sets[i], sets[j])))}
    assert len(got) == len(set(got)) and want <= set(got)
    root = jaccard_join.link_sets(sets, n, label, part)
    count_tree.ALL_PAIRS = was
    w = np.array(sorted(want), dtype=np.int64).reshape(-1, 2)
    assert np.array_equal(root, count_tree.roots(len(sets), w[:, 0], w[:, 1]))


def test_bounds_tell_unrelated_sets_apart():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(1, 1 << 48, 500, dtype=np.uint64)) for _ in range(200)]
    n = np.array([len(s) for s in sets])
    vectors = count_tree.count_vectors(np.concatenate(sets), np.r_[0, np.cumsum(n)])
    assert not len(count_tree.reaching_pairs(vectors, n, np.zeros(200, dtype=np.int64), np.zeros(200, dtype=np.int64))[0])


def test_roots():
    a, b = np.array([5, 3, 9, 7, 1]), np.array([3, 4, 7, 8, 1])
    assert count_tree.roots(10, a, b).tolist() == [0, 1, 2, 3, 3, 3, 6, 7, 7, 7]
    assert count_tree.roots(4, a[:0], b[:0]).tolist() == [0, 1, 2, 3]


def test_folding_keeps_every_meeting():
    rng = np.random.default_rng(2)
    keys, cls = rng.integers(0, 40, 3000, dtype=np.uint64), rng.integers(-500, 500, 3000)
    k, c, units, local = jaccard_join.fold_local(keys, cls, 32)
    assert len(k) + sum(len(local[int(n)]) for _, n, _, _ in units) == 3000 == len(k) + units[:, 3].sum()
    assert all(min(local[int(n)]) == p for _, n, p, _ in units)
    got = {name: (m.tolist(), t.tolist()) for name, m, t in jaccard_join._blocks(k, c, np.r_[units, [[7, 99, 5, 32]]])}
    assert any(99 in t for _, t in got.values())
    named, times = jaccard_join.common_keys(k, units, 60)
    full = np.bincount(keys.astype(np.int64))
    assert dict(zip(named.tolist(), times.tolist(), strict=True)) == {i: n for i, n in enumerate(full.tolist()) if n > 60}


def test_packing():
    rng = np.random.default_rng(0)
    keys, cls = rng.integers(0, 1 << 56, 5000, dtype=np.uint64), rng.integers(-(1 << 62), 1 << 62, 40)[rng.integers(0, 40, 5000)]
    got = [jaccard_join._unpack(b) for _, b in jaccard_join._pack(keys, cls, 7)]
    assert sorted(zip(np.concatenate([g[0] for g in got]).tolist(), np.concatenate([g[1] for g in got]).tolist(), strict=True)) == sorted(zip(keys.tolist(), cls.tolist(), strict=True))


def test_pivots_join_large_families(monkeypatch):
    """Components are those of all pairs, with families that pivots join whole, in part or not at all; a family of near
    copies has no pair bounded."""
    rng = np.random.default_rng(8)
    base = [rng.integers(0, 1 << 48, 200).astype(np.uint64) for _ in range(4)]

    def changed(b, k):
        s = b.copy()
        s[rng.integers(0, 200, k)] = rng.integers(0, 1 << 48, k).astype(np.uint64)
        return np.unique(s)

    sets = [changed(base[0], 3) for _ in range(150)] + [changed(base[1 + i % 2], 15) for i in range(120)] + [changed(base[3], 3 * i) for i in range(66)]
    label = np.repeat([0, 1, 2], [150, 120, 66])
    n = np.array([len(s) for s in sets])
    links = [(i, j) for i in range(len(sets)) for j in range(i) if label[i] == label[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    want = count_tree.roots(len(sets), *(np.array(x) for x in zip(*links, strict=True)))
    bounded = []
    real = jaccard_join.reaching_pairs
    monkeypatch.setattr(jaccard_join, "reaching_pairs", lambda v, n, label, *more: bounded.append(set(label.tolist())) or real(v, n, label, *more))
    assert np.array_equal(jaccard_join.link_sets(sets, n, label, np.zeros(len(sets), dtype=np.int64)), want)
    assert len(set(want[:150].tolist())) == 1 and 0 not in bounded[0] and {1, 2} <= bounded[0]
    vec = count_tree.count_vectors(np.concatenate(sets), np.r_[0, np.cumsum(n)])
    comp, whole = count_tree.by_pivots(label, 64, count_tree.bounds_reach(vec, n))
    assert whole[:150].all() and set(comp[:150].tolist()) == {0}
    a, b, _ = real(vec, n, label, np.zeros(len(sets), dtype=np.int64))
    reach = count_tree.roots(len(sets), a, b)
    assert all(reach[i] == reach[c] for i, c in enumerate(comp.tolist()))
