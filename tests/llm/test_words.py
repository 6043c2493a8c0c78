"""Spelling variants (11), periodic runs (12) and benchmark windows (13) against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq
import pytest
from fixtures import FOLDER, clashing, docs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tessitura.llm import periodic_runs, queries, spelling, winnow


def table(name):
    return pq.read_table(f"{FOLDER}/{name}.parquet").to_pylist()


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# --- 11: spelling variants --------------------------------------------------------------------------


def near(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def brute_variants(rows):
    """rows: (doc_id, text)."""
    count = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = ascii_lower(w)
            h = crc32(f"{'' if doc is None else doc}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    close, nears = defaultdict(set), defaultdict(set)
    for w in words:  # words that come to be equal when one letter is taken out, or that are so already
        for k in range(len(w)):
            close[w[:k] + w[k + 1 :]].add(w)
        close[w].add(w)
    for group in close.values():
        for x in group:
            nears[x] |= {y for y in group if near(x, y)}
    best = {w: min(nears[w], key=lambda y: (-words[y], y)) for w in words if nears[w]}
    form = {w: y for w, y in best.items() if words[y] >= 10 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(nears[w]), words.get(form.get(w))) for w, n in words.items()}


def variants_of(df):
    got = [(r["word"], (r["form"], r["root"], r["n"], r["n_near"], r["form_n"])) for r in df.collect()]
    assert len(dict(got)) == len(got)
    return dict(got)


def test_variants_of_all_documents(spark):
    want = brute_variants((r["doc_id"], r["text"]) for r in table("documents"))
    got = variants_of(queries.op11_spelling_variants(spark, FOLDER))
    assert got == want and sum(v[3] > 0 for v in got.values()) > 50


@given(st.integers(0, 10**9))
@settings(max_examples=60, deadline=None)
def test_plane_reports_every_near_word_once(seed):
    rng = random.Random(seed)
    letters, a = rng.choice([b"ab", b"abc", b"a\xe9\xffz"]), rng.randrange(1, 9)
    short = list({bytes(rng.choice(letters) for _ in range(a)) for _ in range(rng.randrange(60))})
    long = list({bytes(rng.choice(letters) for _ in range(a + 1)) for _ in range(rng.randrange(60))})
    got, half = [], a // 2
    for low, high in ((0, half - 1), (half, a)):
        for inserted, i, j in spelling.near_pairs(np.array(short, dtype=f"S{a}"), np.array(long, dtype=f"S{a + 1}"), low, high):
            got += [(inserted, short[x], (long if inserted else short)[y]) for x, y in zip(i, j, strict=True)]
    want = [(False, x, y) for x in short for y in short if near(x, y)] + [(True, x, y) for x in short for y in long if near(x, y)]
    assert sorted(got) == sorted(want)


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64, 200):
        values = rng.permutation(n)
        begin, low = rng.integers(0, n + 1, 50), rng.integers(0, n + 1, 50)
        end, high = np.minimum(n, begin + rng.integers(0, n + 1, 50)), low + rng.integers(0, n + 1, 50)
        got = sorted(zip(*(x.tolist() for x in spelling.WaveletTree(values).report(begin, end, low, high)), strict=True))
        assert got == sorted((q, int(v)) for q in range(50) for v in values[begin[q] : end[q]] if low[q] <= v < high[q])


def test_variants_with_hot_blocks(spark, monkeypatch):
    """A prefix that all words share is filed anew down to single positions; long words and chains of forms."""
    monkeypatch.setattr(spelling, "BLOCK_LEAST", 3)
    monkeypatch.setattr(spelling, "BLOCK_MOST", 3)
    rng = random.Random(4)
    words = ["prefixed" + "".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(300)] + ["q" * 3000, "q" * 2999 + "z", "q" * 3001]
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(20)] + [" ".join(words * 2), "singulare " * 400 + "singulari " * 30 + "singularix " * 2 + "SINGULAREÉ ÉÉÉÉÉÉÉ éééééééé " * 2, None, ""]
    ids = [None, *range(100, 99 + len(texts))]
    got = variants_of(spelling.spelling_variants(clashing(docs(spark, texts, ids))))
    assert got == brute_variants(zip(ids, texts, strict=True)) and got["q" * 3000][3] == 2
    assert got["singularix"][1] == "singulare" and got["singularix"][0] == "singulari"
    assert spelling.spelling_variants(docs(spark, ["a"]).limit(0)).count() == 0 == spelling.spelling_variants(docs(spark, ["short words", None])).count()


# --- 12: periodic runs ------------------------------------------------------------------------------


def brute_runs(w, least=24):
    n, out = len(w), []
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            length = i - s + p
            if length >= max(least, 3 * p) and i > s and not any(all(w[k] == w[k + q] for k in range(s, s + length - q)) for q in range(1, p)):
                out.append((s, length, p))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@given(st.integers(0, 10**9))
@settings(max_examples=150, deadline=None)
def test_runs_by_brute_force(seed):
    rng = random.Random(seed)
    n, kinds = rng.randrange(160), rng.choice([1, 2, 3, 5, 50])
    w = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randrange(4) if n > 4 else 0):
        a, p = rng.randrange(n), rng.randrange(1, 12)
        for i in range(a + p, min(n, a + rng.randrange(1, 80))):
            w[i] = w[i - p]
    least = rng.choice([3, 6, 24])
    assert periodic_runs.find_runs(np.array(w, dtype=np.int32), least) == brute_runs(w, least)


def test_runs_in_blocks_of_periods(monkeypatch):
    monkeypatch.setattr(periodic_runs, "GRID", 64)
    w = list(range(10)) + [1, 2, 3] * 40 + list(range(50, 90)) * 4 + [7] * 30
    assert periodic_runs.find_runs(np.array(w, dtype=np.int32)) == brute_runs(w)
    assert periodic_runs.find_runs(np.array([5] * 300_000, dtype=np.int32)) == [(0, 300_000, 1)]


def brute_digest(doc, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), crc32(str(doc).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


RUN_COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_runs_of_all_documents(spark):
    got = {r["doc_id"]: tuple(r[c] for c in RUN_COLUMNS) for r in queries.op12_periodic_runs(spark, FOLDER).collect()}
    rows = [r for r in table("documents") if len(r["text"]) < 6000]
    assert len(got) == len(table("documents")) and len(rows) > 150
    assert {r["doc_id"]: got[r["doc_id"]] for r in rows} == {r["doc_id"]: brute_digest(r["doc_id"], r["text"]) for r in rows}
    assert sum(v[0] > 0 for v in got.values()) > 10


def test_runs_edges(spark):
    ids = [i for i in range(400) if crc32(str(i).encode()) % 10][:8]
    texts = [None, "", " \n", "a b " * 20, "x", "é ü\t" * 30 + "end", "w" * 1_000_000 + " " + "ok no " * 50_000, "a b " * 20]
    frame = clashing(docs(spark, texts, [*ids[:7], ids[3]])).withColumn("runs", F.lit("mine"))
    made = periodic_runs.collapse_runs(frame, frame.columns, runs="found", collapsed="shorter")
    assert made.columns == [*frame.columns, "found", "shorter"]
    got = [(r["doc_id"], [tuple(x) for x in r["found"]], r["shorter"], r["runs"]) for r in made.collect()]
    empty = lambda i: (i, [], "", "mine")
    want = [*map(empty, ids[:3]), (ids[3], [(0, 40, 2)], "a b", "mine"), (ids[4], [], "x", "mine"), (ids[5], [(0, 60, 2)], "é ü end", "mine"), (ids[6], [(1, 100_000, 2)], "w" * 1_000_000 + " ok no", "mine"), (ids[3], [(0, 40, 2)], "a b", "mine")]
    assert sorted(got) == sorted(want)
    assert periodic_runs.run_digests(docs(spark, ["a"]).limit(0)).count() == 0
    null = periodic_runs.run_digests(docs(spark, ["a b"], [None])).collect()[0]
    assert null["doc_id"] is None and null["n_runs"] == 0 and null["start"] is None


# --- 13: benchmark decontamination --------------------------------------------------------------------


def leak_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))


def brute_leaks(texts, items, width=10):
    """texts: list; items: (id, text). (n_words, merged spans, items) of each text."""
    windows = defaultdict(set)
    for item, t in items:
        w = leak_words(t)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i : i + width])].add(item)
    lengths, out = {len(x) for x in windows}, []
    for t in texts:
        w, hit, found = leak_words(t), set(), set()
        for m in lengths:
            for s in range(len(w) - m + 1):
                if tuple(w[s : s + m]) in windows:
                    hit |= set(range(s, s + m))
                    found |= windows[tuple(w[s : s + m])]
        out.append((len(w), hit, sorted(str(x) for x in found if x is not None)))
    return out


def leaks_of(df, id_col="doc_id"):
    return sorted((r[id_col], r["n_words"], sorted(i for s in r["spans"] for i in range(s["start"], s["end"])), list(r["items"])) for r in df.collect())


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, spans string, id string")


@pytest.mark.parametrize("seed", range(4))
def test_leaks_by_brute_force(spark, monkeypatch, seed):
    """Short items of every length, few kinds of words, collisions of a small map, windows joined by shuffle."""
    rng = random.Random(seed)
    kinds = [["a", "b"], ["alpha", "beta", "gamma", "Ünder", "9"], [f"w{i}" for i in range(60)], ["x"]][seed]
    some = lambda n: " ".join(rng.choice(kinds) for _ in range(n))
    if seed % 2:
        monkeypatch.setattr(winnow, "BITS", 64)
        monkeypatch.setattr(winnow, "small", lambda df, rows=0: df)
    sizes = [[12, 15, 30], [10, 25], [3, 7, 9, 11, 40], [1, 2, 4, 5, 9, 10, 14]][seed]
    items = [(i, some(n)) for i, n in enumerate(sizes * 3)]
    texts = [some(rng.randrange(80)) + rng.choice(["", "  ", "--"]) + rng.choice(items)[1].upper() + "," + some(rng.randrange(20)) for _ in range(40)]
    got = leaks_of(winnow.find_leaks(docs(spark, texts), items_frame(spark, items), ["doc_id"]))
    want = [(i, n, sorted(hit), found) for i, (n, hit, found) in enumerate(brute_leaks(texts, items))]
    assert got == want and any(x[2] for x in want)


def test_leaks_edges(spark):
    item = "One two three, four five six seven eight nine ten ELEVEN"
    items = [(7, item), (7, item), (10, "un deux trois quatre cinq six sept huit neuf dix"), (None, "lost words of no item that is named here at all"), (3, None), (4, " .. "), (5, "")]
    hidden = "é" * 200_000 + " " + "pad " * 50_000 + item.lower() + " pad" * 10
    texts = [None, "", "!?", item, "one two three four five six seven eight nine", "ONE two_three four-five six seven eight nine ten", "lost words of no item that is named here at all", hidden, item + " x " + items[2][1]]
    frame = clashing(docs(spark, texts, [5, 5, *range(7)])).withColumn("n_words", F.lit("mine"))
    names = ("words_", "spans", "items")
    made = winnow.find_leaks(frame, items_frame(spark, items), frame.columns, names=names)
    assert made.columns == [*frame.columns, *names]
    want = sorted((d, n, len(hit), found) for d, (n, hit, found) in zip([5, 5, *range(7)], brute_leaks(texts, items), strict=True))
    assert sorted((r["doc_id"], r["words_"], sum(s["end"] - s["start"] for s in r["spans"]), list(r["items"])) for r in made.collect()) == want
    kept = winnow.drop_leaks(frame, items_frame(spark, items))
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 5, 5]
    none = winnow.decontamination(docs(spark, ["a b"]), items_frame(spark, items).limit(0)).collect()
    assert [tuple(r) for r in none] == [(0, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)]
    assert winnow.decontamination(docs(spark, ["a"]).limit(0), items_frame(spark, items)).count() == 0
