"""Periodic runs of words (loops of generated or scraped text), found by probing a harmonic grid, and their collapse.

A run of period p is a stretch in which words p apart are identical; it counts from ``TIMES`` periods and ``LEAST`` words.
For every period p the words at the grid points jp and (j + 1)p are compared, n/p tests, so n ln n over all periods. The
stretch of equalities of a run that counts is at least 2p long and so holds two neighbouring grid points: both must
agree, then a few places between them, before a survivor is extended to both sides by comparing slices of growing size.
Grid points inside a run of a period that divides p are skipped: there the multiple p gives the same stretch again, and
a stretch whose smallest period is smaller has always been found before.

Scale: a narrow map over documents: no shuffle, nothing is gathered. A task holds one Arrow batch and, for one text at a
time, 8 bytes a word and the grid of a block of periods (``GRID`` points, or one point a word where that is more).

Defined cases: null and empty texts and texts without words have no runs and collapse to ''; repeated ids are separate
rows; a null id is handed on; other columns are kept if asked for, whatever their names; an empty table gives none.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, lean, tidy

TIMES, LEAST, GRID = 3, 24, 1 << 20
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
_RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


def _survivors(ids: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(period, grid point) in order, for periods low to high - 1, where a run may lie over that point and the next."""
    periods = np.arange(low, high)
    points = (len(ids) - 1) // periods
    p = np.repeat(periods, points)
    at = (np.arange(len(p)) - np.repeat(np.cumsum(points) - points, points)) * p
    same = ids[at] == ids[at + p]
    kept = np.flatnonzero(same[:-1] & same[1:] & (p[:-1] == p[1:]))
    p, at = p[kept], at[kept]
    for between in (lambda p: p // 2, lambda p: 1, lambda p: p - 1, lambda p: p // 3, lambda p: 2 * p // 3):
        probe = at + between(p)
        agree = ids[probe] == ids[probe + p]
        p, at = p[agree], at[agree]
    return p, at


def _extend(ids: np.ndarray, p: int, at: int) -> tuple[int, int]:
    """The stretch [s, t) around ``at`` in which ids[i] == ids[i + p], by slices that double."""
    s, size = at, 64
    while s > 0:
        low = max(0, s - size)
        differ = np.flatnonzero(ids[low:s] != ids[low + p : s + p])
        if len(differ):
            s = low + int(differ[-1]) + 1
            break
        s, size = low, 2 * size
    t, end, size = at, len(ids) - p, 64
    while t < end:
        high = min(end, t + size)
        differ = np.flatnonzero(ids[t:high] != ids[t + p : high + p])
        if len(differ):
            t += int(differ[0])
            break
        t, size = high, 2 * size
    return s, t


def find_runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every maximal run of at least TIMES periods and ``least`` words, in order."""
    n = len(ids)
    runs: list[tuple[int, int, int]] = []
    found: dict[int, tuple[list[int], list[int]]] = {}  # by period: starts and ends, both ascending
    low, top = 1, n // TIMES + 1 if n >= least else 0
    while low < top:
        high = min(top, low + max(1, GRID // ((n - 1) // low)))
        periods, points = _survivors(ids, low, high)
        i = 0
        while i < len(periods):
            p, at = int(periods[i]), int(points[i])
            end = 0
            for q, (starts, ends) in found.items():
                if p % q == 0 and (k := bisect_right(starts, at) - 1) >= 0 and ends[k] > at + 2 * p:
                    end = ends[k]
                    break
            if not end:
                s, t = _extend(ids, p, at)
                end = t + p
                if end - s >= max(least, TIMES * p):
                    runs.append((s, end - s, p))
                    starts, ends = found.setdefault(p, ([], []))
                    starts.append(s)
                    ends.append(end)
            same = int(np.searchsorted(periods, p, side="right"))
            i += max(1, int(np.searchsorted(points[i:same], end - p)))
        low = high
    return sorted(runs, key=lambda r: (r[0], r[2]))


def word_ids(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words only."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), dtype=np.int32, count=len(words))


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The loops that the contract of op12 writes into every tenth document: from word a on, p words over and over."""
    h = crc32(b"%d" % doc_id) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    loop = words[a : a + p]
    return words[:a] + (loop * ((n - a) // p + 1))[: n - a]


def collapse_runs(docs: DataFrame, keep: list[str], text_col: str = "text", least: int = LEAST, prepare: Callable | None = None, id_col: str = "doc_id", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """The columns ``keep`` of every row, its runs as (start, length, period) in words, and its text without their repeats:
    words of ASCII white space joined by one space. ``prepare(id, words)`` may change the words (UTF-8) first."""
    lean(docs.sparkSession)
    key, text = fresh("_id", keep), fresh("_text", keep)
    made = docs.select(*keep, F.col(id_col).cast("long").alias(key), F.col(text_col).cast("binary").alias(text))
    fields = [f for f in made.schema.fields if f.name in keep]
    schema = T.StructType([*fields, T.StructField(runs, RUNS), T.StructField(collapsed, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = [], []
            for doc, raw in zip(batch.column(key).to_pylist(), batch.column(text), strict=True):
                words = (raw.as_py() or b"").split()
                if prepare:
                    words = prepare(doc, words)
                own = find_runs(word_ids(words), least) if len(words) >= least else []
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                texts.append(b" ".join(kept_words(words, own)))
            cols = [*(batch.column(f.name) for f in fields), pa.array(found, _RUNS), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

    return made.mapInArrow(tidy(run), schema)


def best_run(runs: Column) -> Column:
    """The run of the greatest exact length / period, of several the first in order; null without runs."""
    longer = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(runs, F.lit(None).cast(RUNS.elementType), lambda a, b: F.when(a.isNull() | longer(a, b), b).otherwise(a))


def run_digests(docs: DataFrame) -> DataFrame:
    """The contract of op12: per document its number of runs, its best run and two digests."""
    d = collapse_runs(docs, ["doc_id"], prepare=planted).withColumn("best", best_run(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
                    F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
