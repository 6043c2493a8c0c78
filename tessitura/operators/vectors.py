"""Vector operators: normalise, centre, all-pairs similarity, means per track."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import settle

#: Windows of a side of a cell that lists its pairs at most, and such cells for each slot.
PAIR_BLOCK, SHARE = 65_536, 8
#: Where all pairs are listed, query windows up to this number are broadcast as one matrix; beyond it, and where blocks are
#: folded, both sides are dealt in blocks. Folded blocks grow where there are more than CELLS, up to GROW times a side.
QUERY_ROWS, QUERY_BLOCK, REF_BLOCK, CELLS, GROW = 20_000, 4096, 8192, 256, 8
#: Pairs of one matrix product (of a cache's size), and rows of a block that lists its best windows.
PAIRS, LISTED = 500_000, 4_000_000
#: Windows of a query or track that stay together where neighbours count.
STRETCH = 256
#: Tasks of a grid at most.
TASKS = 2000
#: Seconds by which neighbouring windows are apart, and by how much that may be off.
STEP, TOLERANCE = 5.0, 0.51


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column, floor: float = 1e-12) -> Column:
    """v / max(|v|, floor); a null stays null."""
    norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), F.lit(floor))
    return F.transform(v, lambda x: x / norm)


def centre(v: Column, mean: Column, floor: float = 1e-12) -> Column:
    return normalise(F.zip_with(v, mean, lambda x, m: x - m), floor)


def mean_vector(df: DataFrame, *keys: str, vector: str = "v") -> DataFrame:
    """Mean per key (or over all rows) as an array in dimension order; partial sums are folded before the shuffle."""
    parts = df.select(*keys, F.posexplode(vector).alias("dim", "x")).groupBy(*keys, "dim").agg(F.avg("x").alias("x"))
    whole = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("dims"))
    return whole.select(*keys, F.transform("dims", lambda d: d["x"]).alias("mean"))


def centred(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """df with v minus the catalog's mean, normalised; the mean is one row."""
    mean = mean_vector(catalog)
    return df.crossJoin(F.broadcast(mean)).withColumn("v", centre(F.col("v"), F.col("mean"))).drop("mean")


def _matrix(t: pa.Table) -> np.ndarray:
    flat = t["v"].combine_chunks() if isinstance(t["v"], pa.ChunkedArray) else t["v"]
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(t), -1)


def _table(q: pa.Table, r: pa.Table, qi: np.ndarray, ri: np.ndarray, scores: np.ndarray) -> pa.Table:
    qi, ri = pa.array(qi), pa.array(ri)
    return pa.table({"query_id": q["query_id"].take(qi), "q_off": q["q_off"].take(qi), "track_id": r["track_id"].take(ri), "r_off": r["r_off"].take(ri), "score": pa.array(scores)})


def _all(q: pa.Table, r: pa.Table, digits: int) -> pa.Table:
    """All pairs of two blocks as a table of chunks, each made by one matrix multiplication."""
    if not len(q) or not len(r):
        none = np.zeros(0, dtype=np.int64)
        return _table(q, r, none, none, np.zeros(0))
    left, right, step = _matrix(q).T, _matrix(r), max(1, PAIRS // len(q))
    parts = ((a, np.round(right[a : a + step] @ left, digits)) for a in range(0, len(r), step))
    return pa.concat_tables(_table(q, r, np.tile(np.arange(len(q)), len(s)), a + np.repeat(np.arange(len(s)), len(q)), s.ravel()) for a, s in parts)


def _best(q: pa.Table, r: pa.Table, digits: int) -> pa.Table:
    """Of each query window and track the best reference window of the block (ties of rounded scores: lowest offset)."""
    if not len(q) or not len(r):
        return _all(q, r, digits)
    r = r.sort_by([("track_id", "ascending"), ("r_off", "ascending")])
    left, right, begin, out = _matrix(q), _matrix(r).T, _starts(r["track_id"]), []
    rows = max(1, math.isqrt(PAIRS // 2))
    for c in range(0, len(q), rows):
        side = left[c : c + rows]
        line = np.arange(len(side))
        at, best = np.zeros((len(begin), len(side)), dtype=np.int64), np.full((len(begin), len(side)), -np.inf)
        for a in range(0, len(r), 2 * rows):
            s = side @ right[:, a : a + 2 * rows]
            b = a + s.shape[1]
            tracks = range(np.searchsorted(begin, a, side="right") - 1, np.searchsorted(begin, b))
            for k in tracks:
                first, end = max(a, begin[k]), min(b, begin[k + 1]) if k + 1 < len(begin) else b
                part = s[:, first - a : end - a]
                top = np.round(part.max(axis=1), digits)
                # the first score that lies close enough to round to the top; where it doesn't, its row is rounded whole
                i = (part >= (top - 0.51 * 10.0**-digits - 1e-12 * np.abs(top))[:, None]).argmax(axis=1)
                for j in np.flatnonzero(np.round(part[line, i], digits) != top):
                    i[j] = (np.round(part[j], digits) == top[j]).argmax()
                better = top > best[k]
                best[k], at[k] = np.where(better, top, best[k]), np.where(better, first + i, at[k])
        out.append(_table(q, r, np.tile(c + line, len(begin)), at.ravel(), best.ravel()))
    return pa.concat_tables(out)


def _starts(*columns: pa.ChunkedArray) -> np.ndarray:
    """Where a row differs from the one before in any of the columns of a sorted table."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        code = c.combine_chunks().dictionary_encode()
        code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _sides(q: int, r: int, tracks: float = 0.0) -> tuple[int, int]:
    """Blocks a side so that few cells copy either side. tracks: rows that a pair's cell gives for each window squared, by
    which blocks are kept so small that a cell gives at most LISTED rows."""
    grow = min(max(1.0, math.sqrt(q / QUERY_BLOCK * r / REF_BLOCK / CELLS)), GROW)
    if tracks:
        grow = min(grow, math.sqrt(LISTED / (QUERY_BLOCK * REF_BLOCK * tracks)))
    return max(1, math.ceil(q / (QUERY_BLOCK * grow))), max(1, math.ceil(r / (REF_BLOCK * grow)))


def _listing(q: int, r: int, slots: int) -> tuple[int, int]:
    """Blocks a side where cells list their pairs: of ``SHARE`` cells a slot the shape that copies fewest windows, more where
    blocks would be too large. A cell sends its pairs on as it makes them, so its output doesn't bound it."""
    nq = max(1, math.ceil(q / PAIR_BLOCK), round(math.sqrt(SHARE * slots * q / max(1, r))))
    return nq, max(1, math.ceil(r / PAIR_BLOCK), math.ceil(SHARE * slots / nq))


def _deal(cells: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(cells))


def _every(cells: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long")))


def _grid(left: DataFrame, right: DataFrame, kernel: Callable, schema: str, cells: int) -> DataFrame:
    """kernel over each cell (qi, ri) of the grid, dealt to as many tasks. Sides come from tables of their own, for columns
    that both have from one plan would reach the kernel on one side only."""
    left, right = (x.repartition(min(cells, TASKS), "qi", "ri").groupBy("qi", "ri") for x in (left, right))
    return left.cogroup(right).applyInArrow(kernel, schema)


def _schema(q: DataFrame, r: DataFrame) -> str:
    kinds = {**dict(q.dtypes), **dict(r.dtypes)}
    return f"query_id {kinds['query_id']}, q_off double, track_id {kinds['track_id']}, r_off double, score double"


def pair_scores(queries: DataFrame, refs: DataFrame, digits: int = 6) -> DataFrame:
    """JN-01: dot product of every query window (query_id, q_off, v) with every reference window (track_id, r_off, v)."""
    q, r = queries.select("query_id", "q_off", "v"), refs.select("track_id", "r_off", "v")
    schema = _schema(q, r)
    n = q.limit(QUERY_ROWS + 1).count()
    if n <= QUERY_ROWS:
        shared = q.sparkSession.sparkContext.broadcast(q.toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, 4 * PAIRS // max(1, len(shared.value)))
            for batch in batches:
                for a in range(0, batch.num_rows, step):
                    yield from _all(shared.value, pa.Table.from_batches([batch.slice(a, step)]), digits).combine_chunks().to_batches()

        return r.repartition(r.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, schema)
    left, right = settle(q, "queries"), settle(r, "references")
    nq, nr = _listing(left.count(), right.count(), q.sparkSession.sparkContext.defaultParallelism)
    left, right = left.withColumn("qi", _deal(nq, "query_id", "q_off")), right.withColumn("ri", _deal(nr, "track_id", "r_off"))
    kinds = {**dict(q.dtypes), **dict(r.dtypes)}
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    left = left.select("qi", _every(nr).alias("ri"), F.lit(True).alias("asks"), "query_id", "q_off", none("track_id"), none("r_off"), "v")
    right = right.select(_every(nq).alias("qi"), "ri", F.lit(False).alias("asks"), none("query_id"), none("q_off"), "track_id", "r_off", "v")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        q, r = t.filter(t["asks"]).combine_chunks(), t.filter(pc.invert(t["asks"])).combine_chunks()
        step = max(1, 4 * PAIRS // max(1, len(q)))
        for a in range(0, len(r) if len(q) else 0, step):
            yield from _all(q, r.slice(a, step), digits).to_batches()

    return left.unionByName(right).repartition(min(nq * nr, TASKS), "qi", "ri").groupBy("qi", "ri").applyInArrow(listed, schema)


def best_scores(queries: DataFrame, refs: DataFrame, digits: int = 6) -> DataFrame:
    """The rows of ``pair_scores`` that a block can't rule out as best of their query window and track. Blocks hold what is
    next to each other in order of tracks, so that what moves follows windows times (tracks + blocks), not pairs of windows."""
    q, r = settle(queries.select("query_id", "q_off", "v"), "queries"), settle(refs.select("track_id", "r_off", "v"), "references")
    n, tracks = r.agg(F.count("*"), F.countDistinct(F.struct("track_id"))).first()
    nq, nr = _sides(q.count(), n, tracks / max(1, n))
    r = settle(r.repartitionByRange(nr, "track_id", "r_off").withColumn("ri", F.spark_partition_id().cast("long")), "blocks")
    parts = (r.agg(F.max("ri")).first()[0] or 0) + 1  # may be more than asked for, then neighbours share a block
    r = r.withColumn("ri", F.expr(f"ri * {nr}L div {max(parts, nr)}L"))
    left = q.withColumn("qi", _deal(nq, "query_id", "q_off")).withColumn("ri", _every(nr))
    return _grid(left, r.withColumn("qi", _every(nq)), lambda a, b: _best(a, b, digits), _schema(q, r), nq * nr)


# --- best of whole queries and tracks -----------------------------------------------------------------------


def _numbered(df: DataFrame, key: str, off: str, tag: str) -> DataFrame:
    """A side's windows in stretches of their key, each with the two windows that come next (not ``core`` there), the
    number ``n``, whether the next one (``one``) and the next two (``two``) follow by regular steps, and the windows of the
    longest such run of the key (``reach``)."""
    w = Window.partitionBy(key).orderBy(off)
    ok = F.coalesce(F.abs(F.lead(off).over(w) - F.col(off) - STEP) <= TOLERANCE, F.lit(False))
    d = df.select(key, off, "v").withColumns({"n": F.row_number().over(w) - 1, "one": ok})
    d = d.withColumn("two", F.col("one") & F.coalesce(F.lead("one").over(w), F.lit(False)))
    d = d.withColumn("reach", F.max(1 + F.col("one").cast("int") + F.col("two").cast("int")).over(Window.partitionBy(key)))
    own = F.floor(F.col("n") / STRETCH)
    parts = F.when((F.col("n") % STRETCH < 2) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    return settle(d.withColumn("part", F.explode(parts)).withColumn("core", F.col("part") == own), tag)


def _pieces(begin: np.ndarray, n: int, step: int) -> list[tuple[int, int]]:
    """n rows in pieces of about ``step`` that end where one of the stretches that begin so does."""
    cuts = [0]
    for a, b in zip(begin, np.r_[begin[1:], n], strict=True):
        if b - cuts[-1] > step and a > cuts[-1]:
            cuts.append(int(a))
    return list(zip(cuts, [*cuts[1:], n], strict=True))


def _within(begin: np.ndarray, a: int, b: int) -> np.ndarray:
    """Where the groups that begin so start in the piece from a to b, counted from a."""
    return np.r_[0, begin[(begin > a) & (begin < b)] - a]


def _exclude(s: np.ndarray, taken: dict, queries: list, tracks: list, q_at: np.ndarray, r_at: np.ndarray, q_off: np.ndarray, r_off: np.ndarray, gap: float) -> None:
    """Lower to -inf what lies less than ``gap`` from a taken pair of its query and track on either axis."""
    for t, a, b in zip(tracks, r_at, np.r_[r_at[1:], len(s)], strict=True):
        for u, c, d in zip(queries, q_at, np.r_[q_at[1:], s.shape[1]], strict=True):
            block = s[a:b, c:d]
            for q, r in taken.get((u, t), ()):
                block[np.abs(r_off[a:b] - r) < gap, :] = -np.inf
                block[:, np.abs(q_off[c:d] - q) < gap] = -np.inf


def _tops(s: np.ndarray, ok: dict, k: int, r_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the k windows that lie on a diagonal of products s, -inf in rows where no run begins, and the columns' maxima
    by group of rows."""
    x = s
    if k > 1:
        x = s.copy()
        for j in range(1, k):
            x[: len(s) - j, : s.shape[1] - j] += s[j:, j:]
        x[~ok[k]] = -np.inf
    return x, np.maximum.reduceat(x, r_at, axis=0)


def _candidates(left: np.ndarray, right: np.ndarray, q_new: np.ndarray, r_new: np.ndarray, q_ok: dict, r_ok: dict, q_reach: np.ndarray, r_reach: np.ndarray, q_pieces: list, r_pieces: list, digits: int, mosts: tuple) -> dict | None:
    """By ``most`` and piece of rows, the columns in which the best run of a query and track may begin; None where they
    wouldn't be few or products can't be bounded. Products in float32 give every column's best but for their rounding; a
    column stays if, with all rounding against it, it may still reach the best of its query and track, ties included."""
    norm = math.sqrt(np.einsum("ij,ij->j", left, left).max() * np.einsum("ij,ij->i", right, right).max())
    groups = [_within(r_new, a, b) for a, b in r_pieces]
    n = left.shape[1]
    if not norm < 1e30 or 4 * len(q_new) * len(r_new) > n * len(r_pieces) or sum(map(len, groups)) * n > 4 * LISTED:
        return None
    loose = (len(left) + 2 + max(mosts)) * 1.05 * 2.0**-24 * norm + 0.51 * 10.0**-digits + 1e-8
    left, right, found = left.astype(np.float32), right.astype(np.float32), {m: [] for m in mosts}
    for (a, b), r_at in zip(r_pieces, groups, strict=True):
        tops = {m: np.full((len(r_at), n), -np.inf, dtype=np.float32) for m in mosts}
        for c, d in q_pieces:
            s, q_at = right[a:b] @ left[:, c:d], _within(q_new, c, d)
            wide = np.diff(np.r_[q_at, d - c])
            reach = np.minimum.outer(r_reach[a + r_at], q_reach[c + q_at])
            made = {}
            for m in mosts:
                windows = np.minimum(reach, m)
                for k in np.unique(windows):
                    if k not in made:
                        made[k] = _tops(s, {k: r_ok[k][a:b]} if k > 1 else {}, k, r_at)[1] / np.float32(k)
                        if k > 1:
                            made[k][:, ~q_ok[k][c:d]] = -np.inf
                    np.copyto(tops[m][:, c:d], made[k], where=np.repeat(windows == k, wide, axis=1))
        for m in mosts:
            found[m].append(tops[m])
    track = np.searchsorted(r_new, np.concatenate([a + g for (a, _), g in zip(r_pieces, groups, strict=True)]), side="right") - 1
    ends, wide, out = np.cumsum([0, *map(len, groups)]), np.diff(np.r_[q_new, n]), {}
    for m in mosts:
        tops = np.concatenate(found.pop(m))
        best = np.full((len(r_new), len(q_new)), -np.inf)
        np.maximum.at(best, track, np.maximum.reduceat(tops, q_new, axis=1))
        out[m] = []
        for i, j in zip(ends[:-1], ends[1:], strict=True):
            stays = (tops[i:j] >= np.repeat(best[track[i:j]] - 2 * loose, wide, axis=1)) & (tops[i:j] > -np.inf)
            out[m].append(np.flatnonzero(stays.any(axis=0)))
    return out


def _runs(q: pa.Table, r: pa.Table, digits: int, most: int | tuple, last: bool, gap: float, schema: pa.Schema) -> pa.Table:
    """Of each query and track of a cell the best run of windows that advance together, of the most that both sides reach
    anywhere up to ``most`` (of several, each for itself). Rounding keeps order, so maxima by window are rounded, and only
    their columns after them."""
    mosts = most if isinstance(most, tuple) else (most,)
    taken = q.filter(q["track_id"].is_valid()).select(["query_id", "track_id", "q_taken", "r_taken"]).to_pylist() if len(q) else []
    taken = {(t["query_id"], t["track_id"]): list(zip(t["q_taken"], t["r_taken"], strict=True)) for t in taken}
    q = q.filter(q["track_id"].is_null()) if len(q) else q
    if not len(q) or not len(r):
        return schema.empty_table()
    q = q.sort_by([(c, "ascending") for c in ("query_id", "part", "n")])
    r = r.sort_by([(c, "ascending") for c in ("track_id", "part", "n")])
    left, right, q_off, r_off = _matrix(q).T, _matrix(r), q["q_off"].to_numpy(), r["r_off"].to_numpy()
    q_ok, r_ok = ({k: t["core"].to_numpy().astype(bool) & t[c].to_numpy().astype(bool) for k, c in ((2, "one"), (3, "two"))} for t in (q, r))
    q_reach, r_reach, q_new, r_new = q["reach"].to_numpy(), r["reach"].to_numpy(), _starts(q["query_id"]), _starts(r["track_id"])
    rows, found = max(1, math.isqrt(PAIRS // 2)), [[], [], [], [], []]
    q_pieces, r_pieces = _pieces(_starts(q["query_id"], q["part"]), len(q), 2 * rows), _pieces(_starts(r["track_id"], r["part"]), len(r), rows)
    few = None if taken else _candidates(left, right, q_new, r_new, q_ok, r_ok, q_reach, r_reach, q_pieces, r_pieces, digits, mosts)
    for m, i, (c, d) in ((m, i, p) for m in mosts for i in range(len(r_pieces)) for p in q_pieces):
        a, b = r_pieces[i]
        begins = np.arange(c, d) if few is None else few[m][i][slice(*np.searchsorted(few[m][i], (c, d)))]
        if not len(begins):
            continue
        at = begins if few is None else np.unique(np.minimum(np.add.outer(begins, np.arange(m)), d - 1))
        r_at, q_at = _within(r_new, a, b), np.flatnonzero(np.r_[True, np.diff(np.searchsorted(q_new, at, side="right")) > 0])
        r_end = np.r_[r_at[1:], b - a]
        s = right[a:b] @ left[:, at]
        if taken:
            ids = (t.take(pa.array(x)).to_pylist() for t, x in ((q["query_id"], at[q_at]), (r["track_id"], a + r_at)))
            _exclude(s, taken, *ids, q_at, r_at, q_off[at], r_off[a:b], gap)
        windows = np.minimum(np.minimum.outer(r_reach[a + r_at], q_reach[at[q_at]]), m)
        for k in np.unique(windows):
            mean = lambda y, k=k: np.round((np.round(y, digits) if k == 1 else y) / k, 8)
            # a run begins at a core window, and its windows follow by regular steps
            x, top = _tops(s if k == 1 else np.round(s, digits), {k: r_ok[k][a:b]} if k > 1 else {}, k, r_at)
            top = mean(top)
            if k > 1:
                top[:, ~(q_ok[k][at] & np.isin(at, begins))] = -np.inf
            best = np.maximum.reduceat(top, q_at, axis=1)
            met = top == np.repeat(best, np.diff(np.r_[q_at, len(at)]), axis=1)
            column = (np.maximum if last else np.minimum).reduceat(np.where(met, np.arange(len(at)), -1 if last else len(at)), q_at, axis=1)
            for t in range(len(r_at)):
                g = np.flatnonzero(np.isfinite(best[t]) & (windows[t] == k))
                same = mean(x[r_at[t] : r_end[t], column[t, g]]) == best[t, g]
                row = len(same) - 1 - same[::-1].argmax(axis=0) if last else same.argmax(axis=0)
                for whole, part in zip(found, (np.full(len(g), m), np.full(len(g), k), best[t, g], at[column[t, g]], a + r_at[t] + row), strict=True):
                    whole.append(part)
    m, k, top, qi, ri = (np.concatenate(x) if x else np.zeros(0) for x in found)
    qi, ri = pa.array(qi.astype(np.int64)), pa.array(ri.astype(np.int64))
    of = [pa.array(m.astype(np.int64))] if "most" in schema.names else []
    return pa.table([q["query_id"].take(qi), r["track_id"].take(ri), pa.array(k.astype(np.int64)), pa.array(top.astype(np.float64)), q["q_off"].take(qi), r["r_off"].take(ri), *of], schema=schema)


class Sides:
    """Query windows and reference windows, numbered, settled and dealt to a grid of which each cell folds its products, so
    that what moves follows windows times cells and queries times tracks, never pairs of windows."""

    def __init__(self, queries: DataFrame, refs: DataFrame, digits: int = 6):
        self.digits = digits
        left, right = _numbered(queries, "query_id", "q_off", "queries"), _numbered(refs, "track_id", "r_off", "references")
        self.nq, self.nr = _sides(left.count(), right.count())
        self.left, self.right = left.withColumn("qi", _deal(self.nq, "query_id", "part")), right.withColumn("ri", _deal(self.nr, "track_id", "part"))

    def _cells(self, mosts: tuple, last: bool, taken: DataFrame | None, gap: float) -> DataFrame:
        """The best runs of each cell, for each of ``mosts``."""
        kinds = {**dict(self.left.dtypes), **dict(self.right.dtypes)}
        spec = f"query_id {kinds['query_id']}, track_id {kinds['track_id']}, windows long, score double, q_off double, r_off double, most long"
        schema = self.left.sparkSession.createDataFrame([], spec).toArrow().schema
        none = lambda c, kind: F.lit(None).cast(kind).alias(c)
        extra = [("track_id", kinds["track_id"]), ("q_taken", "array<double>"), ("r_taken", "array<double>")]
        left = self.left.withColumn("ri", _every(self.nr)).select("*", *[none(*x) for x in extra])
        if taken is not None:
            cells = taken.join(self.left.select("query_id", "qi").distinct(), "query_id").join(self.right.select("track_id", "ri").distinct(), "track_id")
            left = left.unionByName(cells, allowMissingColumns=True)
        digits = self.digits
        return _grid(left, self.right.withColumn("qi", _every(self.nq)), lambda a, b: _runs(a, b, digits, mosts, last, gap, schema), spec, self.nq * self.nr)

    def runs(self, most: int = 1, last: bool = False, taken: DataFrame | None = None, gap: float = 0.0) -> DataFrame:
        """query_id, track_id, windows, score, q_off, r_off: of each query and track the best run of the largest number of
        windows up to ``most``, by the mean of its scores; ties: lowest query, then reference offset (``last``: highest).
        taken (query_id, track_id, q_taken, r_taken) are pairs from which all pairs must be ``gap`` apart on both axes."""
        sign = (lambda c: F.col(c)) if last else (lambda c: -F.col(c))
        top = F.max(F.struct("windows", "score", sign("q_off").alias("q"), sign("r_off").alias("r"))).alias("t")
        found = self._cells((most,), last, taken, gap).groupBy("query_id", "track_id").agg(top)
        return found.select("query_id", "track_id", "t.windows", "t.score", sign("t.q").alias("q_off"), sign("t.r").alias("r_off"))

    def scores(self, *mosts: int) -> DataFrame:
        """query_id, track_id and by ``most`` a struct (windows, score) of the best run, named ``most_<n>``: one pass for all."""
        tops = [F.max(F.when(F.col("most") == m, F.struct("windows", "score"))).alias(f"most_{m}") for m in mosts]
        return self._cells(mosts, False, None, 0.0).groupBy("query_id", "track_id").agg(*tops)
