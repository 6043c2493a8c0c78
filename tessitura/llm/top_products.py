"""Exact top-k search by inner product over norm-sorted, SVD-rotated vectors.

The longest ``HEAD`` vectors are fetched first (bounded). Their singular vectors give a rotation that moves most of an
inner product into the leading coordinates, and scoring every query against them gives each query a lower bound for its
k-th best score. Candidates are dealt in blocks by descending norm, and each query goes to those leading blocks only whose
longest vector can reach its bound: whole cells of the grid fall away before anything is copied. In a cell the candidates
are processed by descending length: a query stops at |q||c| below its bound, a block is skipped by partial sum
plus Cauchy-Schwarz on the residual, and what survives is scored exactly in whole numbers. Each cell sends at most k
rows of a query to a final ranking.

Scores are exact: sums are taken in float64 while |q||c| < 2^52 and in Python integers beyond; bounds carry a relative
slack, so rounding never prunes a true result. The rotation and the head only steer pruning.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor rows without id; a
query meets candidates of its own dimension only; the row itself is told by its id, so rows that repeat a query's id
aren't its candidates, while other repeated ids count row by row, and a repeated query is answered row by row; ties go to the smaller id; fewer than k candidates
give fewer rows; scores beyond a long are an error; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sampling import numbered
from .common import row_key, settle

HEAD, QUERY_BLOCK, CANDIDATE_BLOCK, STEP, SLACK = 2048, 1024, 8192, 1024, 1e-9
#: Cells on a side at most; beyond that cells grow.
MOST_CELLS = 100_000
TOP = 2**63 - 1
_OUT = "query_row long, query_id long, vec_id long, score long"


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, v, dim, norm) of the rows that take part; v is floor(scale * x), x as double."""
    x = F.transform(F.col(vec_col).cast("array<double>"), lambda e: F.floor(e * float(scale)).cast("double"))
    whole = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))
    d = df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & F.forall(F.col(vec_col).cast("array<double>"), whole))
    return d.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v")).withColumns(
        {"dim": F.size("v"), "norm": F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))})


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def exact_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of whole-number rows; those beyond a long become its largest or smallest value."""
    reach = np.sqrt((q * q).sum(axis=1).max(initial=0)) * np.sqrt((c * c).sum(axis=1).max(initial=0))
    if reach < 2.0**52:
        return (q @ c.T).astype(np.int64)
    rows = [[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in c] for x in q]
    return np.array([[max(-TOP, min(TOP, s)) for s in r] for r in rows], dtype=np.int64).reshape(len(q), len(c))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if len(ids) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= cut
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def rotation(head: np.ndarray) -> np.ndarray:
    """Right singular vectors of the longest vectors: leading columns carry most of a product."""
    if len(head) < 2:
        return np.eye(head.shape[1])
    return np.linalg.svd(head / max(1.0, np.abs(head).max()), full_matrices=True)[2].T


def search_cell(q_rows, q_ids, q, bound, c_ids, c, turn, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Exact top k of a block of queries in a block of candidates; bound: a lower bound of each query's k-th score."""
    length = np.sqrt((c * c).sum(axis=1))
    order = np.lexsort((c_ids, -length))
    c_ids, c, length = c_ids[order], c[order], length[order]
    q_len = np.sqrt((q * q).sum(axis=1))
    part = max(1, q.shape[1] // 4)
    qr, cr = q @ turn, c @ turn
    q_rest, c_rest = (np.sqrt((x[:, part:] ** 2).sum(axis=1)) for x in (qr, cr))
    held = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in q_ids]
    bound = bound.astype(np.float64).copy()
    for a in range(0, len(c), STEP):
        b = slice(a, a + STEP)
        slack = SLACK * (1 + q_len * length[a])
        open_q = np.flatnonzero(q_len * length[a] + slack >= bound)  # descending length: the rest is closed for good
        if not len(open_q):
            break
        reach = qr[open_q, :part] @ cr[b, :part].T + np.outer(q_rest[open_q], c_rest[b]) + slack[open_q, None]
        alive = (reach >= bound[open_q, None]) & (c_ids[b][None, :] != q_ids[open_q, None])
        rows = np.flatnonzero(alive.any(axis=1))
        cols = np.flatnonzero(alive.any(axis=0))
        if not len(rows):
            continue
        scores = exact_products(q[open_q[rows]], c[b][cols])
        ids = c_ids[b][cols]
        for r, i in enumerate(open_q[rows]):
            ok = alive[rows[r], cols]
            held[i] = _best(np.concatenate([held[i][0], ids[ok]]), np.concatenate([held[i][1], scores[r, ok]]), k)
            if len(held[i][0]) == k:
                bound[i] = max(bound[i], float(held[i][1][-1]))
    for i, (ids, scores) in enumerate(held):
        if len(ids):
            if np.abs(scores).max() == TOP:
                raise OverflowError("an inner product doesn't fit a long")
            yield np.full(len(ids), q_rows[i]), np.full(len(ids), q_ids[i]), ids, scores


def _sizes(n: int, block: int, tasks: int = 1) -> int:
    """Rows of a cell's side: a task's fair share where that is less than ``block`` (but not below a quarter of it), and
    such that there are at most MOST_CELLS of them."""
    return max(min(block, max(block // 4, n // tasks)), -(-n // MOST_CELLS), 1)


def deal_cells(vectors: DataFrame, queries: DataFrame, k: int = 20, head: int = HEAD) -> tuple[DataFrame, DataFrame, object]:
    """(candidates with ci, qi; queries with ci, qi and low; broadcast of each dimension's rotation).

    Candidates are dealt by norm rank, longest first, and a query needs the leading cells only: those whose longest vector
    times its own length reaches its lower bound. Queries are dealt by how many cells they need, so cells that no query of
    a block needs don't meet it. What isn't needed is never copied.
    """
    spark = vectors.sparkSession
    ranked = settle(numbered(vectors, F.desc("norm"), F.asc("vec_id")).drop("norm").withColumn("pos", F.col("_pos") - 1).drop("_pos"), "ranked")
    longest = ranked.filter(F.col("pos") < head).orderBy("pos").select("vec_id", "v", "dim").toPandas()
    heads = {int(d): (g["vec_id"].to_numpy(np.int64), np.array(g["v"].tolist(), dtype=np.float64)) for d, g in longest.groupby("dim")} if len(longest) else {}
    shared = spark.sparkContext.broadcast({d: (ids, m, rotation(m)) for d, (ids, m) in heads.items()})  # head vectors at most
    n, m = ranked.count(), queries.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = ranked.withColumn("ci", (F.col("pos") / _sizes(n, CANDIDATE_BLOCK, tasks)).cast("int"))
    # the longest vector of each cell, longest cell first: MOST_CELLS numbers at most
    norms = ranked.groupBy("ci").agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))).alias("norm")).toPandas().sort_values("ci")["norm"].to_numpy()
    reach = spark.sparkContext.broadcast(norms)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dims, ids = batch["dim"].to_numpy(), batch["vec_id"].to_numpy()
            low, length = np.full(batch.num_rows, -np.inf), np.zeros(batch.num_rows)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                for s in range(0, len(at), 512):
                    rows = at[s : s + 512]
                    q = _matrix(batch["v"].take(pa.array(rows)), int(d))
                    length[rows] = np.sqrt((q * q).sum(axis=1))
                    if int(d) not in shared.value:
                        continue
                    h_ids, h, _ = shared.value[int(d)]
                    got = exact_products(q, h).astype(np.float64)
                    got[h_ids[None, :] == ids[rows, None]] = -np.inf
                    if got.shape[1] >= k:
                        low[rows] = np.partition(got, got.shape[1] - k, axis=1)[:, got.shape[1] - k]
            need = [int(np.searchsorted(-reach.value, -(b - SLACK) / (x * (1 + 2 * SLACK)), side="right")) if x > 0 and np.isfinite(b) else len(reach.value) for x, b in zip(length, low, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("query_row", "vec_id", "v", "dim")), pa.array(low), pa.array(need, pa.int32())], ["query_row", "vec_id", "v", "dim", "low", "need"])

    bounded = queries.select("query_row", "vec_id", "v", "dim").mapInArrow(bounds, "query_row long, vec_id long, v array<double>, dim int, low double, need int")
    asks = settle(numbered(bounded, F.desc("need"), F.asc("query_row")).withColumn("qi", ((F.col("_pos") - 1) / _sizes(m, QUERY_BLOCK)).cast("int")).drop("_pos"), "asks")
    most = asks.groupBy("qi").agg(F.max("need").alias("need")).toPandas().sort_values("qi")["need"].to_numpy()  # descending
    meets = [(c, int((most > c).sum())) for c in range(len(norms))]
    cells = spark.createDataFrame([x for x in meets if x[1]], "ci int, _blocks int")
    left = ranked.join(F.broadcast(cells), "ci").withColumn("qi", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select("ci", "qi", "dim", "vec_id", "v")
    right = asks.filter("need > 0").withColumn("ci", F.explode(F.sequence(F.lit(0), F.col("need") - 1))).drop("need")
    return left, right, shared


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 20, head: int = HEAD) -> DataFrame:
    """vectors, queries: as ``integer_vectors`` gives; returns query_id, rank, vec_id, score."""
    left, right, shared = deal_cells(vectors, settle(row_key(queries, "query_row"), "queries"), k, head)

    def cell(cands: pa.Table, asks: pa.Table) -> pa.Table:
        out = []
        for d in set(asks["dim"].to_pylist()) & set(cands["dim"].to_pylist()):
            qt, ct = (t.filter(pa.compute.equal(t["dim"], d)) for t in (asks, cands))
            turn = shared.value[d][2] if d in shared.value else np.eye(d)
            out += search_cell(qt["query_row"].to_numpy(), qt["vec_id"].to_numpy(), _matrix(qt["v"], d), qt["low"].to_numpy(), ct["vec_id"].to_numpy(), _matrix(ct["v"], d), turn, k)
        names = [c.split()[0] for c in _OUT.split(", ")]
        return pa.table({c: np.concatenate([o[i] for o in out]).astype(np.int64) if out else np.zeros(0, dtype=np.int64) for i, c in enumerate(names)})

    found = left.groupBy("ci", "qi", "dim").cogroup(right.groupBy("ci", "qi", "dim")).applyInArrow(cell, _OUT)
    order = Window.partitionBy("query_row", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def contract_search(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by ``every``."""
    v = integer_vectors(embeddings)
    return top_products(v, v.filter(F.col("vec_id") % every == 0), k)
