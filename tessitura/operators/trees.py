"""Tree ensembles that Spark ML lacks or can't hold: forests, extremely randomised trees and histogram gradient boosting.

Extra-trees are grown level by level by DataFrame aggregates, all trees at once, until a node holds ``SUBTREE`` rows or
fewer: what lies below such a node is grown by the same draws in one group. Above, a row is held once for each tree and
node it stands in. One aggregate gives every node's counts and the range of every feature, from which each node's
features and cuts are drawn by a hash of (seed, tree, node, feature); a second gives the weighted class counts on both
sides of every drawn cut, and the best cut parts the rows. There is no bootstrap and nothing is sampled, so a forest
depends on its rows and its seed alone, not on their partitions.

The trees of a random forest are grown likewise on bags of the rows: each row is in a tree's bag as often as a Poisson draw
of mean 1 by the hash of (seed, tree, row's id) says, both classes of a bag weigh the same, and of a drawn feature every
cut halfway between two neighbouring values is tried.

Where the numbers of train and test rows are ``HELD`` together or fewer, both are broadcast and the trees are dealt to
tasks, which grow a tree, score the test rows and drop it; so no model is ever gathered (``grow_and_score``).

Boosting goes through its rounds one after another, each over all rows: in one task where these hold ``BOOST_HELD`` numbers
or fewer, beyond that by jobs that fold the rows' gradients by node, feature and bin. It takes all rows either way.

A model is a table of nodes; it is applied in Arrow batches, a bounded number of nodes at a time.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import settle
from .sampling import numbered

#: Nodes that a task holds at a time when a model is applied, and nodes up to which a level's draws are broadcast.
NODES, DEPTH = 1_000_000, 60
BROADCAST_NODES = 20_000
#: Rows of a node up to which all that lies below it is grown in one group.
SUBTREE = 8192
#: Numbers (rows times features) of train and test rows up to which they are broadcast and trees are grown whole.
HELD = 16_000_000
#: Numbers (rows times features) that one task boosts at most, and rounds after which rows keep what the trees say.
BOOST_HELD, FOLD = 4_000_000, 10
#: Shares of a Poisson draw of mean 1 that are at most 0, 1, ...
BAG = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def balanced(rows: DataFrame, label: str = "y", weight: str = "w") -> DataFrame:
    """Rows with a weight by which both classes weigh the same, and all rows as many as they are."""
    n = rows.agg(F.count("*").alias("n"), F.sum((F.col(label) > 0).cast("long")).alias("p")).first()
    share = lambda k: n["n"] / (2.0 * k) if k else 0.0
    return rows.withColumn(weight, F.when(F.col(label) > 0, share(n["p"] or 0)).otherwise(share(n["n"] - (n["p"] or 0))))


# --- extra-trees -------------------------------------------------------------------------------------


def _hash(seed: int, *of: Column) -> Column:
    return F.xxhash64(F.lit(seed).cast("long"), *[c.cast("long") for c in of])


def _drawn(low: Column, high: Column, features: int, most: int, seed: int) -> Column:
    """(f, cut) of ``most`` of the features that aren't constant in a node, drawn without replacement, each with a cut
    drawn from the feature's range: at or above its smallest value and below its largest."""

    def one(f: Column) -> Column:
        at = _hash(seed, F.col("tree"), F.col("node"), f)
        share = at.bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
        cut = F.get(low, f) + share * (F.get(high, f) - F.get(low, f))
        return F.struct(_hash(seed + 1, F.col("tree"), F.col("node"), f).alias("order"), f.alias("f"), F.when(cut < F.get(high, f), cut).otherwise(F.get(low, f)).alias("cut"))

    open_ = F.filter(F.sequence(F.lit(0), F.lit(features - 1)), lambda f: F.get(low, f) < F.get(high, f))
    return F.transform(F.slice(F.array_sort(F.transform(open_, one)), 1, most), lambda x: F.struct(x["f"].alias("f"), x["cut"].alias("cut")))


def fit_extra_trees(rows: DataFrame, trees: int, leaf: int = 3, share: float = 0.75, depth: int | None = None, seed: int = 42, features: str = "v", label: str = "y", weight: str = "w") -> DataFrame:
    """The forest's nodes: tree, node (children of i are 2i + 1 and 2i + 2), f and cut (null in a leaf; v[f] <= cut goes
    left), value (weighted share of positive rows), n. The best of ``share`` of the features by weighted Gini impurity, of
    equal ones the first drawn; sides hold ``leaf`` rows at least. Rows without features are left out."""
    held = rows.filter(F.col(features).isNotNull()).select(F.col(features).alias("v"), (F.col(label) > 0).alias("y"), F.col(weight).cast("double").alias("w"))
    return _levels(held.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))), leaf, share, depth, seed, False)


def told_apart(rows: DataFrame, features: str = "v", label: str = "y") -> DataFrame:
    """Rows that have features as (v, y, id), where copies of a row have ids of their own that don't depend on partitions."""
    copies = rows.filter(F.col(features).isNotNull()).groupBy(F.col(features).alias("v"), F.col(label).alias("y")).agg(F.count("*").alias("n"))
    return copies.select("v", "y", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")).select("v", "y", F.xxhash64("y", "v", "copy").alias("id"))


def fit_forest(rows: DataFrame, trees: int, leaf: int = 3, share: float = 0.75, depth: int | None = None, seed: int = 42) -> DataFrame:
    """Nodes, as ``fit_extra_trees`` gives them, of a random forest of rows (v, y, id)."""
    held = rows.select("v", (F.col("y") > 0).alias("y"), "id").withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    u = _hash(seed + 2, F.col("tree"), F.col("id")).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    held = held.withColumn("u", u).withColumn("k", F.expr(" + ".join(f"int(u >= {c!r}D)" for c in BAG.tolist()))).filter("k > 0")
    sizes = held.groupBy("tree").agg(F.sum("k").alias("all"), F.sum(F.expr("if(y, k, 0)")).alias("ones"))
    weigh = F.col("k") * F.col("all") / (2.0 * F.when(F.col("y"), F.col("ones")).otherwise(F.col("all") - F.col("ones")))
    return _levels(held.join(F.broadcast(sizes), "tree").select("v", "y", weigh.alias("w"), "tree"), leaf, share, depth, seed, True)


def _levels(held: DataFrame, leaf: int, share: float, depth: int | None, seed: int, exact: bool) -> DataFrame:
    """The nodes of the trees of rows (v, y, w, tree). exact: of a drawn feature the best cut, not a drawn one."""
    spark = held.sparkSession
    width = held.select(F.max(F.size("v"))).first()[0] or 0
    most, deepest = max(1, int(share * width)), min(DEPTH, DEPTH if depth is None else depth)
    held = settle(held.withColumn("node", F.lit(0).cast("long")), "held")
    # columns are made once, not for each level
    ends = [F.expr(f"array({', '.join(f'{k}(get(v, {f}))' for f in range(width))}) AS {name}") for k, name in (("min", "low"), ("max", "high"))]
    counts = [F.expr(x) for x in ("count(*) AS n", "sum(w) AS w", "sum(if(y, w, 0D)) AS p", "count_if(y) AS ones")]
    sides = [F.expr(f"get(v, _f{j}) <= _cut{j} AS _l{j}") for j in range(most)]
    left = F.expr("array(" + ", ".join(f"struct(count_if(_l{j}) AS n, sum(if(_l{j}, w, 0D)) AS w, sum(if(_l{j} AND y, w, 0D)) AS p)" for j in range(most)) + ") AS left")
    draw = _drawn(F.col("low"), F.col("high"), width, most, seed)
    out = []
    nodes = "tree int, node long, f int, cut double, value double, n long"
    for level in range(deepest + 1):
        sizes = settle(held.groupBy("tree", "node").agg(F.count("*").alias("n")), "sizes")
        total, large = sizes.count(), sizes.filter(F.col("n") > SUBTREE).count()
        if total > large:
            small = sizes.filter(F.col("n") <= SUBTREE).select("tree", "node")
            part = held if not large else held.join(F.broadcast(small) if total - large <= BROADCAST_NODES else small, ["tree", "node"], "left_semi")
            dealt = part.repartition(4 * spark.sparkContext.defaultParallelism, "tree", "node").groupBy("tree", "node")
            out.append(settle(dealt.applyInArrow(_subtrees(width, most, leaf, level, deepest, seed, exact), nodes), "subtrees"))
            if not large:
                break
            some = sizes.filter(F.col("n") > SUBTREE).select("tree", "node")
            held = held.join(F.broadcast(some) if large <= BROADCAST_NODES else some, ["tree", "node"], "left_semi")
        elif not total:
            break
        stats = held.groupBy("tree", "node").agg(*counts, *ends)
        open_ = (F.col("n") >= 2 * leaf) & (F.col("ones") > 0) & (F.col("ones") < F.col("n")) & F.lit(level < deepest)
        drawn = F.when(open_, draw).alias("drawn")
        stats = settle(stats.select("tree", "node", "n", "w", "p", drawn), "stats")
        few = (lambda nodes: F.broadcast(nodes)) if stats.count() <= BROADCAST_NODES else (lambda nodes: nodes)
        known = stats.filter("drawn IS NOT NULL")
        splits = settle(_halfway(held, known, leaf, few) if exact else _best(held, known, most, leaf, few, sides, left), "splits")
        out.append(stats.select("tree", "node", (F.col("p") / F.col("w")).alias("value"), "n").join(few(splits), ["tree", "node"], "left").select("tree", "node", "f", "cut", "value", "n"))
        if splits.count() == 0:
            break
        to = F.col("node") * 2 + F.when(F.get("v", F.col("f")) <= F.col("cut"), 1).otherwise(2)
        held = settle(held.join(few(splits), ["tree", "node"]).select("v", "y", "w", "tree", to.alias("node")), "held")
    return settle(reduce(DataFrame.unionByName, out), "forest") if out else spark.createDataFrame([], nodes)


_MASK = (1 << 64) - 1
# Fixed values of XXH64, which Spark's xxhash64 is.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _mixed(value: int, h: int) -> int:
    """Spark's xxhash64 of a long that follows columns of hash ``h``, as an unsigned number."""
    x = value * _P2 & _MASK
    h = (h + _P5 + 8 & _MASK) ^ ((x << 31 | x >> 33) & _MASK) * _P1 & _MASK
    h = ((h << 27 | h >> 37) & _MASK) * _P1 + _P4 & _MASK
    h = (h ^ h >> 33) * _P2 & _MASK
    h = (h ^ h >> 29) * _P3 & _MASK
    return h ^ h >> 32


def _mixed_all(values: np.ndarray, h: int | np.ndarray) -> np.ndarray:
    """``_mixed`` of each of many unsigned numbers, after columns of one hash or of one hash each."""
    p1, p2, p3, p4 = (np.uint64(x) for x in (_P1, _P2, _P3, _P4))
    turn = lambda x, k: x << np.uint64(k) | x >> np.uint64(64 - k)
    x = np.array(h, dtype=np.uint64, ndmin=1) + np.uint64(_P5 + 8 & _MASK) ^ turn(values * p2, 31) * p1
    x = turn(x, 27) * p1 + p4
    x = (x ^ x >> np.uint64(33)) * p2
    x = (x ^ x >> np.uint64(29)) * p3
    return x ^ x >> np.uint64(32)


def _features(t: pa.Table, width: int) -> np.ndarray:
    """The arrays of column v as rows of a matrix; NaN for a null or missing element."""
    v = t["v"].combine_chunks()
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(v.offsets.to_numpy())
    x = np.full((len(t), width), np.nan)
    x[np.arange(width)[None, :] < lengths[:, None]] = flat
    return x


def _purity(p: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The purer both sides, the larger the sum over sides of this."""
    return (p * p + (w - p) * (w - p)) / w


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, begin)


def _grow(x: np.ndarray, y: np.ndarray, of: tuple[np.ndarray, np.ndarray], scale: tuple[float, float], tree: int, node: int, level: int, most: int, leaf: int, deepest: int, seed: int, exact: bool) -> dict:
    """Arrays of all nodes at and below one node of a tree, by level: node, f (-1 in a leaf), cut, value, n and left (where
    the left child lies; the right one is next). Rows x of class y count as of[0] times scale[0] among the positive and
    of[1] times scale[1] among the other rows. All nodes of a level are worked on at once: rows lie node by node, where cuts
    are exact by each feature in its order."""
    columns, width = np.ascontiguousarray(x.T), x.shape[1]
    every, draws = np.arange(width, dtype=np.uint64), [_mixed(tree, _mixed(s, 42)) for s in (seed, seed + 1)]
    orders = [np.argsort(c, kind="stable").astype(np.int32) for c in columns] if exact and width else [np.arange(len(x), dtype=np.int32)]
    nodes, begin, done, out = np.array([node], dtype=np.int64), np.zeros(1, dtype=np.int64), 0, []
    ones, y = y.astype(np.int64), None
    while len(nodes):
        n = np.diff(np.r_[begin, len(orders[0])])
        counts = [_sums(c[orders[0]], begin) for c in (ones, *of)]
        positive, whole = counts[1] * scale[0], counts[1] * scale[0] + counts[2] * scale[1]
        found = {"node": nodes, "f": np.full(len(nodes), -1, dtype=np.int32), "cut": np.zeros(len(nodes)), "value": positive / whole, "n": n, "left": np.full(len(nodes), -1, dtype=np.int64)}
        out.append(found)
        done += len(nodes)
        open_ = (n >= 2 * leaf) & (counts[0] > 0) & (counts[0] < n) & (level < deepest)
        if not width or not open_.any():
            break
        at, held = np.flatnonzero(open_), np.repeat(open_, n)
        orders, n, nodes, positive, whole = [o[held] for o in orders], n[at], nodes[at], positive[at], whole[at]
        begin = np.r_[0, np.cumsum(n)[:-1]]
        owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
        f, cut = (_exact if exact else _random)(columns, of, scale, orders, begin, owner, n, positive, whole, *(_mixed_all(every[None, :], _mixed_all(nodes.view(np.uint64), h)[:, None]) for h in draws), most, leaf)
        split = np.flatnonzero(f >= 0)
        found["f"][at], found["cut"][at], found["left"][at[split]] = f, cut, done + 2 * np.arange(len(split))
        if not len(split):
            break
        # rows of nodes that are split, left ones of each node first, in the order they have
        held = np.repeat(f >= 0, n)
        orders, n, nodes = [o[held] for o in orders], n[split], nodes[split]
        begin = np.r_[0, np.cumsum(n)[:-1]]
        owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
        goes = np.zeros(len(x), dtype=bool)
        goes[orders[0]] = columns[f[split][owner], orders[0]] <= cut[split][owner]
        lefts = _sums(goes[orders[0]].astype(np.int64), begin)
        base, place = begin[owner], np.arange(len(owner))
        for i, o in enumerate(orders):
            l = goes[o]  # noqa: E741
            before = np.cumsum(l)
            before = before - (before[begin] - l[begin])[owner]
            new = np.empty_like(o)
            new[np.where(l, base + before - 1, place + lefts[owner] - before)] = o
            orders[i] = new
        begin = np.stack([begin, begin + lefts], axis=1).ravel()
        nodes = np.stack([2 * nodes + 1, 2 * nodes + 2], axis=1).ravel()
        level += 1
    return {k: np.concatenate([o[k] for o in out]) for k in out[0]}


def _order(order: np.ndarray, open_: np.ndarray, most: int) -> np.ndarray:
    """By node and feature the place in the order of draws, ``most`` or more where it isn't drawn."""
    rank = np.argsort(np.argsort(np.where(open_, order.view(np.int64), np.iinfo(np.int64).max), axis=1, kind="stable"), axis=1)
    return np.where(open_, rank, most)


def _random(columns, of, scale, orders, begin, owner, n, positive, whole, at, order, most, leaf) -> tuple[np.ndarray, np.ndarray]:
    """(f, cut) of each node's best drawn cut, -1 where none leaves ``leaf`` rows on both sides."""
    rows = orders[0]
    low, high = (np.stack([k.reduceat(c[rows], begin) for c in columns], axis=1) for k in (np.fmin, np.fmax))
    cut = low + (at & np.uint64((1 << 53) - 1)).astype(np.float64) / float(1 << 53) * (high - low)
    cut = np.where(cut < high, cut, low)
    rank = _order(order, low < high, most)
    pos, neg = (c[rows] for c in of)
    best, f, at_cut = np.full(len(n), -np.inf), np.full(len(n), -1, dtype=np.int32), np.zeros(len(n))
    line = np.arange(len(n))
    for j in range(min(most, len(columns))):
        g = (rank == j).argmax(axis=1)
        left = columns[g[owner], rows] <= cut[line, g][owner]
        ln, lp = _sums(left.astype(np.int64), begin), _sums(pos * left, begin) * scale[0]
        lw = lp + _sums(neg * left, begin) * scale[1]
        fits = np.flatnonzero((ln >= leaf) & (n - ln >= leaf) & (rank[line, g] == j))
        gain = np.round(_purity(lp[fits], lw[fits]) + _purity(positive[fits] - lp[fits], whole[fits] - lw[fits]), 9)
        more = gain > best[fits]
        fits = fits[more]
        best[fits], f[fits], at_cut[fits] = gain[more], g[fits], cut[fits, g[fits]]
    return f, at_cut


def _exact(columns, of, scale, orders, begin, owner, n, positive, whole, at, order, most, leaf) -> tuple[np.ndarray, np.ndarray]:
    """(f, cut) of each node's best cut of its drawn features, halfway between values; of equal ones the first drawn, then
    the lowest. -1 where none leaves ``leaf`` rows on both sides."""
    low, high = (np.stack([k.reduceat(c[orders[0]], begin) for c in columns], axis=1) for k in (np.fmin, np.fmax))
    rank = _order(order, low < high, most)
    best, f, cut, first = np.full(len(n), -np.inf), np.full(len(n), -1, dtype=np.int32), np.zeros(len(n)), np.full(len(n), most)
    place = np.arange(len(owner)) - begin[owner] + 1
    inside = (place >= leaf) & (n[owner] - place >= leaf)
    for g, c in enumerate(columns):
        rows, v = orders[g], c[orders[g]]
        i = np.flatnonzero(inside[:-1] & (v[:-1] < v[1:]) & (rank[:, g] < most)[owner[:-1]])
        if not len(i):
            continue
        own = owner[i]
        sums = []
        for a, s in zip(of, scale, strict=True):
            whole_sum = np.cumsum(a[rows])
            sums.append((whole_sum[i] - (whole_sum[begin] - a[rows[begin]])[own]) * s)
        lp, lw = sums[0], sums[0] + sums[1]
        gain = np.round(_purity(lp, lw) + _purity(positive[own] - lp, whole[own] - lw), 9)
        new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        k, top = own[new], np.maximum.reduceat(gain, new)
        met = np.flatnonzero(gain == np.repeat(top, np.diff(np.r_[new, len(own)])))
        i = i[met[np.searchsorted(own[met], k)]]
        more = (top > best[k]) | ((top == best[k]) & (rank[k, g] < first[k]))
        k, top, i = k[more], top[more], i[more]
        half = (v[i] + v[i + 1]) / 2
        best[k], first[k], f[k], cut[k] = top, rank[k, g], g, np.where(half < v[i + 1], half, v[i])
    return f, cut


def _subtrees(width: int, most: int, leaf: int, level: int, deepest: int, seed: int, exact: bool) -> Callable:
    """Grows what lies at and below the node of a group, by the draws and the choice of ``_levels``."""

    def grow(t: pa.Table) -> pa.Table:
        x, y, w = _features(t, width), t["y"].to_numpy(), t["w"].to_numpy()
        tree = t["tree"][0].as_py()
        found = _grow(x, y, (w * y, w * ~y), (1.0, 1.0), tree, t["node"][0].as_py(), level, most, leaf, deepest, seed, exact)
        ends = found["f"] < 0
        columns = (pa.array(np.full(len(ends), tree, dtype=np.int32)), pa.array(found["node"]), pa.array(found["f"], mask=ends), pa.array(found["cut"], mask=ends), pa.array(found["value"]), pa.array(found["n"]))
        return pa.table(columns, names=["tree", "node", "f", "cut", "value", "n"])

    return grow


def _best(held: DataFrame, drawn: DataFrame, most: int, leaf: int, few: Callable, sides: list[Column], left: Column) -> DataFrame:
    """(tree, node, f, cut) of each node's best drawn cut that leaves ``leaf`` rows on both sides."""
    flat = drawn.select("tree", "node", F.expr("inline(array(struct(" + ", ".join(f"get(drawn, {j}).{k} AS _{k}{j}" for j in range(most) for k in ("f", "cut")) + ")))"))
    met = held.join(few(flat), ["tree", "node"]).select("tree", "node", "y", "w", *sides)
    sided = met.groupBy("tree", "node").agg(left).join(few(drawn), ["tree", "node"])
    # the purer both sides, the larger the sum over sides of (positive weight squared + other weight squared) / weight
    purity = lambda p, w: (p * p + (w - p) * (w - p)) / w

    def gain(x: Column, j: Column) -> Column:
        fits = (x["n"] >= leaf) & (F.col("n") - x["n"] >= leaf)
        return F.when(fits, F.struct(F.round(purity(x["p"], x["w"]) + purity(F.col("p") - x["p"], F.col("w") - x["w"]), 9).alias("gain"), (-j).alias("j")))

    best = F.array_max(F.filter(F.transform("left", gain), lambda g: g.isNotNull()))
    return sided.withColumn("best", best).filter("best IS NOT NULL").select("tree", "node", F.get("drawn", -F.col("best.j")).alias("d")).select("tree", "node", "d.f", "d.cut")


def _halfway(held: DataFrame, drawn: DataFrame, leaf: int, few: Callable) -> DataFrame:
    """(tree, node, f, cut) of each node's best cut of its drawn features, as ``_exact`` chooses it."""
    node = ["tree", "node"]
    each = held.join(few(drawn.select(*node, "drawn")), node).select(*node, "y", "w", "v", F.posexplode("drawn").alias("j", "d"))
    each = each.groupBy(*node, "j", F.col("d.f").alias("f"), F.expr("get(v, d.f)").alias("x")).agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.expr("if(y, w, 0D)")).alias("p"))
    by = Window.partitionBy(*node, "j").orderBy(F.col("x").asc_nulls_last())
    to = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sides = each.select(*node, "j", "f", "x", F.lead("x").over(by).alias("next"), *[F.sum(c).over(to).alias(f"l{c}") for c in ("n", "w", "p")])
    sides = sides.filter("x < next").join(few(drawn.select(*node, "n", "w", "p")), node).filter((F.col("ln") >= leaf) & (F.col("n") - F.col("ln") >= leaf))
    purity = lambda p, w: (p * p + (w - p) * (w - p)) / w
    gain = F.round(purity(F.col("lp"), F.col("lw")) + purity(F.col("p") - F.col("lp"), F.col("w") - F.col("lw")), 9)
    half = (F.col("x") + F.col("next")) / 2
    best = F.max(F.struct(gain.alias("gain"), (-F.col("j")).alias("j"), (-F.col("x")).alias("x"), "f", F.when(half < F.col("next"), half).otherwise(F.col("x")).alias("cut"))).alias("best")
    return sides.groupBy(*node).agg(best).select(*node, "best.f", "best.cut")


# --- histogram gradient boosting -----------------------------------------------------------------------


def bin_edges(x: np.ndarray, bins: int = 255) -> list[np.ndarray]:
    """For each feature the cuts between its bins: halfway between its values, or between the quantiles' neighbours where
    there are more values than bins."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) <= bins:
            out.append((values[1:] + values[:-1]) / 2)
            continue
        rank = np.linspace(0, len(column) - 1, bins + 1)[1:-1]
        ordered = np.sort(column)
        out.append(np.unique((ordered[np.floor(rank).astype(int)] + ordered[np.ceil(rank).astype(int)]) / 2))
    return out


def _cut(sums: np.ndarray, l2: float, leaf: int) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best cut by sums[feature, bin] of gradient, hessian and rows; -inf where none is allowed."""
    left = np.cumsum(sums, axis=1)[:, :-1]
    whole = sums[:1].sum(axis=1)[:, None]
    right = whole - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
    gain = np.where((left[..., 2] >= leaf) & (right[..., 2] >= leaf) & (np.minimum(left[..., 1], right[..., 1]) >= 1e-3), score(left) + score(right) - score(whole), -np.inf)
    gain = np.round(gain, 9)  # equal cuts stay equal, however sums were rounded
    best = int(gain.argmax()) if gain.size else 0
    return (float(gain.flat[best]), *divmod(best, gain.shape[1])) if gain.size else (-np.inf, 0, 0)


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int, rate: float, leaves: int, leaf: int, l2: float, bins: int = 255) -> dict:
    """Trees of at most ``leaves`` leaves, each grown best cut first on the gradient and hessian sums of binned features;
    leaves take a Newton step with ridge ``l2`` times ``rate``. Arrays of all nodes, the roots and the start."""
    edges = bin_edges(x, bins)
    width = max([len(e) for e in edges], default=0) + 1
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    place = binned + np.arange(x.shape[1]) * width
    mean = np.average(y, weights=w)
    start = float(np.log(mean / (1 - mean))) if 0 < mean < 1 else 0.0
    raw = np.full(len(y), start)
    nodes: dict[str, list] = {"f": [], "cut": [], "left": [], "right": [], "value": []}
    roots = []
    for _ in range(rounds if 0 < mean < 1 else 0):
        p = 1 / (1 + np.exp(-raw))
        per_row = np.stack([w * (p - y), w * p * (1 - p), np.ones(len(y))], axis=1)

        def node(rows: np.ndarray, per_row=per_row) -> list:
            sums = np.stack([np.bincount(place[rows].ravel(), np.repeat(per_row[rows, k], x.shape[1]), x.shape[1] * width) for k in range(3)], axis=1).reshape(x.shape[1], width, 3)
            total = per_row[rows].sum(axis=0)
            for k, v in zip(nodes, (-1, 0.0, -1, -1, -total[0] / (total[1] + l2) * rate), strict=True):
                nodes[k].append(v)
            return [*_cut(sums, l2, leaf), len(nodes["f"]) - 1, rows]

        first = node(np.arange(len(y)))
        roots.append(first[3])
        queue, ended = [(-first[0], first[3], first)], []
        while queue:
            gain, _, (_, f, b, at, rows) = heapq.heappop(queue)
            if gain >= 0 or len(queue) + len(ended) + 2 > leaves:
                ended.append((at, rows))
                continue
            goes = binned[rows, f] <= b
            sides = [node(rows[goes]), node(rows[~goes])]
            nodes["f"][at], nodes["cut"][at], nodes["left"][at], nodes["right"][at] = f, float(edges[f][b]), sides[0][3], sides[1][3]
            for s in sides:
                heapq.heappush(queue, (-s[0], s[3], s))
        for at, rows in ended:
            raw[rows] += nodes["value"][at]
    kinds = {"f": np.int32, "cut": np.float64, "left": np.int64, "right": np.int64, "value": np.float64}
    return {"start": start, "roots": np.array(roots, dtype=np.int64), **{k: np.array(v, dtype=kinds[k]) for k, v in nodes.items()}}


def all_bin_edges(rows: DataFrame, bins: int = 255) -> list[np.ndarray]:
    """``bin_edges`` of the arrays v of all rows: distinct values are counted, and where there are more than bins, ranks are
    picked from a range sort. The driver gets twice as many values as there are bins for each feature."""
    each = rows.select(F.posexplode("v").alias("f", "x"))
    kept = settle(each.groupBy("f", "x").agg(F.count("*").alias("n")), "values")
    sizes = {r["f"]: r for r in kept.groupBy("f").agg(F.count("*").alias("values"), F.sum("n").alias("n")).collect()}
    few, out = [f for f, r in sizes.items() if r["values"] <= bins], {f: np.zeros(0) for f in sizes}
    values: dict = {f: [] for f in few}
    for f, x in kept.filter(F.col("f").isin(few)).select("f", "x").collect():
        values[f].append(x)
    for f, x in values.items():
        x = np.sort(np.array(x, dtype=np.float64))
        out[f] = (x[1:] + x[:-1]) / 2
    many = sorted(sizes.keys() - set(few))
    if many:
        begin = dict(zip(many, np.cumsum([1, *[sizes[f]["n"] for f in many]]).tolist(), strict=False))  # where features start in the sort
        ranks = {f: np.linspace(0, sizes[f]["n"] - 1, bins + 1)[1:-1] for f in many}
        ends = {f: (begin[f] + np.floor(ranks[f]).astype(np.int64), begin[f] + np.ceil(ranks[f]).astype(np.int64)) for f in many}
        wanted = sorted({int(i) for pair in ends.values() for side in pair for i in side})
        picked = numbered(each.filter(F.col("f").isin(many)), F.asc("f"), F.asc("x")).join(F.broadcast(rows.sparkSession.createDataFrame([(i,) for i in wanted], "_pos long")), "_pos")
        at = {r["_pos"]: r["x"] for r in picked.select("_pos", "x").collect()}
        for f, (low, high) in ends.items():
            pick = lambda side: np.array([at[i] for i in side.tolist()])
            out[f] = np.unique((pick(low) + pick(high)) / 2)
    return [out[f] for f in sorted(out)]


def fit_boosted(rows: DataFrame, rounds: int, rate: float, leaves: int, leaf: int, l2: float, bins: int = 255) -> dict:
    """``boost`` of all rows (v, y, w): in one task where they hold ``BOOST_HELD`` numbers or fewer, by jobs beyond. Rows are
    sorted there by what they hold, so the sums don't depend on earlier partitions."""
    rows = rows.filter("v IS NOT NULL").select("v", (F.col("y") > 0).cast("double").alias("y"), F.col("w").cast("double").alias("w"))
    width, n = rows.agg(F.max(F.size("v")), F.count("*")).first()
    if n * (width or 0) > BOOST_HELD:
        return _boost_by_jobs(rows, rounds, rate, leaves, leaf, l2, bins)
    schema = "start double, roots array<long>, f array<int>, cut array<double>, left array<long>, right array<long>, value array<double>"
    kinds = rows.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        model = boost(_features(t, width), t["y"].to_numpy(), t["w"].to_numpy(), rounds, rate, leaves, leaf, l2, bins)
        yield pa.RecordBatch.from_pylist([{"start": model["start"], **{k: v.tolist() for k, v in model.items() if k != "start"}}], schema=kinds)

    (model,) = rows.repartition(1).sortWithinPartitions("v", "y").mapInArrow(run, schema).collect() if n else (None,)
    return _model(*model) if n else _model(0.0, [], [], [], [], [], [])


def _model(start: float, *arrays: list) -> dict:
    kinds = {"roots": np.int64, "f": np.int32, "cut": np.float64, "left": np.int64, "right": np.int64, "value": np.float64}
    return {"start": start, **{k: np.array(v, dtype=t) for (k, t), v in zip(kinds.items(), arrays, strict=True)}}


def _best_first(known: dict, leaves: int) -> tuple[dict | None, list[int]]:
    """The tree that ``boost`` grows, of nodes by path (children of i are 2i and 2i + 1) known as (gain, f, bin, value); or,
    where it isn't known that far, the paths to be known: children of all nodes that would be cut if none came before them."""
    if 1 not in known:
        return None, [1]
    tree: dict[str, list] = {"f": [-1], "bin": [-1], "left": [-1], "right": [-1], "value": [known[1][3]]}
    queue, ended = [(-known[1][0], 0, 1)], 0
    while queue:
        top = gain, at, path = heapq.heappop(queue)
        room = leaves - (len(queue) + 1 + ended)
        if gain >= 0 or room < 1:
            ended += 1
            continue
        if 2 * path not in known:
            return None, [k for g, _, i in sorted([top, *queue])[:room] if g < 0 and 2 * i not in known for k in (2 * i, 2 * i + 1)]
        tree["f"][at], tree["bin"][at] = known[path][1:3]
        for side, k in (("left", 2 * path), ("right", 2 * path + 1)):
            tree[side][at] = len(tree["f"])
            heapq.heappush(queue, (-known[k][0], len(tree["f"]), k))
            for name, v in (("f", -1), ("bin", -1), ("left", -1), ("right", -1), ("value", known[k][3])):
                tree[name].append(v)
    return tree, []


def _to_paths(known: dict, asked: list[int]) -> dict:
    """A tree whose leaves hold the place of their path in ``asked``, -1 where it isn't."""
    paths, inner = [1], set()
    for i in paths:
        if i not in asked and any(k.bit_length() > i.bit_length() and k >> (k.bit_length() - i.bit_length()) == i for k in asked):
            inner.add(i)
            paths += [2 * i, 2 * i + 1]
    at = {i: k for k, i in enumerate(paths)}
    of = lambda j: np.array([known[i][j] if i in inner else -1 for i in paths])
    return {"f": of(1), "cut": of(2), "left": np.array([at.get(2 * i, -1) for i in paths]), "value": np.array([asked.index(i) if i in asked else -1 for i in paths])}


def _boost_by_jobs(rows: DataFrame, rounds: int, rate: float, leaves: int, leaf: int, l2: float, bins: int) -> dict:
    """``boost`` of rows that stay in their partitions: a job gives the sums of gradients by node, feature and bin for all
    nodes that can be cut next, so a tree takes about as many jobs as it is deep. Rows hold their bins and what all trees but
    the last few say; the driver holds one tree's sums."""
    edges = all_bin_edges(rows, bins)
    width, wide = len(edges), max([len(e) for e in edges], default=0) + 1
    positive, whole = rows.agg(F.sum(F.col("y") * F.col("w")), F.sum("w")).first()
    mean = positive / whole
    start = float(np.log(mean / (1 - mean))) if 0 < mean < 1 else 0.0
    kinds = pa.schema([("bins", pa.binary()), ("y", pa.float64()), ("w", pa.float64()), ("raw", pa.float64())])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _features(pa.Table.from_batches([b]), width)
            places = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in places], pa.binary()), b["y"], b["w"], pa.array(np.full(len(x), start))], schema=kinds)

    def columns(b: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(b["bins"].to_pylist()), dtype=np.uint8).reshape(-1, width).T

    def raws(b: pa.RecordBatch, x: np.ndarray, last: list[dict]) -> np.ndarray:
        return b["raw"].to_numpy() + sum((_walk(x, t) for t in last), np.zeros(b.num_rows))

    def added(last: list[dict]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b["bins"], b["y"], b["w"], pa.array(raws(b, columns(b), last))], schema=kinds)

        return run

    def sums(last: list[dict], tree: dict, asked: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = asked * width * wide
            total = np.zeros((3, cells))
            for b in batches:
                x, y, w = columns(b), b["y"].to_numpy(), b["w"].to_numpy()
                node = _walk(x, tree)
                at = np.flatnonzero(node >= 0)
                p = 1 / (1 + np.exp(-raws(b, x, last)))
                for f in range(width):
                    cell = (node[at] * width + f) * wide + x[f, at]
                    for k, v in enumerate((w * (p - y), w * p * (1 - p), np.ones(len(y)))):
                        total[k] += np.bincount(cell, v[at], cells)
            met = np.flatnonzero(total[2])
            yield pa.RecordBatch.from_arrays([pa.array(met), *[pa.array(t[met]) for t in total]], names=["cell", "g", "h", "n"])

        return run

    spec = "bins binary, y double, w double, raw double"
    held = settle(rows.mapInArrow(binned, spec), "binned")
    out: list[list] = [[], [], [], [], [], []]
    last: list[dict] = []
    for _ in range(rounds if 0 < mean < 1 else 0):
        known: dict = {}
        tree, asked = _best_first(known, leaves)
        while asked:
            each = held.mapInArrow(sums(last, _to_paths(known, asked), len(asked)), "cell long, g double, h double, n double")
            found = each.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")]).toArrow()
            cells = np.zeros((len(asked) * width * wide, 3))
            cells[found["cell"].to_numpy()] = np.stack([found[c].to_numpy() for c in ("g", "h", "n")], axis=1)
            for path, own in zip(asked, cells.reshape(len(asked), width, wide, 3), strict=True):
                gradient, hessian, _n = own[0].sum(axis=0)
                known[path] = (*_cut(own, l2, leaf), -gradient / (hessian + l2) * rate)
            tree, asked = _best_first(known, leaves)
        first = len(out[1])
        out[0].append(first)
        out[1] += tree["f"]
        out[2] += [float(edges[f][b]) if f >= 0 else 0.0 for f, b in zip(tree["f"], tree["bin"], strict=True)]
        for k, side in ((3, "left"), (4, "right")):
            out[k] += [first + i if i >= 0 else -1 for i in tree[side]]
        out[5] += tree["value"]
        last.append({"f": np.array(tree["f"]), "cut": np.array(tree["bin"]), "left": np.array(tree["left"]), "value": np.array(tree["value"])})
        if len(last) == FOLD:
            held, last = settle(held.mapInArrow(added(last), spec), "binned"), []
    return _model(start, *out)


# --- application -----------------------------------------------------------------------------------------


def leaf_values(x: np.ndarray, model: dict) -> np.ndarray:
    """The value that each row (of x) meets in each tree."""
    at = np.broadcast_to(model["roots"], (len(x), len(model["roots"]))).copy()
    row = np.arange(len(x))[:, None]
    while (inner := model["f"][at] >= 0).any():
        left = x[row, np.maximum(model["f"][at], 0)] <= model["cut"][at]
        at = np.where(inner, np.where(left, model["left"][at], model["right"][at]), at)
    return model["value"][at]


def add_values(rows: DataFrame, model: dict, features: str, total: str) -> DataFrame:
    """rows with the sum of a model's leaf values added to the column ``total``; null for rows without features."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    order = [f for f in rows.schema.fields if f.name != total]
    schema = T.StructType([*order, T.StructField(total, T.DoubleType())])
    frame = rows if total in rows.columns else rows.withColumn(total, F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, sums = batch.column(features), batch.column(total).to_numpy(zero_copy_only=False).astype(np.float64)
            known = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
            if len(known):
                x = np.stack([np.asarray(v[i].as_py(), dtype=np.float64) for i in known.tolist()])
                sums[known] += leaf_values(x, shared.value).sum(axis=1)
            none = np.ones(batch.num_rows, dtype=bool)
            none[known] = False
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in order], pa.array(sums, pa.float64(), mask=none)], names=schema.fieldNames())

    return frame.mapInArrow(run, schema)


def _chunks(sizes: list[tuple[int, int]], most: int) -> Iterator[tuple[int, int]]:
    """Stretches of trees (first, last) that hold ``most`` nodes, or one tree."""
    first, held = 0, 0
    for k, (_, n) in enumerate(sizes):
        if held and held + n > most:
            yield sizes[first][0], sizes[k - 1][0]
            first, held = k, 0
        held += n
    if sizes:
        yield sizes[first][0], sizes[-1][0]


def score_extra_trees(rows: DataFrame, forest: DataFrame, features: str = "v", out: str = "probability") -> DataFrame:
    """rows with the mean of the values their features meet in all trees; a bounded number of nodes is broadcast at a time,
    and where there are more the sums are written down after each time, so that a task serves one at a time."""
    sizes = [tuple(r) for r in forest.groupBy("tree").agg(F.count("*")).orderBy("tree").collect()]
    scored, parts = rows, list(_chunks(sizes, NODES))
    for first, last in parts:
        t = forest.filter(F.col("tree").between(first, last)).orderBy("tree", "node").toPandas()
        tree, node, f = t["tree"].to_numpy(np.int64), t["node"].to_numpy(np.int64), t["f"].fillna(-1).to_numpy(np.int32)
        starts = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
        left = np.full(len(t), -1, dtype=np.int64)
        for a, b in zip(starts, [*starts[1:], len(t)], strict=True):
            left[a:b] = a + np.searchsorted(node[a:b], 2 * node[a:b] + 1)
        model = {"roots": starts, "f": f, "cut": t["cut"].fillna(0.0).to_numpy(), "left": left, "right": left + 1, "value": t["value"].to_numpy()}
        scored = add_values(scored, model, features, out)
        scored = settle(scored, "scored") if len(parts) > 1 else scored
    return scored.withColumn(out, F.col(out) / float(max(1, len(sizes)))) if sizes else rows.withColumn(out, F.lit(None).cast("double"))


def _walk(columns: np.ndarray, model: dict) -> np.ndarray:
    """The value that each row meets in one tree; rows are columns here."""
    at, rows = np.zeros(columns.shape[1], dtype=np.int64), np.arange(columns.shape[1])
    while len(rows):
        inner = model["f"][at[rows]] >= 0
        rows = rows[inner]
        k = at[rows]
        at[rows] = model["left"][k] + ~(columns[model["f"][k], rows] <= model["cut"][k])
    return model["value"][at]


def grow_and_score(train: DataFrame, test: DataFrame, trees: int, leaf: int, share: float, depth: int | None, seed: int, bagged: bool, features: str = "v", out: str = "probability") -> DataFrame:
    """test rows with the mean of the values that their features meet in all trees: those of ``fit_forest`` (bagged) or of
    ``fit_extra_trees`` on train rows (v, y, w, id), which have features."""
    spark = train.sparkSession
    width, n = train.agg(F.max(F.size("v")), F.count("*")).first()
    rows = settle(test.withColumn("_row", F.monotonically_increasing_id()), "test")
    if not n or not width or (n + rows.count()) * width > HELD:
        forest = fit_forest(train, trees, leaf, share, depth, seed) if bagged else fit_extra_trees(train, trees, leaf, share, depth, seed)
        return score_extra_trees(test, forest, features, out)
    most, deepest = max(1, int(share * width)), min(DEPTH, DEPTH if depth is None else depth)
    t = train.select("v", (F.col("y") > 0).alias("y"), "w", "id").toArrow().sort_by("id")
    known = rows.filter(F.col(features).isNotNull()).select(F.col(features).alias("v"), "_row").toArrow()
    matrix = lambda t: np.ascontiguousarray(_features(t, width)) if len(t) else np.zeros((0, width))
    shared = spark.sparkContext.broadcast((matrix(t), *(t[c].to_numpy() for c in ("y", "w", "id")), np.ascontiguousarray(matrix(known).T), known["_row"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, w, ids, asked, row = shared.value
        total, any_ = np.zeros(len(row)), False
        for tree in (i for batch in batches for i in batch.column(0).to_pylist()):
            of, own, scale, any_ = (w * y, w * ~y), slice(None), (1.0, 1.0), True
            if bagged:
                u = (_mixed_all(ids.view(np.uint64), _mixed(tree, _mixed(seed + 2, 42))) & np.uint64((1 << 53) - 1)).astype(np.float64) / float(1 << 53)
                k = np.searchsorted(BAG, u, side="right")
                k = k if k.any() else np.ones(len(k), dtype=np.int64)
                own, ones = k > 0, int(k[y].sum())
                of, scale = (k[own] * y[own], k[own] * ~y[own]), tuple(k.sum() / (2.0 * c) if c else 0.0 for c in (ones, int(k.sum()) - ones))
            total += _walk(asked, _grow(x[own], y[own], of, scale, tree, 0, 0, most, leaf, deepest, seed, bagged))
        if any_:
            for a in range(0, len(row), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(row[a : a + 100_000]), pa.array(total[a : a + 100_000])], names=["_row", "_sum"])

    tasks = min(trees, 2 * spark.sparkContext.defaultParallelism)
    sums = spark.range(0, trees, 1, tasks).mapInArrow(run, "_row long, _sum double").groupBy("_row").agg((F.sum("_sum") / trees).alias(out))
    return rows.join(settle(sums, "sums"), "_row", "left").select(*test.columns, out)


def score_boosted(rows: DataFrame, model: dict, features: str = "v", out: str = "probability") -> DataFrame:
    return add_values(rows, model, features, out).withColumn(out, 1 / (1 + F.exp(-(F.col(out) + model["start"]))))
