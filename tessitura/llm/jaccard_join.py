"""N-gram Jaccard join with count-vector R-trees; near-duplicate components over whole texts.

Steps (two texts link when 100 * |A & B| >= 80 * |A | B| over their sets of five-word shingles):

1. Texts with equal sets fall into one class (a 64-bit fingerprint of the set), so exact copies are never paired.
2. Shingles are hashed into groups. A linking pair of sizes a, b differs in at most H = floor((a + b) / 9) shingles, so of
   m > H groups at least m - H hold the same shingles on both sides. Each class files the first H + 1 of its groups,
   fullest first (an order both sides share, so two such prefixes always meet); classes filed under one key form a
   block. m follows size bands that double; a class near the lower edge of the next band is filed there too. This is
   exact for every pair, has no cap, and keeps shared passages from filling blocks, as groups that hold only a passage
   are small and come last.
3. In a block, classes are points of an R-tree over group counts (``count_tree``). A node bounds the overlap with a query
   by the sum of coordinate minima; pairs whose bound reaches the threshold make the block's candidate components, whose
   edges to their first class leave: fewer than the block has members, however many pairs there are.
4. Families are the components of all these edges. Every link lies inside a family. A family's sets meet in a task, where
   the R-tree gives its pairs again, best bound first; a pair is verified on the sets themselves unless both are joined
   already, and again only edges to a component's first class leave.
   Large blocks and families are compared with a few pivots first, by their bounds or by the sets themselves: where all
   members join, as those of one text's near copies do, no pair is bounded at all, and work follows the members.
5. Components of the verified edges are the answer.

A single R-tree over all texts was not kept: unrelated texts of one size are all about equally far apart in count space,
so its nodes prune nothing and the work is quadratic (see the README); the filing of step 2 deals texts to trees. Inside a
block or family of k texts the bounds are still taken of up to k * k pairs where sizes and nodes don't prune.

Scale: keys travel packed, one row per task and shard, and never as rows of their own; shards follow the number of keys.
A class with a third of all rows is filed once per task, and a key that ``LOCAL`` classes of one flush share sends one
unit for them, while its members go elsewhere as a block of their own, so no task gathers a hot key. Keys that more than
``HOT`` classes hold (a passage of a third of all texts) are found in a first filing; a second one files them last, so
that only texts made of little else file them at all, and units of a block whose classes aren't one family yet are
unfolded. Large blocks and families are dealt in parts, whose pairs are cells, so no task holds one whole. Hot classes
and components are joined by ``skew_join``. Texts are read four times and never shuffled: the few vectors and sets needed
are found by a bit map of fixed size (``BITS``) before their texts are split.

Defined cases: null or blank text has an empty set, no links and itself as component; a null id never names a component
unless all ids of it are null; repeated ids are separate rows; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import numbered
from .common import lean, settle, skew_join, small, tidy
from .count_tree import bounds_reach, by_pivots, count_vectors, reaching_pairs, roots
from .shingles import U, mix, shingle_sets

LOCAL, SMALL, LEAST_PART, BITS, FLUSH = 32, 64, 128, 1 << 25, 1_000_000
#: Members from which a block of a cell, or a family, is compared with a few pivots before its pairs are bounded.
PIVOT_BLOCK, PIVOT_FAMILY = 256, 64
SLOT_ROWS, CELL_ROWS, PART_LOAD = 20_000, 1_000, 8_000_000
#: Keys held by more than HOT classes are filed last; so many such keys (8 bytes each) are known to every task at most.
HOT, HOT_KEYS, KEYS_PER_SHARD = 20_000, 1_000_000, 4_000_000
NO_ID = -(1 << 63)
_BAND, _GROUP, _SIZE = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
KEY_BYTES, SET_BYTES = 7, 6


def links(a: int, b: int, common: int, percent: int = 80) -> bool:
    return 100 * common >= percent * (a + b - common)


def _slices(batch: pa.RecordBatch, text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text."""
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
        to = min(batch.num_rows, max(to, at + 1))
        yield batch.slice(at, to - at)
        at = to


def _reduce(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum (wrapping) of each stretch; 0 for empty ones."""
    total = np.zeros(len(x) + 1, dtype=x.dtype)
    np.cumsum(x, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def class_ids(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprint of each set, as signed 64-bit integers."""
    n = np.diff(offsets).astype(U)
    return mix(_reduce(mix(flat ^ _SIZE), offsets) + n * _SIZE).view(np.int64)


# --- step 2: filing ---------------------------------------------------------------------------------------------------


def band_of(n: np.ndarray) -> np.ndarray:
    """Bands [4, 8), [8, 16), ...; smaller sets link with equal sets only."""
    return np.floor(np.log2(np.maximum(n, 4) / 4 + 1e-12)).astype(np.int64)


def groups_of(band: int) -> int:
    top = (8 << band) - 1
    return -(-5 * top // 16) + 2


def _file_band(flat, offsets, which, band: int, prefix, late: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(56-bit keys, index into ``which``) of the sets ``which`` in one band; prefix: keys wanted of each; late: sorted
    keys that come last."""
    m = groups_of(band)
    size = offsets[which + 1] - offsets[which]
    take = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(offsets[which], size)
    h, owner = flat[take], np.repeat(np.arange(len(which)), size)
    at = owner * m + ((h >> U(20)) % U(m)).astype(np.int64)
    held = np.bincount(at, minlength=len(which) * m).reshape(len(which), m)
    sums = np.zeros(len(which) * m, dtype=U)
    np.add.at(sums, at, mix(h ^ _GROUP))
    key = mix(sums.reshape(len(which), m) + np.arange(1, m + 1, dtype=U) * _GROUP + np.full(1, band + 1, dtype=U) * _BAND) >> U(8)
    rank = U(254) - np.minimum(held, 254).astype(U)  # fullest groups first, then by key
    if len(late):
        rank[late[np.minimum(np.searchsorted(late, key), len(late) - 1)] == key] = 255
    order = np.sort(rank << U(56) | key, axis=1)
    first = np.arange(m)[None, :] < prefix[:, None]
    return order[first] & U((1 << 56) - 1), np.repeat(np.arange(len(which)), np.minimum(prefix, m))


def file_sets(flat: np.ndarray, offsets: np.ndarray, late: np.ndarray = np.zeros(0, dtype=U)) -> tuple[np.ndarray, np.ndarray]:  # noqa: B008
    """(keys, index of the set) over all sets: what step 2 files."""
    n = np.diff(offsets)
    band = band_of(n)
    keys, sets = [np.zeros(0, dtype=U)], [np.zeros(0, dtype=np.int64)]
    for b in np.unique(band[n >= 4]).tolist():
        top = (8 << b) - 1
        own = np.flatnonzero((band == b) & (n >= 4))
        up = own[5 * n[own] >= 4 * (top + 1)]
        for target, which in ((b, own), (b + 1, up)):
            if not len(which):
                continue
            partner = 5 * n[which] // 4 if target > b else np.minimum(5 * n[which] // 4, top)
            width = max(1, (4 << 20) // (8 * groups_of(target)))  # sets at a time, for memory
            for s in range(0, len(which), width):
                k, i = _file_band(flat, offsets, which[s : s + width], target, (n[which[s : s + width]] + partner[s : s + width]) // 9 + 1, late)
                keys.append(k)
                sets.append(which[s : s + width][i])
    return np.concatenate(keys), np.concatenate(sets)


def _pack(keys: np.ndarray, classes: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """Keys of a flush by shard: number of classes, classes, number of keys, 7-byte keys, 2-byte class positions."""
    shard = (keys % U(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        part = order[cuts[s] : cuts[s + 1]]
        named, pos = np.unique(classes[part], return_inverse=True)
        raw = np.ascontiguousarray(keys[part].astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
        yield s, b"".join([np.array([len(named), len(part)], dtype="<i8").tobytes(), named.astype("<i8").tobytes(), raw.tobytes(), pos.astype("<u2").tobytes()])


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    c, n = np.frombuffer(blob, dtype="<i8", count=2)
    named = np.frombuffer(blob, dtype="<i8", count=c, offset=16)
    raw = np.zeros((n, 8), dtype=np.uint8)
    raw[:, :KEY_BYTES] = np.frombuffer(blob, dtype=np.uint8, count=n * KEY_BYTES, offset=16 + 8 * c).reshape(n, KEY_BYTES)
    pos = np.frombuffer(blob, dtype="<u2", count=n, offset=16 + 8 * c + n * KEY_BYTES)
    return raw.view("<u8").ravel(), named[pos]


def _names(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprint of the members of each stretch of values."""
    total = np.r_[U(0), np.cumsum(mix(values.view(U)), dtype=U)]
    return mix(total[end] - total[begin]).view(np.int64)


def fold_local(keys: np.ndarray, classes: np.ndarray, least: int = LOCAL) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """A flush's keys that ``least`` classes or more share become units: (keys and classes that stay single, units as rows
    of key, name, pivot and number of members, members by name). What a key sends to its shard then follows the flushes, not its members."""
    order = np.lexsort((classes, keys))
    keys, classes = keys[order], classes[order]
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    end = np.r_[begin[1:], len(keys)].astype(np.int64)
    many = end - begin >= least
    single = np.repeat(~many, end - begin)
    begin, end = begin[many], end[many]
    names = _names(classes, begin, end)
    units = np.stack([keys[begin].view(np.int64), names, classes[begin], end - begin], axis=1) if len(begin) else np.zeros((0, 4), dtype=np.int64)
    return keys[single], classes[single], units, {int(n): classes[a:b] for n, a, b in zip(names, begin, end, strict=True)}


def common_keys(keys: np.ndarray, units: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys that more than ``most`` classes hold, and how many; a unit counts by its members."""
    named, at = np.unique(np.r_[keys, units[:, 0].view(U)], return_inverse=True)
    times = np.bincount(at, weights=np.r_[np.ones(len(keys)), units[:, 3]], minlength=len(named))
    return named[times > most].view(np.int64), times[times > most].astype(np.int64)


def _blocks(keys: np.ndarray, classes: np.ndarray, units: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(name, members, unit of each member or 0) of each distinct member list with two members or more; a unit's member is
    its pivot."""
    keys = np.r_[keys, units[:, 0].view(U)]
    tag = np.r_[np.zeros(len(classes), dtype=np.int64), units[:, 1]]
    classes = np.r_[classes, units[:, 2]]
    order = np.lexsort((tag, classes, keys))
    keys, classes, tag = keys[order], classes[order], tag[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1]) | (tag[1:] != tag[:-1])
    keys, classes, tag = keys[fresh], classes[fresh], tag[fresh]
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    end = np.r_[begin[1:], len(keys)].astype(np.int64)
    many = end - begin > 1
    begin, end = begin[many], end[many]
    named = _names(classes ^ mix(tag.view(U)).view(np.int64), begin, end)
    _, first = np.unique(named, return_index=True)
    for i in first.tolist():
        yield int(named[i]), classes[begin[i] : end[i]], tag[begin[i] : end[i]]


# --- step 3: candidates through R-trees ----------------------------------------------------------------------------------


def _slots(rows: int, shards: int) -> int:
    """Tasks for so many rows."""
    return max(shards, rows // SLOT_ROWS)


def _cells(rows: DataFrame, block: str, sizes: DataFrame, shards: int) -> DataFrame:
    """rows (block, members, cls, ...) in cells (home, i, j), with each row's part of its block and the cell's slot.

    Blocks up to SMALL members share a cell with others; larger ones are dealt in parts whose pairs are cells. A part is
    two tasks' fair share of the rows, within bounds, and holds PART_LOAD shingles at most on average. Cells of large
    blocks take slots in turn, largest first, so that no task gets many of them. sizes: cls, n.
    """
    total = rows.count()
    slots, most = _slots(total, shards), min(2048, max(LEAST_PART, 2 * total // shards))
    own = rows.filter(F.col("members") <= SMALL)
    own = own.withColumn("home", F.pmod(F.xxhash64(block), F.lit(max(slots, total // CELL_ROWS))))
    own = own.withColumns({"i": F.lit(0), "j": F.lit(0), "part": F.lit(0), "slot": F.pmod("home", F.lit(slots)).cast("int")}).drop("members")
    large = rows.filter(F.col("members") > SMALL)
    if large.isEmpty():
        return own
    load = large.select(block, "cls", "members").join(sizes.select("cls", "n"), "cls").groupBy(block).agg(F.first("members").alias("m"), F.sum("n").alias("load"))
    parts = settle(load.select(F.col(block).alias("home"), "m", F.ceil(F.greatest(F.col("m") / most, F.col("load") / PART_LOAD)).cast("int").alias("parts")), "parts")
    cells = parts.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("j", F.explode(F.sequence(F.col("i"), F.col("parts") - 1)))
    share = F.col("m") / F.col("parts") * F.when(F.col("i") == F.col("j"), 1).otherwise(2)
    slot = numbered(cells.withColumn("share", share), F.desc("share"), F.asc("home"), F.asc("i"), F.asc("j")).select("home", "i", "j", F.pmod("_pos", F.lit(slots)).cast("int").alias("slot"))
    dealt = large.drop("members").withColumn("home", F.col(block)).join(small(parts.select("home", "parts")), "home").withColumn("part", F.pmod(F.xxhash64("cls"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    return own.unionByName(dealt.join(small(slot), ["home", "i", "j"]).select(*own.columns))


def _in_cells(cells: DataFrame, run, slots: int) -> DataFrame:
    """run of each cell's rows, (a, b) edges, distinct. A task holds one cell at a time."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield from run(pa.Table.from_batches(held)).to_batches()
                held.clear()

        last = None
        for batch in batches:
            key = np.stack([batch[c].to_numpy() for c in ("home", "i", "j")], axis=1) if batch.num_rows else np.zeros((0, 3))
            cuts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(key)] if len(key) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if last is not None and tuple(key[a]) != last:
                    yield from flush()
                held.append(batch.slice(a, b - a))
                last = tuple(key[a])
        yield from flush()

    dealt = cells.repartitionById(slots, F.col("slot")).sortWithinPartitions("home", "i", "j").drop("slot")
    return dealt.mapInArrow(tidy(stream), "a long, b long").distinct()


def _sorted(t: pa.Table, block: str) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The table by block and class, with number of the block, classes, sizes and parts."""
    t = t.take(pa.array(np.lexsort((t["cls"].to_numpy(), t[block].to_numpy()))))
    label = np.unique(t[block].to_numpy(), return_inverse=True)[1]
    return t, label, t["cls"].to_numpy(), t["n"].to_numpy(), t["part"].to_numpy()


def _stars(cls: np.ndarray, label: np.ndarray) -> pa.Table:
    """Each class but a component's first, with that first."""
    far = np.flatnonzero(label != np.arange(len(label)))
    return pa.table({"a": pa.array(cls[label[far]], pa.int64()), "b": pa.array(cls[far], pa.int64())})


def candidates(blocks: DataFrame, vectors: DataFrame, shards: int) -> DataFrame:
    """Edges (a, b) that join what the count vectors can't tell apart in any block: in each cell the pairs whose summed
    minima reach the threshold give components, of which the edges to the first class leave. blocks: block, cls,
    members; vectors: cls, n, vec."""
    def run(t: pa.Table) -> pa.Table:
        t, label, cls, n, part = _sorted(t, "block")
        vec = t["vec"].to_pylist()
        start, whole = by_pivots(label, PIVOT_BLOCK, bounds_reach(vec, n))
        rest = np.flatnonzero(~whole)
        a, b, _ = reaching_pairs([vec[i] for i in rest.tolist()], n[rest], label[rest], part[rest])
        return _stars(cls, roots(len(cls), rest[a], rest[b], start))

    cells = settle(_cells(blocks.select("block", "cls", "members"), "block", vectors, shards), "cells")
    return _in_cells(cells.join(vectors, "cls"), run, _slots(cells.count(), shards))


def _bitmap(df: DataFrame, col: str, bits: int) -> bytes:
    """A bit map of fixed size in which every value of col has its bit."""
    at = F.pmod(F.xxhash64(col), F.lit(bits))
    words = df.select(at.alias("at")).selectExpr("cast(at div 64 as int) w", "shiftleft(1L, cast(at % 64 as int)) b")
    got = words.groupBy("w").agg(F.expr("bit_or(b)").alias("b")).toPandas()  # at most bits / 64 rows
    out = np.zeros(bits // 64, dtype=np.int64)
    out[got["w"].to_numpy(dtype=np.int64)] = got["b"].to_numpy(dtype=np.int64)
    return out.tobytes()


def _again(docs: DataFrame, wanted: DataFrame, width: int, whole: bool) -> DataFrame:
    """(cls, n, vec) of the wanted (id, cls), with the sets' elements for vec if whole. A bit map of fixed size spares
    splitting most other texts."""
    bits, count = 1 << 16, wanted.count()
    while bits < BITS and bits < 64 * count:
        bits *= 2
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted, "id", bits))
    marked = docs.withColumn("at", F.pmod(F.xxhash64("id"), F.lit(bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, seen = np.frombuffer(shared.value, dtype=np.uint8), set()
        for batch in batches:
            at = batch["at"].to_numpy()
            batch = batch.filter(pa.array(bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0))
            for part in _slices(batch, "text"):
                flat, offsets = shingle_sets(part["text"], width)
                cls, n = class_ids(flat, offsets), np.diff(offsets)
                if whole:
                    raw = np.ascontiguousarray(flat.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :SET_BYTES]
                    vec = [raw[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                else:
                    vec = count_vectors(flat, offsets)
                new = [i for i in np.flatnonzero(n).tolist() if int(cls[i]) not in seen and not seen.add(int(cls[i]))]
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array(cls[new]), pa.array(n[new]), pa.array([vec[i] for i in new], pa.binary())], ["cls", "n", "vec"])

    found = marked.select("at", "text").mapInArrow(tidy(run), "cls long, n long, vec binary")
    return found.join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])


# --- steps 4 and 5: verification and components ---------------------------------------------------------------------------


def _elements(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // SET_BYTES, 8), dtype=np.uint8)
    out[:, :SET_BYTES] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, SET_BYTES)
    out = out.view("<u8").ravel()
    out.sort()
    return out


def link_sets(sets: list[np.ndarray], n: np.ndarray, label: np.ndarray, part: np.ndarray, percent: int = 80) -> np.ndarray:
    """Component (its first position) of each set by links inside a cell. Pairs come in order of their bound; one whose
    sets are joined already is not verified, for it can't change a component."""
    def linked(i: int, j: int) -> bool:
        both = np.concatenate([sets[i], sets[j]])
        both.sort(kind="stable")
        return links(int(n[i]), int(n[j]), int((both[1:] == both[:-1]).sum()), percent)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        fit = 100 * np.minimum(n[i], n[others]) >= percent * np.maximum(n[i], n[others])
        return np.array([f and linked(i, j) for f, j in zip(fit.tolist(), others.tolist(), strict=True)], dtype=bool)

    root, whole = by_pivots(label, PIVOT_FAMILY, near)
    rest = np.flatnonzero(~whole)
    flat = np.concatenate([np.zeros(0, dtype=U), *[sets[i] for i in rest.tolist()]])
    a, b, score = reaching_pairs(count_vectors(flat, np.r_[0, np.cumsum([len(sets[i]) for i in rest.tolist()])].astype(np.int64)), n[rest], label[rest], part[rest], percent)
    order = np.argsort(-score, kind="stable")
    a, b = rest[a[order]], rest[b[order]]
    for s in range(0, len(a), 1024):
        x, y = a[s : s + 1024], b[s : s + 1024]
        apart = root[x] != root[y]
        joined: dict[int, int] = {}  # roots joined within this stretch

        def find(v: int, joined=joined, root=root) -> int:
            v = int(root[v])
            while v in joined:
                v = joined[v]
            return v

        for i, j in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
            p, q = find(i), find(j)
            if p == q:
                continue
            if linked(i, j):
                joined[max(p, q)] = min(p, q)
        if joined:
            root = roots(len(sets), np.array(list(joined)), np.array(list(joined.values())), root)
    return root


def verified(families: DataFrame, sets: DataFrame, shards: int, percent: int) -> DataFrame:
    """Edges (a, b) that give the components of links. families: fam, cls, members. Sets travel once for each cell."""
    def run(t: pa.Table) -> pa.Table:
        t, label, cls, n, part = _sorted(t, "fam")
        return _stars(cls, link_sets([_elements(v.as_buffer()) for v in t["vec"]], n, label, part, percent))

    cells = settle(_cells(families, "fam", sets, shards), "cells")
    return _in_cells(cells.join(sets, "cls"), run, _slots(cells.count(), shards))


def components(edges: DataFrame) -> DataFrame:
    """(cls, comp): the smallest class that links reach, by min-label propagation with pointer jumping."""
    both = settle(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), "edges")
    labels = settle(both.groupBy(F.col("u").alias("cls")).agg(F.least(F.min("v"), F.first("u")).alias("comp")), "labels")
    while True:
        near = skew_join(both, labels.withColumnRenamed("cls", "v"), "v", "inner").groupBy(F.col("u").alias("k")).agg(F.min("comp").alias("low"))
        low = labels.join(near, labels["cls"] == near["k"]).select("cls", "comp", F.least("comp", "low").alias("low"))
        jump = labels.select(F.col("cls").alias("low"), F.col("comp").alias("far"))
        new = settle(skew_join(settle(low, "low"), jump, "low").select("cls", F.col("comp").alias("was"), F.least("low", F.coalesce("far", "low")).alias("comp")), "labels")
        if new.filter("was <> comp").isEmpty():
            return new.select("cls", "comp")
        labels = new.select("cls", "comp")


def _unfolded(blocks: DataFrame, comps: DataFrame) -> DataFrame:
    """(block, cls, members) of the blocks that hold a unit and whose classes, those of their units too, aren't in one
    family yet, with units replaced by their members."""
    label = settle(blocks.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "labelled")
    apart = label.groupBy("block").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("block")
    inside = label.filter("unit <> 0").join(apart.withColumnRenamed("block", "unit"), "unit", "left_semi").select("block")
    folded = label.filter("unit <> 0").select("block").distinct()
    rows = label.join(folded.join(apart.union(inside).distinct(), "block", "left_semi"), "block", "left_semi").select("block", "cls", "unit")
    members = label.filter("unit = 0").select(F.col("block").alias("unit"), "cls")  # a unit is a block of its own
    whole = rows.filter("unit = 0").drop("unit").union(rows.filter("unit <> 0").select("block", "unit").join(members, "unit").select("block", "cls")).distinct()
    return settle(whole.join(whole.groupBy("block").agg(F.count("*").alias("members")), "block"), "unfolded")


def _filed(docs: DataFrame, width: int, shards: int, local: int, hot: int, late: np.ndarray) -> DataFrame:
    """Step 2: (block, cls, unit, members) of every block, and (key, null, null, members) of every key that more than ``hot``
    classes hold; late: sorted keys to file last."""
    last = docs.sparkSession.sparkContext.broadcast(late)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, told, keys, classes, held, named = set(), set(), [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            k, c, units, inside = fold_local(np.concatenate(keys), np.concatenate(classes), local)
            out = [(s, "blob", b) for s, b in _pack(k, c, shards)]
            of = (units[:, 0].view(U) % U(shards)).astype(np.int64)
            out += [(int(s), "units", np.ascontiguousarray(units[of == s]).astype("<i8").tobytes()) for s in np.unique(of)]
            out += [(n % shards, "local", m.astype("<i8").tobytes()) for n, m in inside.items() if n not in told]  # dealt by name, not by key
            told.update(inside)
            for a in range(0, len(out), 256):
                part = out[a : a + 256]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int32()), *(pa.array([x[2] if x[1] == kind else None for x in part], pa.binary()) for kind in ("blob", "units", "local"))],
                                                 ["shard", "blob", "units", "local"])

        for batch in batches:
            for part in _slices(batch, "text"):
                flat, offsets = shingle_sets(part["text"], width)
                cls = class_ids(flat, offsets)
                new = np.array([int(c) not in seen and not seen.add(int(c)) for c in cls], dtype=bool)
                size = np.diff(offsets)
                keep = np.repeat(new, size)
                k, i = file_sets(flat[keep], np.r_[0, np.cumsum(size[new])], last.value)
                if named + len(cls) > 65_535 or held + len(k) > FLUSH:
                    yield from flush()
                    keys, classes, held, named = [], [], 0, 0
                keys.append(k)
                classes.append(cls[new][i])
                held, named = held + len(k), named + len(cls)
        yield from flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, units = [], [np.zeros((0, 4), dtype=np.int64)]

        def rows(name: int, members: np.ndarray, tag: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(members), 50_000):
                part, unit = members[a : a + 50_000], tag[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), name)), pa.array(part), pa.array(unit), pa.array(np.full(len(part), len(members)))], ["block", "cls", "unit", "members"])

        for batch in batches:
            blobs += [_unpack(x.as_buffer()) for x in batch["blob"] if x.is_valid]
            units += [np.frombuffer(x.as_buffer(), dtype="<i8").reshape(-1, 4) for x in batch["units"] if x.is_valid]
            for x in batch["local"]:
                if x.is_valid:  # a block of its own, passed on as it comes
                    members = np.frombuffer(x.as_buffer(), dtype="<i8")
                    name = int(_names(members, np.array([0]), np.array([len(members)]))[0])
                    yield from rows(name, members, np.zeros(len(members), dtype=np.int64))
        none = (np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64))
        keys, classes = (np.concatenate([none[i], *(b[i] for b in blobs)]) for i in range(2))
        blobs.clear()
        units = np.concatenate(units)
        named, times = common_keys(keys, units, hot)
        if len(named):
            yield pa.RecordBatch.from_arrays([pa.array(named), *[pa.nulls(len(named), pa.int64())] * 2, pa.array(times)], ["block", "cls", "unit", "members"])
        for name, members, tag in _blocks(keys, classes, units):
            yield from rows(name, members, tag)

    filed = docs.select("text").mapInArrow(tidy(file), "shard int, blob binary, units binary, local binary").repartitionById(shards, F.col("shard"))
    return settle(filed.mapInArrow(tidy(gather), "block long, cls long, unit long, members long").distinct(), "blocks")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, local: int = LOCAL, hot: int = HOT, mark: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, the row's class cls (null for an empty set), the class
    keep_cls of the component's first row (smallest id, of equal ids the smallest class), and ``mark`` if one is given."""
    if percent != 80:
        raise ValueError("filing and size bands are worked out for a similarity of 0.8")
    spark = docs.sparkSession
    lean(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = rows if mark is None else docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), mark.alias("mark"))
    more = [] if mark is None else ["mark"]
    docs = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text")

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "text"):
                flat, offsets = shingle_sets(part["text"], width)
                n = np.diff(offsets)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n), pa.array(class_ids(flat, offsets), mask=n == 0), *(part[c] for c in more)], ["doc_id", "n", "cls", *more])

    kind = "" if mark is None else f", mark {marked.schema['mark'].dataType.simpleString()}"
    known = settle(marked.mapInArrow(tidy(classify), "doc_id long, n long, cls long" + kind), "classes")
    points = known.filter("n > 0").groupBy("cls").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("id"))
    keys = known.agg(F.sum(F.expr("n div 4 + 1"))).first()[0] or 0  # about what is filed
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), keys // KEYS_PER_SHARD)

    filed = _filed(docs, width, shards, local, hot, np.zeros(0, dtype=U))
    most = filed.filter(F.col("cls").isNull()).orderBy(F.desc("members"), "block").limit(HOT_KEYS)
    late = np.array([r["block"] for r in most.select("block").collect()], dtype=np.int64).view(U)
    if len(late):  # keys that very many share are filed last, if at all
        filed = _filed(docs, width, shards, local, hot, np.sort(late))
    blocks = filed.filter(F.col("cls").isNotNull())
    met = settle(points.join(blocks.select("cls").distinct(), "cls", "left_semi"), "points")  # only classes that met another
    vectors = settle(_again(docs, met, width, whole=False), "vectors")
    edges = settle(candidates(blocks, vectors, shards), "candidates")
    families = components(edges)
    if not blocks.filter("unit <> 0").isEmpty():
        edges = edges.union(settle(candidates(_unfolded(blocks, families), vectors, shards), "candidates"))
        families = components(edges)
    families = skew_join(families, families.groupBy("comp").agg(F.count("*").alias("members")), "comp", "inner").withColumnRenamed("comp", "fam")
    families = settle(families, "families")
    sets = settle(_again(docs, met.join(families.select("cls"), "cls", "left_semi"), width, whole=True), "sets")
    comps = components(settle(verified(families, sets, shards, percent), "links"))

    ids = known.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("low")).join(comps, "cls", "left")
    ids = settle(ids.withColumn("comp", F.coalesce("comp", "cls")), "ids")
    # the first row of a component; rows without an id come last
    first = F.min(F.struct(F.col("low").isNull().alias("none"), "low", "cls"))
    whole = ids.groupBy("comp").agg(first.alias("f")).select("comp", F.col("f.low").alias("component_id"), F.col("f.cls").alias("keep_cls"))
    of = settle(skew_join(ids, whole, "comp").select("cls", "component_id", "keep_cls"), "members")
    own = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return skew_join(known, of, "cls").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "cls", "keep_cls", *more)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the first row: the smallest id, of equal ids the smallest class; all columns. Rows without words
    stay. Rows are told apart by id and text, so a row that shares its id with a near copy stays; rows alike in both id
    and words can't be told apart and share their fate."""
    digest = F.unhex(F.sha2(F.col(text_col), 256))
    comp = near_components(docs, id_col, text_col, mark=digest).filter("cls IS NOT NULL")
    dropped = ~(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("cls") == F.col("keep_cls")))
    gone = small(settle(comp.filter(dropped).select(F.col("doc_id").alias("_gone_id"), F.col("mark").alias("_gone_text")).distinct(), "gone"))
    same = docs[id_col].cast("long").eqNullSafe(gone["_gone_id"]) & (F.unhex(F.sha2(docs[text_col], 256)) == gone["_gone_text"])
    return docs.join(gone, same, "left_anti").select(*docs.columns)
