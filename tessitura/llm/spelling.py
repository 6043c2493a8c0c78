"""Grouping of spelling variants: words one inserted, deleted or replaced letter apart, found by range reporting.

Words are runs of Latin-1 letters and are kept as bytes, one a letter, whose order is that of code points. The words of
one length have a place in forward order and one in reverse order, which makes them points of a plane. For a word and an
edit position k, all words that share its first k letters are an interval of the forward order, all that share what
follows k an interval of the reverse order; the points in that rectangle differ at k alone. A wavelet tree over the
reverse places, in forward order, reports them. Only positions that both the longest shared prefix and the longest
shared suffix allow are asked about. Of the positions that give one and the same insertion the first counts.

Scale: (word, count) is folded per task before the shuffle. A pair of near words shares the first half of the shorter or
its second half, so every word is filed under both halves, as the shorter and as the longer of a pair, and a task has the
trees of the blocks that it was dealt. A position k belongs to one half, so every pair is found once. Blocks of more than
a fair share of the words (``block_rows``) are filed anew by the halves of what is still free of them, again and again
down to one position, where a block holds the letters of the alphabet at most: no hot prefix stays whole and nothing is
capped. A task gives one row for a word, so pairs are never listed. Forms are followed by doubling; a form has ten times
the count, so chains are as short as the digits of the largest count.

Defined cases: a null text has no words; a null id is an empty text before the colon of a change; letters beyond Latin-1,
digits and all else end a word; repeated ids are separate rows; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, settle, tidy

LEAST, TIMES_MORE, HELD, CHUNK = 7, 10, 300_000, 1 << 18
TASK_ROWS, BLOCK_LEAST, BLOCK_MOST = 100_000, 2_000, 50_000


# --- the index of the words of one length ------------------------------------------------------------


class WaveletTree:
    """A permutation by the bits of its values, highest first. A level keeps for every prefix of its sequence how many
    values have a zero there; those with a zero come first in the next level."""

    def __init__(self, values: np.ndarray):
        self.levels: list[tuple[int, np.ndarray]] = []
        for b in reversed(range(max(1, int(len(values) - 1).bit_length()))):
            zero = (values >> b) & 1 == 0
            self.levels.append((b, np.concatenate([[0], np.cumsum(zero)]).astype(np.int32)))
            values = np.concatenate([values[zero], values[~zero]])

    def report(self, begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) for every value in [low, high) at the places [begin, end) of each query."""
        q, value = np.arange(len(begin)), np.zeros(len(begin), dtype=np.int64)
        for b, zeros in self.levels:
            first, last = zeros[begin], zeros[end]
            ones = zeros[-1]
            q, value = np.concatenate([q, q]), np.concatenate([value, value | 1 << b])
            begin, end = np.concatenate([first, ones + begin - first]), np.concatenate([last, ones + end - last])
            live = (begin < end) & (value < high[q]) & (value + (1 << b) > low[q])
            q, value, begin, end = q[live], value[live], begin[live], end[live]
        return q, value


def _matrix(words: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1)


def _backwards(words: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(_matrix(words)[:, ::-1]).view(words.dtype).ravel()


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the words at each place of a and b."""
    n = min(a.dtype.itemsize, b.dtype.itemsize)
    out = np.empty(len(a), dtype=np.int64)
    step = max(1, (CHUNK << 4) // n)
    for i in range(0, len(a), step):
        differ = _matrix(a[i : i + step])[:, :n] != _matrix(b[i : i + step])[:, :n]
        out[i : i + step] = np.where(differ.any(axis=1), differ.argmax(axis=1), n)
    return out


class Order:
    """Words of one length, sorted; prefixes are intervals."""

    def __init__(self, words: np.ndarray):
        self.order = np.argsort(words, kind="stable")
        self.words = words[self.order]

    def longest(self, words: np.ndarray, own: bool) -> np.ndarray:
        """Longest prefix that each word shares with one that is indexed; with ``own`` the word itself, which is, doesn't count."""
        # a word of another length is placed by as many letters as both have; zeros pad and sort first
        at, n = np.searchsorted(self.words, words), len(self.words)
        out = np.zeros(len(words), dtype=np.int64)
        for place in (at - 1, at + 1 if own else at):
            ok = (place >= 0) & (place < n)
            out[ok] = np.maximum(out[ok], _shared(words[ok], self.words[place[ok]]))
        return out

    def interval(self, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of those that share the first k letters of each word."""
        if k == 0:
            return np.zeros(len(words), dtype=np.int64), np.full(len(words), len(self.words), dtype=np.int64)
        cut = lambda w: np.ascontiguousarray(_matrix(w)[:, :k]).view(f"S{k}").ravel()
        held, wanted = cut(self.words), cut(words)
        return np.searchsorted(held, wanted, "left"), np.searchsorted(held, wanted, "right")


class Plane:
    """Forward and reverse order of words of one length, and the wavelet tree of the points."""

    def __init__(self, words: np.ndarray):
        self.forward, self.reverse = Order(words), Order(_backwards(words))
        place = np.empty(len(words), dtype=np.int64)
        place[self.reverse.order] = np.arange(len(words))
        self.tree = WaveletTree(place[self.forward.order])

    def near(self, words: np.ndarray, low: int, high: int, inserted: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, indexed word, k): indexed words that come from a query word by replacing the letter at k, or by
        inserting one before it, with k from low to high. Chunks of queries."""
        a, own, back = words.dtype.itemsize, not inserted, _backwards(words)
        rest = a if inserted else a - 1  # letters that aren't edited: k before, rest - k after
        first = np.maximum(low, rest - self.reverse.longest(back, own))
        last = np.minimum(min(high, rest), self.forward.longest(words, own))
        q = np.flatnonzero(first <= last)
        times = (last - first + 1)[q]
        ends = np.cumsum(times)
        cut = 0
        while cut < len(q):
            to = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + CHUNK, "right")))
            some, many = q[cut:to], times[cut:to]
            qs = np.repeat(some, many)
            ks = np.arange(len(qs)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[some], many)
            yield self._reported(words, back, qs, ks, rest, own)
            cut = to

    def _reported(self, words, back, qs, ks, rest, own):
        box = np.zeros((4, len(qs)), dtype=np.int64)
        for k in np.unique(ks):
            at = np.flatnonzero(ks == k)
            box[0, at], box[1, at] = self.forward.interval(words[qs[at]], int(k))
            box[2, at], box[3, at] = self.reverse.interval(back[qs[at]], rest - int(k))
        some = np.flatnonzero((box[1] - box[0] > own) & (box[3] - box[2] > own))
        got, value = self.tree.report(*box[:, some])
        return qs[some][got], self.reverse.order[value], ks[some][got]


def near_pairs(shorter: np.ndarray, longer: np.ndarray, low: int, high: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """Near words with an edit position from low to high: (False, i, j) of replacements among the shorter, each pair in
    both directions; (True, i, j) of insertions, longer j from shorter i, each pair once."""
    if len(shorter) > 1:
        for i, j, _ in Plane(shorter).near(shorter, low, high, inserted=False):
            other = i != j
            yield False, i[other], j[other]
    if len(shorter) and len(longer):
        x, y = _matrix(shorter), _matrix(longer)
        for i, j, k in Plane(longer).near(shorter, low, high, inserted=True):
            first = (k == 0) | (y[j, k] != x[i, np.maximum(k - 1, 0)])
            yield True, i[first], j[first]


# --- words and their counts --------------------------------------------------------------------------

#: A-Z go to a-z, letters of Latin-1 stay, all other bytes end a word.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def planted(doc_id: int | None) -> Callable[[bytes], bytes]:
    """The misspellings that the contract of op11 writes into a document: some words lose a letter."""
    before = crc32(b"%s:" % str("" if doc_id is None else doc_id).encode())

    def change(word: bytes) -> bytes:
        h = crc32(word if word.isascii() else word.decode("latin-1").encode(), before)
        if h % 31:
            return word
        k = h % len(word)
        return word[:k] + word[k + 1 :]

    return change


def count_words(docs: DataFrame, least: int = LEAST, occurrences: int = 2, change: Callable | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of at least ``least`` letters and ``occurrences``; words as Latin-1 bytes. ``change(id)``
    may give a function that changes a document's words (never to longer ones)."""
    lean(docs.sparkSession)

    def flushed(held: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = Counter((text.as_py() or "").encode("latin-1", "replace").translate(_LETTERS).split())
                of = change(doc) if change else None
                for word, n in own.items():
                    if len(word) < least:
                        continue
                    w = of(word) if of else word
                    if len(w) >= least:
                        held[w] = held.get(w, 0) + n
                if len(held) >= HELD:
                    yield flushed(held)
                    held = {}
        if held:
            yield flushed(held)

    counted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


# --- blocks of words that may be near, dealt over tasks ------------------------------------------------


def _block() -> Column:
    """Where a filed word's block lies: the letters before its edit positions and those after them."""
    word, after = F.col("word"), F.greatest(F.lit(0), F.col("a") - 1 - F.col("hi"))
    return F.xxhash64("a", "lo", "hi", F.substring(word, F.lit(1), F.col("lo")), F.substring(word, F.length(word) - after + 1, after))


def _halved(filed: DataFrame) -> DataFrame:
    """Every filing twice, with the first and the second half of its edit positions."""
    mid = F.expr("(lo + hi) div 2").cast("int")
    halves = F.array(F.struct(F.col("lo"), mid.alias("hi")), F.struct((mid + 1).alias("lo"), F.col("hi")))
    return filed.select("word", "n", "a", F.explode(halves).alias("h")).select("word", "n", "a", "h.lo", "h.hi")


def file_words(words: DataFrame, least: int, block_rows: int) -> DataFrame:
    """(word, n, a, lo, hi, block): each word as the shorter (a letters) and as the longer (a + 1) of near pairs with edit
    positions lo to hi; near words have a common block."""
    length = F.length("word")
    both = F.filter(F.array(length, length - 1), lambda a: a >= least)
    filed = words.select("word", "n", F.explode(both).alias("a"))
    half = F.expr("a div 2").cast("int")
    halves = F.array(F.struct(F.lit(0).alias("lo"), (half - 1).alias("hi")), F.struct(half.alias("lo"), F.col("a").alias("hi")))
    filed = filed.select("word", "n", "a", F.explode(halves).alias("h")).select("word", "n", "a", "h.lo", "h.hi").withColumn("block", _block())
    while True:
        filed = settle(filed, "filed")
        # hot blocks are as many as the filed rows divided by block_rows at most
        hot = settle(filed.filter("lo < hi").groupBy("block").agg(F.count("*").alias("m")).filter(F.col("m") > block_rows).select("block"), "hot")
        if hot.isEmpty():
            return filed
        hot = F.broadcast(hot)
        cold = filed.join(hot, "block", "left_anti").unionByName(filed.filter("lo = hi").join(hot, "block", "left_semi"))
        filed = cold.unionByName(_halved(filed.filter("lo < hi").join(hot, "block", "left_semi")).withColumn("block", _block()))


_NEAR = "word binary, n_near long, near_n long, near binary"


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's blocks: for every word with near ones their number, and the one of the largest count."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows).combine_chunks()
    word, n = t["word"].to_pylist(), t["n"].to_numpy()
    a, lo, hi = (t[c].to_numpy() for c in ("a", "lo", "hi"))
    longer = np.fromiter(map(len, word), dtype=np.int64, count=len(word)) > a
    order = np.lexsort((longer, hi, lo, a))
    key = np.stack([a[order], lo[order], hi[order]])
    cuts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0), [True]])) if len(order) > 1 else np.array([0, len(order)])
    for x, y in zip(cuts, cuts[1:], strict=False):
        group = order[x:y]
        own = int(a[group[0]])
        is_long = longer[group]
        sets = [group[~is_long], group[is_long]]
        as_bytes = [np.array([word[i] for i in s], dtype=f"S{own + k}") for k, s in enumerate(sets)]
        source, target = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for inserted, i, j in near_pairs(*as_bytes, int(lo[group[0]]), int(hi[group[0]])):
            i, j = sets[0][i], sets[inserted][j]
            source += [i, j] if inserted else [i]
            target += [j, i] if inserted else [j]
        source, target = np.concatenate(source), np.concatenate(target)
        if not len(source):
            continue
        rank = np.empty(len(word), dtype=np.int64)
        rank[sorted(group, key=word.__getitem__)] = np.arange(len(group))
        by = np.lexsort((rank[target], -n[target], source))
        source, target = source[by], target[by]
        head = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]]))
        many = np.diff(np.append(head, len(source)))
        for at in range(0, len(head), 20_000):
            h = head[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([word[i] for i in source[h]], pa.binary()), pa.array(many[at : at + 20_000], pa.int64()),
                                              pa.array(n[target[h]], pa.int64()), pa.array([word[i] for i in target[h]], pa.binary())], names=["word", "n_near", "near_n", "near"])


def near_words(words: DataFrame, least: int = LEAST) -> DataFrame:
    """(word, n_near, near_n, near) of every word that has near ones: their number, and the one of the largest count (of
    several the first in code-point order). ``words`` is read twice: settle it."""
    conf = words.sparkSession.conf
    rows = 4 * words.count()
    parts = max(int(conf.get("spark.sql.shuffle.partitions")), rows // TASK_ROWS + 1)
    filed = file_words(words, least, min(BLOCK_MOST, max(BLOCK_LEAST, rows // (2 * parts))))
    dealt = filed.withColumn("_p", F.pmod("block", F.lit(parts)).cast("int")).repartitionById(parts, F.col("_p")).drop("_p", "block")
    found = dealt.mapInArrow(tidy(_searched), _NEAR)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("near_n"), "b.near")


def follow(forms: DataFrame) -> DataFrame:
    """(word, root): from each word along (word, form) to the last, by doubling."""
    root = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = root.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if root.join(ahead, "root", "left_semi").isEmpty():
            return root
        root = settle(root.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")


def group_variants(words: DataFrame, least: int = LEAST, times: int = TIMES_MORE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for (word, n): a word's form is its near word of the largest count, if that
    is at least ``times`` the word's own; words as text."""
    words = settle(words, "words")
    near = near_words(words, least)
    more = F.col("near_n") >= times * F.col("n")
    met = settle(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(more, F.col("near")).alias("form"), F.when(more, F.col("near_n")).alias("form_n")), "near")
    text = lambda c: F.decode(c, "ISO-8859-1")
    out = met.join(follow(met.filter(F.col("form").isNotNull())), "word", "left")
    return out.select(text("word").alias("word"), text("form").alias("form"), text(F.coalesce("root", "word")).alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The contract of op11."""
    return group_variants(count_words(docs, change=planted))
