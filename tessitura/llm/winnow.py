"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts are lower-cased (A-Z) and cut into words of digits, letters and characters beyond ASCII. Every window of ``width``
words of a benchmark item (a shorter item: all its words) is fingerprinted by the smallest hash of the k-grams in it. A
document's sliding windows keep their smallest k-gram hash in the same way, so a shared stretch of ``width`` words has
the same fingerprint on both sides, whatever stands around it: none can be missed. Fingerprints meet in two steps: a bit
map of the benchmark's fingerprints (a scalar subquery of bounded size) is looked up for every window while the words are
at hand, then what it lets through is joined and extended over the whole window, word by word, so no collision counts.
Hit windows are merged to spans.

Items shorter than ``width`` narrow the winnow: with a shortest item of m >= GRAM words a window keeps the smallest of its
first m - GRAM + 1 grams; items below GRAM words have a winnow of their own length. At most ``width`` lengths exist.

Scale: documents are read once, in one narrow stage; words never leave it. What moves are candidate windows: true ones and
a share of at most (fingerprints / bits) others, 1 / 1024 up to 65,000 fingerprints; the map stops at ``BITS`` bits (8 MB),
beyond that the share grows and the result stays. Windows of the benchmark are broadcast after a count, else joined with
hot windows split off (``skew_join``). Hits are gathered per document, which bounds them by its own length.

Defined cases: a null text has no words; texts and items without words have no hits; repeated document ids are separate
rows; equal item ids count as one item, an item without id hits but isn't listed; other columns are kept if asked for,
whatever their names; empty tables give no rows or no hits.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, row_key, settle, skew_join, small

GRAM, BITS = 5, 1 << 26
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPAN = "array<struct<start:int,end:int>>"


def _bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x with x evaluated once, however often f names it and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def words(text: Column) -> Column:
    """Lower-cased words; a text of one byte a character is ASCII, where ``lower`` changes nothing but A-Z."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), GAP), "")


def _upto(last: Column) -> Column:
    """The numbers from 0 to last; none if last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: Column, k: int) -> Column:
    """The hash of k words from every place on."""
    return F.transform(_upto(F.size(hashes) - k), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))


def _smallest(grams: Column, w: int) -> Column:
    """The smallest of w grams from every place on: what the winnow keeps of each window."""
    if w == 1:
        return grams
    return F.transform(_upto(F.size(grams) - w), lambda i: F.least(*[F.get(grams, i + j) for j in range(w)]))


def winnow(tokens: Column, k: int, w: int) -> Column:
    """Fingerprints of all windows of k + w - 1 words, by place."""
    return _bound(F.transform(tokens, lambda t: F.xxhash64(t)), lambda h: _bound(_grams(h, k), lambda g: _smallest(g, w)))


def _schemes(lengths: list[int]) -> list[tuple[int, int, list[int]]]:
    """(gram, winnow, window lengths) for the lengths at hand."""
    long = [m for m in lengths if m >= GRAM]
    return [(m, 1, [m]) for m in lengths if m < GRAM] + ([(GRAM, min(long) - GRAM + 1, long)] if long else [])


def item_windows(items: DataFrame, width: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, m, items): every distinct window with its number of words and the sorted distinct ids of its items."""
    w = items.select(F.col(id_col).cast("string").alias("id"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    m = F.least(F.size("w"), F.lit(width))
    at = w.select("id", m.alias("m"), F.explode(F.transform(_upto(F.size("w") - m), lambda s: F.array_join(F.slice("w", s + 1, m), " "))).alias("window"))
    return at.groupBy("window").agg(F.min("m").alias("m"), F.sort_array(F.collect_set("id")).alias("items"))


def _bit_map(prints: DataFrame, n: int) -> tuple[Column, int]:
    """The fingerprints as bits of one array of longs, and the number of bits; a scalar subquery of bounded size."""
    bits = 1 << min(BITS.bit_length() - 1, max(12, (1024 * n).bit_length()))
    slot = F.col("fp").bitwiseAND(F.lit(bits - 1))
    marks = prints.groupBy(F.shiftright(slot, 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(fp & 63 as int))")).alias("mark"))
    dense = prints.sparkSession.range(bits // 64).join(marks, "id", "left").select(F.struct("id", F.coalesce("mark", F.lit(0).cast("long")).alias("mark")).alias("x"))
    return dense.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["mark"]).alias("map")).scalar(), bits


def _candidates(w: Column, schemes: list[tuple[int, int, list[int]]], bit_map: Column, bits: int) -> Column:
    """(start, window) for every window whose fingerprint the map holds."""
    held = lambda fp: F.getbit(F.get(bit_map, F.shiftright(fp.bitwiseAND(F.lit(bits - 1)), 6).cast("int")), fp.bitwiseAND(F.lit(63))) == 1
    def of_length(places: Column, m: int) -> Column:
        fits = F.filter(places, lambda s: s + m <= F.size(w))
        return F.transform(fits, lambda s: F.struct(s.alias("start"), F.array_join(F.slice(w, s + 1, m), " ").alias("window")))

    out = []
    for k, reach, lengths in schemes:
        places = _bound(winnow(w, k, reach), lambda fps: F.filter(_upto(F.size(fps) - 1), lambda s: held(F.get(fps, s))))
        out += [of_length(places, m) for m in lengths]
    return F.concat(*out)


def _merged(spans: Column) -> Column:
    """Sorted spans with those that touch or overlap put together."""
    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(F.size(done) == 0, F.array(x)).when(x["start"] <= last["end"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, F.array().cast(_SPAN), step)


def find_leaks(docs: DataFrame, items: DataFrame, keep: list[str], width: int = 10, text_col: str = "text", names: tuple[str, str, str] = ("n_words", "spans", "items")) -> DataFrame:
    """The columns ``keep`` of every row, its number of words, the spans of words (start, end) that lie in windows of the
    benchmark, and the sorted ids of the items whose windows occur."""
    n_words, spans, item_ids = names
    windows = settle(item_windows(items, width), "windows")
    lengths = sorted(r["m"] for r in windows.select("m").distinct().collect())  # at most ``width`` numbers
    row, w, found, bit_map = (fresh(c, [*keep, *names]) for c in ("_row", "_w", "_found", "_map"))
    parsed = row_key(docs, row).select(row, *keep, words(F.col(text_col)).alias(w))
    made = lambda w, cand: F.struct(F.size(w).cast("long").alias("n"), cand.alias("windows"))
    if lengths:
        schemes = _schemes(lengths)
        of_length = {m: (k, reach) for k, reach, ms in schemes for m in ms}
        fp = F.coalesce(*[F.when(F.col("m") == m, F.get(winnow(F.split("window", " "), k, reach), F.lit(0))) for m, (k, reach) in of_length.items()])
        prints = settle(windows.select(fp.alias("fp")).distinct(), "prints")
        held, bits = _bit_map(prints, prints.count())
        # subqueries may not be written inside functions of lambdas: as a column that is named once the optimizer moves
        # it there all the same, so neither the map nor the words are ever copied into rows
        parsed = parsed.select("*", held.alias(bit_map))
        found_in = _bound(F.col(bit_map), lambda b: _bound(F.col(w), lambda w: made(w, _candidates(w, schemes, b, bits))))
    else:
        found_in = made(F.col(w), F.array().cast("array<struct<start:int,window:string>>"))
    base = settle(parsed.select(row, *keep, found_in.alias(found)), "candidates").select(row, *keep, F.col(f"{found}.n").alias(n_words), F.col(f"{found}.windows").alias(found))
    cand = base.select(row, F.explode(found).alias("c")).select(row, "c.start", "c.window")
    few = small(windows)
    hits = cand.join(few, "window") if few is not windows else skew_join(settle(cand, "cand"), windows, "window", "inner")
    span = F.struct("start", (F.col("start") + F.col("m")).alias("end"))
    own = hits.groupBy(row).agg(_merged(F.sort_array(F.collect_list(span))).alias(spans), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias(item_ids))
    return (base.select(row, *keep, n_words).join(small(settle(own, "own")), row, "left")
            .select(*keep, n_words, F.coalesce(spans, F.array().cast(_SPAN)).alias(spans), F.coalesce(item_ids, F.array().cast("array<string>")).alias(item_ids)))


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def drop_leaks(docs: DataFrame, items: DataFrame, width: int = 10, text_col: str = "text") -> DataFrame:
    """The rows of docs without a window of the benchmark: all columns."""
    names = tuple(fresh(c, docs.columns) for c in ("_n_words", "_spans", "_items"))
    return find_leaks(docs, items, docs.columns, width, text_col, names).filter(F.size(names[1]) == 0).select(*docs.columns)


def decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract of op13."""
    d = find_leaks(docs, items, ["doc_id"]).withColumn("n_hit", hit_words(F.col("spans")))
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
