"""Chat formatting by quotation linking.

Lines that begin with ``>`` marks are quotes; the marks give their level. Consecutive lines of one level are a passage (an
empty line ends it); case, white space and line ends are normal, so a rewrapped quote is the same passage. A passage of
level n comes from the latest earlier message of the conversation that holds it, as a run of words, in a passage of level
n - 1: level 1 quotes own words, a deeper level what an earlier message had quoted. Level 1 is resolved first: a message
replies to the one that most passages of its lowest level found come from (ties: the latest); where none is found, to the
message of the turn before. So replies are a forest, and messages come out in its order: each after the one that it
replies to, answers by turn, an answer's own answers before the next one.

Passages are looked up by the hash of their first words (a power of two, ANCHOR at most) and then compared as text.

Scale: texts are parsed once, where they are read, and written as passages; these move with their hashes. What one conversation brings to one task are
the messages that quote another than the one before them (their numbers), and what one passage of one conversation brings
are the turns that hold or quote it; both are sorted streams or pairs of numbers, never texts.

Defined cases: null text has no lines, an empty one an empty line; null conv_id or turn rows link to nothing and have no
position; of several messages of a turn the first (as read) stands for it, each is placed by itself, and none replies to its
own turn; of equal passages the latest earlier message is quoted; very long texts are parsed line by line, whole; other
columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sampling import numbered
from .common import settle

#: Words of the longest run that is hashed; messages that look up their run in one task.
ANCHOR, BUCKET = 16, 10_000
_MARKS = re.compile(r"((?:\s*>)*)", re.ASCII)
_PASSAGES = pa.list_(pa.struct([("level", pa.int64()), ("words", pa.string())]))


def parse(text: str | None) -> tuple[int, int, str, list[tuple[int, str]]]:
    """max_level, n_quoted, own lines, passages as (level, normal words)."""
    own, passages, words, last, most, quoted = [], [], [], -1, 0, 0
    for line in re.split(r"\r?\n", text or ""):
        marks = _MARKS.match(line)[0]
        level = marks.count(">")
        most, quoted = max(most, level), quoted + (level > 0)
        if not level:
            own.append(line)
        said = line[len(marks) :].lower().split() if level else line.lower().split()
        if words and (level != last or not said):
            passages.append((last, " ".join(words)))
            words = []
        words += said
        last = level
    if words:
        passages.append((last, " ".join(words)))
    return most, quoted, "\n".join(own).strip(" "), passages


def run_order(heads: list[tuple[int, int, int | None]]) -> list[tuple[int, int, int, int]]:
    """(first, end, message replied to) of one conversation's runs to (first, end, position, depth) in reply order.

    A run is a stretch of messages each of which replies to the one before it, so it stays together. After its last message
    come the runs that reply to that one, by number, then those that reply to the message before, and so on.
    """
    heads = sorted(heads)
    firsts = [h[0] for h in heads]
    below: list[list[tuple[int, int, int]]] = [[] for _ in heads]
    roots = []
    for i, (first, _, to) in enumerate(heads):
        if to is None:
            roots.append(i)
        else:
            below[bisect_right(firsts, to) - 1].append((-to, first, i))
    out, at, stack = [], 0, [(i, 0) for i in reversed(roots)]
    while stack:
        i, depth = stack.pop()
        first, end, _ = heads[i]
        out.append((first, end, at, depth))
        at += end - first
        stack += [(k, depth - low - first + 1) for low, _, k in sorted(below[i], reverse=True)]
    return out


def _parse_batches(batches):
    for b in batches:
        got = [parse(t) for t in b.column("text").to_pylist()]
        cols = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
        cols.append(pa.array([[{"level": n, "words": w} for n, w in g[3]] for g in got], _PASSAGES))
        keep = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), *cols], names=[*keep, "max_level", "n_quoted", "content", "passages"])


def _order_batches(batches):
    for b in batches:
        got = [x for rows in b.column("heads").to_pylist() for x in run_order([(r["first"], r["end"], r["to"]) for r in rows])]
        yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in range(4)], names=["first", "end", "position", "depth"])


def _anchor(words: Column) -> Column:
    """Number of words of a passage's anchor."""
    n, size = F.size(F.split(words, " ")), F.lit(1)
    for k in (2**i for i in range(1, ANCHOR.bit_length())):
        size = F.when(n >= k, k).otherwise(size)
    return size


def _hash(words: Column, start, size) -> Column:
    return F.xxhash64(F.array_join(F.slice(words, start, size), " "))


def _runs(words: Column, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - size + 1))
    return F.transform(starts, lambda i: F.struct(F.lit(size).alias("size"), _hash(words, i, size).alias("h")))


def _linked(parsed: DataFrame) -> DataFrame | None:
    """_m and the turn that it quotes; None where nothing is quoted."""
    said = parsed.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("_m", "conv_id", "turn", F.explode("passages").alias("x")).select("_m", "conv_id", "turn", "x.*")
    asked = said.filter("level > 0")
    keyed = asked.select("conv_id", "level", "words", _anchor(F.col("words")).alias("size")).distinct()
    sizes = sorted(r[0] for r in keyed.select("size").distinct().collect())
    if not sizes:
        return None
    split = F.split("words", " ")
    # the split words are bound by an outer lambda: inside the inner one they would be split again for every run
    held = F.transform(F.array(split), lambda w: F.array_distinct(F.concat(*[_runs(w, k) for k in sizes])))[0]
    source = said.join(asked.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", F.col("turn").alias("source"), (F.col("level") + 1).alias("level"), F.col("words").alias("text"), F.explode(held).alias("r"))
    source = source.select("conv_id", "source", "level", "text", "r.*")
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    keyed = keyed.withColumn("h", _hash(split, F.lit(1), F.col("size")))
    found = keyed.join(source, ["conv_id", "level", "size", "h"]).filter(F.contains(pad(F.col("text")), pad(F.col("words")))).select("conv_id", "level", "words", "source").distinct()
    both = asked.select("conv_id", "level", "words", "turn", "_m", F.lit(None).cast("long").alias("source")).unionByName(
        found.select("conv_id", "level", "words", F.col("source").alias("turn"), F.lit(None).cast("long").alias("_m"), F.col("source").cast("long").alias("source")))
    earlier = Window.partitionBy("conv_id", "level", "words").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    hit = both.withColumn("source", F.max("source").over(earlier)).filter("_m IS NOT NULL AND source IS NOT NULL")
    votes = hit.groupBy("_m", "level", "source").agg(F.count("*").alias("n"))
    return votes.groupBy("_m").agg(F.max(F.struct((-F.col("level")).alias("up"), "n", "source"))["source"].alias("quoted"))


def _placed(at: DataFrame) -> DataFrame:
    """(_m, conv_id, turn, quoted) to (_m, reply_to, position, depth).

    Messages are numbered over all conversations by a range sort. Messages that reply to the one before them make runs; only
    the heads of runs, the messages that quote another one, meet by conversation. Messages then find their run in buckets of
    BUCKET numbers, so a conversation with a third of all rows meets in no task.
    """
    rows = settle(numbered(at, F.asc("conv_id"), F.asc("turn"), F.asc("_m")), "ranked")
    turns = rows.groupBy("conv_id", "turn").agg(F.min("_pos").alias("first"))
    before = rows.select((F.col("_pos") + 1).alias("first"), F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"))
    turns = settle(turns.join(before, "first", "left").select("conv_id", "turn", "first", F.when(F.col("conv_id") == F.col("_conv"), F.col("_turn")).alias("prev")), "turns")
    told = rows.join(turns.select("conv_id", "turn", "prev"), ["conv_id", "turn"]).withColumn("reply_to", F.coalesce("quoted", "prev"))
    parents = turns.select("conv_id", F.col("turn").alias("reply_to"), F.col("first").alias("to"))
    told = settle(told.join(parents, ["conv_id", "reply_to"], "left").select("_m", "conv_id", "_pos", "reply_to", "to"), "replies")
    heads = told.filter(F.col("to").isNull() | (F.col("to") != F.col("_pos") - 1))
    ends = rows.groupBy("conv_id").agg((F.max("_pos") + 1).alias("last"))
    grouped = heads.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("_pos").alias("first"), "to"))).alias("h")).join(ends, "conv_id")
    end = lambda x, i: F.coalesce(F.get(F.col("h"), i + 1)["first"], F.col("last"))
    grouped = grouped.select(F.transform("h", lambda x, i: F.struct(x["first"].alias("first"), end(x, i).alias("end"), x["to"].alias("to"))).alias("heads"))
    runs = grouped.mapInArrow(_order_batches, "first long, end long, position long, depth long")
    bucket = lambda c: F.floor(c / BUCKET)
    runs = runs.withColumn("bucket", F.explode(F.sequence(bucket(F.col("first")), bucket(F.col("end") - 1))))

    def place(messages: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("first")
        first, pos = found["first"].to_numpy(), messages["_pos"].to_numpy()
        k = np.searchsorted(first, pos, side="right") - 1
        gone = pos - first[k]
        return pa.table({"_m": messages["_m"], "reply_to": messages["reply_to"], "position": pa.array(found["position"].to_numpy()[k] + gone), "depth": pa.array(found["depth"].to_numpy()[k] + gone)})

    met = told.select("_m", "_pos", "reply_to", bucket(F.col("_pos")).alias("bucket"))
    return met.groupBy("bucket").cogroup(runs.groupBy("bucket")).applyInArrow(place, "_m long, reply_to long, position long, depth long")


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_to, max_level, n_quoted, content, position, depth; conversations in reply order."""
    m = messages.select("conv_id", "turn", "role", "text").withColumn("_m", F.monotonically_increasing_id())
    kind = m.drop("text").schema.simpleString()[7:-1] + ",max_level:bigint,n_quoted:bigint,content:string,passages:array<struct<level:bigint,words:string>>"
    # numbered and parsed once: a second evaluation may deal rows otherwise, and all later steps read columns
    parsed = settle(m.mapInArrow(_parse_batches, f"struct<{kind}>"), "parsed")
    quoted = _linked(parsed)
    at = parsed.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("_m", "conv_id", F.col("turn").cast("long").alias("turn"))
    at = at.withColumn("quoted", F.lit(None).cast("long")) if quoted is None else at.join(quoted, "_m", "left")
    out = parsed.drop("passages").join(_placed(at), "_m", "left")
    return out.orderBy("conv_id", "position", "turn", "_m").select("conv_id", "turn", "role", "reply_to", "max_level", "n_quoted", "content", "position", "depth")
