"""Mixing sources to target weights; DataFrame functions only.

Tokens are summed per source, the targets follow by water filling, and every document is emitted floor(rate) times
plus one hash-seeded Bernoulli copy whose probability is the fraction of rate = target / source size. Of ``SEEDS`` seeds
each source uses the one whose draws bring its taken words nearest to its target (ties: smaller seed), which costs one
more aggregation of (source, id, size) and makes small or long-tailed sources land near their targets.

Scale: texts are read twice and never shuffled; only sums per source move, folded before the shuffle, so a source with
a third of all rows is no hot key. Sources are ranked by a range sort plus per-partition offsets, not in one task.

Defined cases: null text has size 0; a null source is a source of its own, last in order; a source whose words sum to
zero has rate 0 and takes nothing; equal ids share their draw; an empty table gives an empty result; other columns are kept
whatever their names, but for those that ``mix`` returns itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, settle, small

WEIGHTS = (3, 1, 2)
SHARE, CAP, SEEDS = 1.5, 2, 10
_BITS, _HEX = 48, 12


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """12 lower-case hex digits, uniform; five seeds share one digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed // 5}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return F.substring(digest, 1 + _HEX * (seed % 5), _HEX)


def source_targets(sizes: DataFrame, source_col: str, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) with targets filled up to cap times the source's size.

    The fill level is found by iterating two sums on the driver; each round is one small aggregate and caps at least
    one more source, and a few rounds end it.
    """
    per = settle(sizes.groupBy(source_col).agg(F.sum("size").alias("source_size"))
                 .orderBy(F.col(source_col).asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()), "sources")
    part, off = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    per = per.withColumns({"_part": part, "_off": off})
    before = (per.groupBy("_part").agg(F.count("*").alias("_n"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    rank = F.col("_before") + F.col("_off")
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    per = settle(per.join(F.broadcast(before.select("_part", "_before")), "_part")  # one row per partition of the range sort
                 .select(F.col(source_col), "source_size", weight.alias("_w"), (F.col("source_size") * F.lit(float(cap))).alias("_cap")), "weights")
    whole = per.agg(F.sum("source_size").alias("s"), F.sum("_w").alias("w"), F.sum("_cap").alias("c")).first()
    total = share * float(whole["s"] or 0)
    rest, w, capped = total, whole["w"] or 1.0, -1
    while True:
        above = F.col("_w") * F.lit(rest) >= F.col("_cap") * F.lit(w)
        got = per.filter(above).agg(F.count("*").alias("n"), F.sum("_w").alias("w"), F.sum("_cap").alias("c")).first()
        new_rest, new_w = total - float(got["c"] or 0), (whole["w"] or 1.0) - float(got["w"] or 0)
        if got["n"] == capped or new_w <= 0:
            break
        rest, w, capped = new_rest, new_w, got["n"]
    target = F.when(above, F.col("_cap")).otherwise(F.col("_w") * F.lit(rest) / F.lit(w))
    return per.select(source_col, "source_size", target.alias("target"))


def mixing_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seeds: int = SEEDS,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per source: source, source_size, target, _floor copies, _limit (hex threshold of the extra copy), _seed."""
    sizes = settle(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size")), "sizes")
    per = source_targets(sizes, "source", tuple(weights), share, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    limit = F.lower(F.lpad(F.hex(F.floor((rate - F.floor(rate)) * float(1 << _BITS)).cast("long")), _HEX, "0"))
    per = settle(per.withColumns({"_floor": F.floor(rate), "_limit": limit}), "rates")
    met = sizes.join(small(per.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")))
    extra = [F.sum(F.when(draw(F.col("_id"), k) < F.col("_limit"), F.col("size")).otherwise(0)).alias(f"x{k}") for k in range(seeds)]
    sums = met.groupBy("_s").agg(*extra)
    both = per.join(sums, per["source"].eqNullSafe(sums["_s"]))
    miss = [F.struct(F.abs(F.col("source_size") * F.col("_floor") + F.col(f"x{k}") - F.col("target")).alias("m"), F.lit(k).alias("k")) for k in range(seeds)]
    return settle(both.select("source", "source_size", "target", "_floor", "_limit", F.array_min(F.array(*miss))["k"].alias("_seed")), "plan")


def _mixed(docs: DataFrame, seeds: int = SEEDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> tuple[DataFrame, str]:
    """docs with one more column, and its name: a struct of size (of the source), target and copies."""
    plan = mixing_plan(docs, seeds=seeds, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    name, key = fresh("mix", docs.columns), fresh("mix_source", docs.columns)
    plan = plan.select(F.col("source").alias(key), F.struct("source_size", "target", "_floor", "_limit", "_seed").alias(name))
    met = docs.join(small(plan), docs[source_col].eqNullSafe(plan[key]), "left").drop(key)
    of = F.col(name)
    drawn = F.element_at(F.array(*[draw(F.col(id_col), k) for k in range(seeds)]), of["_seed"] + 1)
    copies = (of["_floor"] + F.when(drawn < of["_limit"], 1).otherwise(0)).cast("long")
    return met.withColumn(name, F.struct(of["source_size"].alias("size"), of["target"].alias("target"), copies.alias("copies"))), name


def mix(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The input's columns with size, source_size, target, copies and taken (which replace columns of those names)."""
    met, name = _mixed(docs, text_col=text_col, **how)
    kept = [F.col(c) for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    of, size = F.col(name), size_of(F.col(text_col))
    return met.select(*kept, size.alias("size"), of["size"].alias("source_size"), of["target"].alias("target"), of["copies"].alias("copies"), (size * of["copies"]).alias("taken"))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mixture itself: the input's columns, each row emitted ``copies`` times."""
    met, name = _mixed(docs, **how)
    again = fresh("mix_copy", docs.columns)
    return met.filter(F.col(name)["copies"] > 0).select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col(name)["copies"].cast("int"))).alias(again)).drop(again)
