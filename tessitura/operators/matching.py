"""Exact matching: containment of sequences, band joins, content dedupe, priority unions, registry merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import settle
from .bits import bit_map, bound, held


def contains_run(hay: Column, needle: Column) -> Column:
    """Whether the array needle occurs contiguously in hay; an empty needle doesn't."""
    n = F.size(needle)
    starts = F.sequence(F.lit(1), F.size(hay) - n + 1)
    return (n > 0) & (n <= F.size(hay)) & F.coalesce(F.exists(F.when((n > 0) & (n <= F.size(hay)), starts), lambda i: F.slice(hay, i, n) == needle), F.lit(False))


def _grams(seq: Column, k: int) -> Column:
    """Distinct hashes of the runs of k elements; none of a shorter sequence."""
    starts = lambda h: F.when(F.size(h) >= k, F.sequence(F.lit(0), F.size(h) - k)).otherwise(F.array().cast("array<int>"))
    whole = lambda h: F.transform(starts(h), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
    return F.array_distinct(bound(F.transform(seq, lambda x: F.xxhash64(x)), whole))


def contained(needles: DataFrame, hays: DataFrame, gram: int = 8) -> DataFrame:
    """JN-02: (needle_id, hay_id) with needle contiguously inside hay. needles: needle_id, needle; hays: hay_id, hay.

    Each needle is looked up by its rarest gram (document frequency over the hays that hold any needle's gram), so a
    frequent run makes no bucket of candidates. A bit map of the needles' grams is looked up inside each hay's array, so
    other grams never become rows. Only ids and grams move until the candidates are known; sequences then join them once,
    and survivors are verified. Needles shorter than ``gram`` use their own length. Ids must be distinct.
    """
    short = needles.filter(F.size("needle").between(1, gram - 1))

    def candidates(ask: DataFrame, k: int) -> DataFrame:
        own = settle(ask.select("needle_id", F.explode(_grams(F.col("needle"), k)).alias("g")), "grams")
        wanted = settle(own.select("g").distinct(), "wanted")
        bits, n = bit_map(wanted, "g", wanted.count())
        found = bound(F.col("_map"), lambda b: F.filter(_grams(F.col("hay"), k), lambda g: held(b, n, g)))
        hits = hays.select("hay_id", "hay", bits.alias("_map")).select("hay_id", found.alias("gs")).select("hay_id", F.explode("gs").alias("g"))
        hits = settle(hits.join(wanted, "g", "left_semi"), "hits")
        rarest = own.join(hits.groupBy("g").agg(F.count("*").alias("df")), "g").groupBy("needle_id").agg(F.min(F.struct("df", "g"))["g"].alias("g"))
        return rarest.join(hits, "g").select("needle_id", "hay_id")

    met = candidates(needles.filter(F.size("needle") >= gram), gram)
    for k in [r[0] for r in short.select(F.size("needle")).distinct().collect()]:  # at most gram - 1 lengths
        met = met.union(candidates(short.filter(F.size("needle") == k), k))
    met = settle(met.distinct(), "met")
    both = met.join(needles.select("needle_id", "needle"), "needle_id").join(hays.select("hay_id", "hay"), "hay_id")
    return both.filter(contains_run(F.col("hay"), F.col("needle"))).select("needle_id", "hay_id")


def first_match(matches: DataFrame, position: DataFrame) -> DataFrame:
    """The match that comes first in registry order. position: hay_id, pos."""
    return matches.join(position, "hay_id").groupBy("needle_id").agg(F.min_by("hay_id", "pos").alias("hay_id"))


def band_join(left: DataFrame, right: DataFrame, key: str, value: str, width: float) -> DataFrame:
    """JN-03: equal keys and |difference| <= width, left rows kept; the band is a residual of the hash join."""
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    return left.join(r, (F.col(key) == F.col(f"r_{key}")) & (F.abs(F.col(value) - F.col(f"r_{value}")) <= width), "left")


def first_per_content(df: DataFrame, content: str, order: str) -> DataFrame:
    """AGG-29: first row of each content in order is kept, others name it. Folded by min(), so no key meets in a window."""
    first = df.groupBy(content).agg(F.min(order).alias("_first"))
    out = df.join(first, content)
    return out.withColumns({"kept": F.col(order) == F.col("_first"), "duplicate_of": F.when(F.col(order) != F.col("_first"), F.col("_first"))}).drop("_first")


def duplicate_report(files: DataFrame, known: DataFrame, now: DataFrame, key: str, content: str) -> DataFrame:
    """SNK-07 as a report, for nothing is deleted here: files whose content is among the known ones or repeats an earlier
    file, why, what they repeat, and whether their content is still what it was (now: key and content), without which
    nobody may delete them. Files are taken in order of their key; the first of unknown content is no duplicate."""
    used = files.join(known.select(content).distinct(), content, "left_semi").select(key, content, F.lit("already_used_or_original_exact_duplicate").alias("reason"), F.lit(None).cast(files.schema[key].dataType).alias("duplicate_of"))
    fresh = first_per_content(files.join(known.select(content).distinct(), content, "left_anti").select(key, content), content, key)
    internal = fresh.filter(~F.col("kept")).select(key, content, F.lit("internal_exact_duplicate").alias("reason"), "duplicate_of")
    met = used.unionByName(internal).join(now.select(key, F.col(content).alias("_now")), key, "left")
    return met.withColumn("still_equal", F.col(content).eqNullSafe(F.col("_now"))).drop("_now")


def by_priority(key: str, *sources: DataFrame) -> DataFrame:
    """JN-07: union of sources where an earlier source's key hides later ones."""
    seen, out = sources[0].select(key), sources[0].withColumn("priority", F.lit(1).cast("long"))
    for i, s in enumerate(sources[1:], start=2):
        fresh = s.join(seen, key, "left_anti")
        out = out.unionByName(fresh.withColumn("priority", F.lit(i).cast("long")), allowMissingColumns=True)
        seen = seen.union(fresh.select(key))
    return out


def merge_registry(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """JN-17: upsert by key: new values win, rows only in old stay."""
    o, n = old.alias("o"), new.alias("n")
    out = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    picked = [F.coalesce(F.col(f"n.{f}"), F.col(f"o.{f}")).alias(f) for f in fields]
    state = F.when(F.col(f"o.{key}").isNull(), "inserted").when(F.col(f"n.{key}").isNull(), "retained").otherwise("updated")
    return out.select(F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key), *picked, state.alias("state"))


def first_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """WIN-10: first row of each key in an explicit order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def same_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """SET-05: whether two id sets are equal; one flag per id and side is folded, no set is collected."""
    both = a.select(key, F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select(key, F.lit(0), F.lit(1)))
    return both.groupBy(key).agg((F.max("x") == F.max("y")).alias("ok")).agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("equal"))


def same_sequence(a: DataFrame, b: DataFrame, position: str, value: str) -> DataFrame:
    """SET-06: whether two columns hold the same values at the same positions."""
    met = a.select(position, F.col(value).alias("_a"), F.lit(True).alias("_x")).join(b.select(position, F.col(value).alias("_b"), F.lit(True).alias("_y")), position, "full_outer")
    ok = F.col("_a").eqNullSafe(F.col("_b")) & F.col("_x").eqNullSafe(F.col("_y"))
    return met.agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("in_sync"))
