"""Temporal consistency of matched segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bits import bound


def chains(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """WIN-06: longest non-decreasing run and share of non-decreasing steps per key (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(at)
    broken = F.when(F.col(value) >= F.lag(value).over(w), 0).otherwise(1)
    d = df.withColumn("_b", broken).withColumn("_island", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = d.groupBy(key, "_island").agg(F.count("*").alias("_n"))
    return c.groupBy(key).agg(F.max("_n").alias("longest"), F.round((F.sum("_n") - F.count("*")) / F.greatest(F.lit(1), F.sum("_n") - 1), 6).alias("ordered_fraction"))


def _deltas(xs: Column) -> Column:
    return F.zip_with(F.slice(xs, 2, F.greatest(F.lit(0), F.size(xs) - 1)), F.slice(xs, 1, F.greatest(F.lit(0), F.size(xs) - 1)), lambda b, a: b - a)


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def _mean(xs: Column) -> Column:
    return bound(xs, lambda xs: _sum(xs) / F.size(xs))


def std0(xs: Column) -> Column:
    squares = lambda xs, m: _sum(F.transform(xs, lambda x: (x - m) * (x - m)))
    return bound(xs, lambda xs: bound(_sum(xs) / F.size(xs), lambda m: F.sqrt(squares(xs, m) / F.size(xs))))


def longest_run(xs: Column) -> Column:
    """Longest non-decreasing run of an array."""
    zero = F.struct(F.lit(0).alias("best"), F.lit(0).alias("run"), F.lit(float("-inf")).alias("last"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(x >= s["last"], s["run"] + 1).otherwise(1)
        return F.struct(F.greatest(s["best"], run).alias("best"), run.alias("run"), x.alias("last"))

    return F.aggregate(xs, zero, step)["best"]


def _mode_count(xs: Column) -> Column:
    """How often the commonest element occurs; null for an empty array."""
    return F.array_max(F.transform(F.array_distinct(xs), lambda v: F.size(F.filter(xs, lambda x: x == v))))


def features(segments: Column) -> Column:
    """Temporal part of the pair vector from array<struct<q, r, shift>>, sorted here by q, as one struct. Without segments
    the longest chain still counts one window, so coverage is 1 and all else 0."""
    # a field of an array of structs is the array of that field
    parts = lambda seg: bound(F.struct(seg["q"].alias("q"), seg["r"].alias("r"), seg["shift"].alias("shift"), _deltas(seg["q"]).alias("dq"), _deltas(seg["r"]).alias("dr")), _features)
    return bound(F.array_sort(segments), parts)


def _features(s: Column) -> Column:
    n = F.size(s["r"])
    ordered = F.size(F.filter(s["dr"], lambda x: x >= 0)) / F.greatest(F.lit(1), n - 1)
    logs = F.transform(_advancing(s["dq"], s["dr"]), lambda z: F.log(z["r"] / z["q"]))
    tempo = bound(logs, lambda logs: F.when(F.size(logs) > 1, F.exp(-std0(logs))).when(F.size(logs) == 1, 1.0).otherwise(0.0))
    reach = F.greatest(F.lit(10.0), F.coalesce(F.array_max(s["q"]), F.lit(0.0)) + 10)
    told = lambda run: F.struct(F.coalesce(ordered, F.lit(0.0)).alias("ordered"), (F.coalesce(_mode_count(s["shift"]), F.lit(0)) / F.greatest(F.lit(1), n)).alias("shift_consistency"), tempo.alias("tempo_consistency"),
                                run.cast("long").alias("longest"), F.least(F.lit(1.0), 10.0 * run / reach).alias("coverage"), (n / 3.0).alias("segments"))
    return bound(F.greatest(F.lit(1), longest_run(s["r"])), told)


def _advancing(dq: Column, dr: Column) -> Column:
    """The steps that advance on both sides."""
    return F.filter(F.arrays_zip(dq.alias("q"), dr.alias("r")), lambda z: (z["q"] > 0) & (z["r"] > 0))


def _median(xs: Column) -> Column:
    middle = lambda z: (F.get(z, F.floor((F.size(z) - 1) / 2).cast("int")) + F.get(z, F.floor(F.size(z) / 2).cast("int"))) / 2
    return bound(F.array_sort(xs), middle)


def evidence_record(segments: Column, query_seconds: Column, window: float = 10.0) -> Column:
    """SCL-17: what a candidate's matched segments, array<struct<q, r, shift, pitch, rhythm, chroma>>, say together: their
    number, order, pitch shift, tempo, longest ordered chain, coverage of both sides and mean scores; null without segments."""

    def record(seg: Column, f: Column, dr: Column) -> Column:
        n = F.size(seg)
        ratios = F.transform(_advancing(_deltas(seg["q"]), dr), lambda z: z["q"] / z["r"])
        matched = F.least(window * n, query_seconds)
        mean = lambda k: (_sum(seg[k]) / n).alias(k)
        return F.struct(n.cast("long").alias("matched"), f["ordered"].alias("ordered_fraction"), F.forall(dr, lambda x: x >= 0).alias("ordered"), f["shift_consistency"].alias("shift_consistency"),
                        bound(ratios, lambda r: F.when(F.size(r) > 0, _median(r)).otherwise(1.0)).alias("tempo_median"), f["tempo_consistency"].alias("tempo_consistency"),
                        F.least(window * f["longest"], query_seconds).alias("chain_s"), (matched / F.greatest(query_seconds, F.lit(1e-8))).alias("query_coverage"),
                        F.least(F.lit(1.0), matched / F.greatest(F.get(seg["r"], n - 1) + window, F.lit(1e-8))).alias("reference_coverage"), mean("pitch"), mean("rhythm"), mean("chroma"))

    temporal = lambda seg: F.transform(seg, lambda x: F.struct(x["q"].alias("q"), x["r"].alias("r"), x["shift"].alias("shift")))
    whole = lambda seg: bound(features(temporal(seg)), lambda f: bound(_deltas(seg["r"]), lambda dr: record(seg, f, dr)))
    return bound(F.array_sort(segments), lambda seg: F.when(F.size(seg) > 0, whole(seg)))


def pair_vector(score: Column, pitch: Column, rhythm: Column, chroma: Column, segments: Column) -> Column:
    """SCL-18: the 12 features of a candidate."""
    given = [score, pitch, rhythm, chroma, pitch * rhythm, rhythm * chroma, F.least(pitch, rhythm, chroma)]
    return bound(features(segments), lambda f: F.array(*given, *[f[k] for k in ("ordered", "shift_consistency", "tempo_consistency", "coverage", "segments")]))


def query_vector(vectors: Column) -> Column:
    """WIN-11: three pair vectors, by their first element descending, as 96 features; null unless there are three."""

    def whole(z: Column) -> Column:
        at = lambda i: F.element_at(z, i)
        idx = F.sequence(F.lit(1), F.size(at(1)))
        over = lambda f: F.transform(idx, lambda j: bound(F.transform(z, lambda v: F.element_at(v, j)), f))
        gap = lambda a, b: F.zip_with(at(a), at(b), lambda x, y: x - y)
        return F.concat(F.flatten(z), over(F.array_max), over(_mean), over(std0), gap(1, 2), gap(2, 3))

    return bound(F.sort_array(vectors, asc=False), lambda z: F.when(F.size(z) == 3, whole(z)))
