"""Scalar, array and path functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def window_starts(duration: Column, width: float = 10.0, step: float = 5.0) -> Column:
    """SCL-03: starts of full windows plus one forced to the end; none below the width."""
    last = duration - width
    n = F.floor((last + 0.001) / step).cast("int")
    starts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n)), lambda i: i * step)
    tail = last - n * step
    out = F.when(F.abs(tail) > 0.001, F.array_append(starts, last)).otherwise(starts)
    return F.when(duration >= width, out).otherwise(F.array().cast("array<double>"))


def even_starts(duration: Column, count: int, width: float = 10.0) -> Column:
    """SCL-04: up to ``count`` evenly spaced starts, distinct and in order."""
    last = F.greatest(F.lit(0.0), duration - width)
    starts = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.round(i * last / max(1, count - 1), 3))
    return F.when(duration >= width, F.array_sort(F.array_distinct(starts))).otherwise(F.array().cast("array<double>"))


def full_windows(n: Column, width: int, step: int) -> Column:
    """SCL-05: starts of windows that fit into n samples; no tail."""
    return F.when(n >= width, F.sequence(F.lit(0).cast("long"), (n - width).cast("long"), F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def pitch_class(hz: Column) -> Column:
    """SCL-10: class of the nearest semitone (halves to even)."""
    return F.pmod(F.rint(69 + 12 * F.log2(hz / 440.0)).cast("long"), F.lit(12))


def midi_hz(note: Column) -> Column:
    """SCL-11"""
    return 440.0 * F.pow(F.lit(2.0), (note - 69) / 12.0)


def _roll(v: Column, s: Column, n: int) -> Column:
    """numpy's roll: element i of the result is element i - s of v."""
    cut = n - s
    return F.concat(F.slice(v, cut + 1, s), F.slice(v, F.lit(1), cut))


def best_roll(a: Column, b: Column, n: int = 12) -> tuple[Column, Column]:
    """SCL-12: largest dot product of a with b rolled by 0..n-1, and the first shift that gives it."""
    dots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: F.round(F.aggregate(F.zip_with(a, _roll(b, s, n), lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x), 6))
    top = F.array_max(dots)
    return top, (F.array_position(dots, top) - 1).cast("long")


def feature_score(pitch: Column, chroma: Column, rhythm: Column) -> Column:
    return 0.4 * pitch + 0.35 * chroma + 0.25 * rhythm


def fusion(clap: Column, features: Column) -> Column:
    """SCL-19"""
    return 0.5 * clap + 0.5 * features


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def linear_score(vector: Column, mean: list[float], std: list[float], weights: list[float], bias: float, floor: float = 1e-8) -> Column:
    """SCL-20: clipped sigmoid of the standardised linear score."""
    z = F.lit(float(bias))
    for i, (m, s, w) in enumerate(zip(mean, std, weights, strict=True)):
        z = z + (F.element_at(vector, i + 1) - m) / max(s, floor) * w
    return sigmoid(z)


# The weights of the twelve degrees in a major and in a minor key (Krumhansl and Kessler).
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]


def key_profiles() -> list[tuple[str, list[float]]]:
    """24 profiles, standardised so that a dot product over a standardised chroma is a correlation."""
    out = []
    for mode, p in (("major", MAJOR), ("minor", MINOR)):
        mean = sum(p) / 12
        norm = math.sqrt(sum((x - mean) ** 2 for x in p))
        out += [(f"{root}:{mode}", [(p[(i - root) % 12] - mean) / norm for i in range(12)]) for root in range(12)]
    return out


def key_correlations(chroma: Column) -> Column:
    """array<struct<r, key>> of the correlations with all 24 keys; null for a flat chroma."""
    mean = F.aggregate(chroma, F.lit(0.0), lambda s, x: s + x) / 12
    dev = F.transform(chroma, lambda x: x - mean)
    norm = F.sqrt(F.aggregate(dev, F.lit(0.0), lambda s, x: s + x * x))
    dots = [F.struct(F.round(F.aggregate(F.zip_with(dev, F.array(*map(F.lit, p)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / norm, 6).alias("r"), F.lit(k).alias("key")) for k, p in key_profiles()]
    return F.when(norm > 0, F.array(*dots))


def estimate_key(chroma: Column) -> Column:
    """SCL-21: the best correlated key; ties to the smaller name."""
    found = F.array_sort(F.transform(key_correlations(chroma), lambda x: F.struct((-x["r"]).alias("r"), x["key"].alias("key"))))
    return F.element_at(found, 1)["key"]


def segment_seconds(name: Column) -> Column:
    """SCL-22: seconds from ``_000123s``; 0 without it."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"_(\d{6})s", 1), F.lit("")).cast("double"), F.lit(0.0))


def strip_segment(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)_seg(?:ment)?_?\d+$", "")


def basename(path: Column) -> Column:
    """SCL-23: last part of a path with either separator."""
    return F.element_at(F.split(path, r"[\\/]"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def safe_name(path: Column, most: int = 180) -> Column:
    """SCL-24: basename without control or reserved characters, trimmed of spaces and dots, at most ``most`` letters;
    ``upload`` where nothing is left or the name is null."""
    clean = F.regexp_replace(F.regexp_replace(basename(path), r'[<>:"/\\|?*\x00-\x1F]', "_"), r"^[ .]+|[ .]+$", "")
    return F.coalesce(F.nullif(F.substring(clean, 1, most), F.lit("")), F.lit("upload"))


def reorder_blocks(samples: Column, block: int, order: list[int]) -> Column:
    """SCL-27: whole blocks in the given order (repeats allowed); the incomplete last block and missing ones drop out."""
    n = F.floor(F.size(samples) / block).cast("int")
    picked = [F.when(F.lit(i) < n, F.slice(samples, i * block + 1, block)) for i in order]
    return F.flatten(F.filter(F.array(*picked), lambda x: x.isNotNull()))


def drawn(seed: Column, name: str) -> Column:
    """A number in [0, 1) that follows from the seed and a name: 48 bits of a SHA-256."""
    h = F.sha2(F.concat_ws(":", seed.cast("string"), F.lit(name)), 256)
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / float(1 << 48)


def shuffled(items: Column, seed: Column) -> Column:
    """A seeded permutation: items by the SHA-256 of seed and position."""
    keyed = F.transform(items, lambda x, i: F.struct(F.sha2(F.concat_ws(":", seed.cast("string"), i.cast("string")), 256).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


def excerpt_starts(duration: Column, length: float, seed: Column | None = None) -> Column:
    """SCL-30: 15, 50 and 80 % of the last possible start, in a seeded order if there is a seed."""
    last = F.greatest(F.lit(0.0), duration - length)
    starts = F.transform(F.array(F.lit(0.15), F.lit(0.5), F.lit(0.8)), lambda p: F.round(p * last, 3))
    return starts if seed is None else shuffled(starts, seed)


def peak_normalise(samples: Column, peak: float = 0.98) -> Column:
    """SCL-26: NaN to 0, then scaled to the peak; silence stays."""
    clean = F.transform(samples, lambda x: F.when(F.isnan(x), 0.0).otherwise(x))
    top = F.array_max(F.transform(clean, lambda x: F.abs(x)))
    return F.when(top > 0, F.transform(clean, lambda x: x * peak / top)).otherwise(clean)


def hms_seconds(text: Column) -> Column:
    """SRC-09: seconds from ``Duration: H:M:S``; null without it."""
    part = lambda i: F.nullif(F.regexp_extract(text, r"Duration:\s*(\d+):(\d+):(\d+(?:\.\d+)?)", i), F.lit("")).cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3)


# Fixed values of the edits: block length in seconds, ranges of ratio, tempo and gains in dB, and the filter chains.
SECTION_SECONDS, SAMPLE_RATE = 24, 22_050
RATIO, EQ_DB, TEMPO, BASS_DB = (1.03, 1.12), (-3.0, 3.0), (0.94, 0.98), (-2.0, 2.0)
TEMPO_FILTERS = f"asetrate={SAMPLE_RATE}*%s,aresample={SAMPLE_RATE},equalizer=f=1200:t=q:w=1:g=%s"
REMIX_FILTERS = "atempo=%s,equalizer=f=180:t=q:w=1:g=%s,aecho=0.8:0.75:70:0.12"


def edit_manifest(case: Column, seed: Column, sections: Column) -> tuple[Column, Column]:
    """SCL-28: (parameters as JSON, filter chain or null) of an edit, drawn from the seed; running the filters needs an audio
    tool that isn't here.

    section_edit: the blocks' order, shuffled, with one block repeated somewhere; tempo_pitch_eq: ratio and gain at
    1200 Hz; remix_fx: tempo and bass gain under a mild echo.
    """
    within = lambda name, span, digits: F.round(span[0] + drawn(seed, name) * (span[1] - span[0]), digits)
    order = shuffled(F.sequence(F.lit(0), sections - 1), seed)
    pick = lambda name, n: F.floor(drawn(seed, name) * n).cast("int")
    order = F.array_insert(order, pick("place", sections + 1) + 1, F.element_at(order, pick("repeat", sections) + 1))
    ratio, eq, tempo, bass = within("ratio", RATIO, 4), within("eq", EQ_DB, 1), within("tempo", TEMPO, 4), within("bass", BASS_DB, 1)
    made = {"section_edit": F.struct(F.lit("reorder_and_repeat_sections").alias("edit"), F.lit(SECTION_SECONDS).alias("section_seconds"), order.alias("section_order")),
            "tempo_pitch_eq": F.struct(ratio.alias("speed_and_pitch_ratio"), eq.alias("eq_1200hz_db")),
            "remix_fx": F.struct(tempo.alias("tempo_rate"), bass.alias("bass_eq_db"), F.lit("mild").alias("echo"))}
    parameters = F.coalesce(*[F.when(case == k, F.to_json(v)) for k, v in made.items()])
    text = lambda c: c.cast("string")
    return parameters, F.when(case == "tempo_pitch_eq", F.format_string(TEMPO_FILTERS, text(ratio), text(eq))).when(case == "remix_fx", F.format_string(REMIX_FILTERS, text(tempo), text(bass)))
