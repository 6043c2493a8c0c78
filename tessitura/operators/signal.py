"""Signal kernels: WAV decoding, spectra, chroma, onset profiles, alignment. NumPy inside Arrow batches.

Kernels take one item and return one result; ``apply_kernel`` maps one over a column in Arrow batches and splits errors
into a column of their own, so a bad item never stops a job and never counts as a pass.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dsp import resample


def apply_kernel(df: DataFrame, keep: list[str], inputs: list[str], kernel: Callable, result_type: str) -> DataFrame:
    """``keep`` columns, ``value`` (result_type) and ``error`` (type and message, null if fine)."""
    empty = df.sparkSession.createDataFrame([], f"value {result_type}")
    schema = df.select(*keep).schema.add("value", empty.schema["value"].dataType).add("error", "string")
    kind = empty.toArrow().schema.field("value").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, errors = [], []
            for args in zip(*(batch.column(c) for c in inputs), strict=True):
                try:
                    values.append(kernel(*(a.as_py() for a in args)))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  reported as a row
                    values.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(values, kind), pa.array(errors, pa.string())], [*keep, "value", "error"])

    return df.select(*dict.fromkeys([*keep, *inputs])).mapInArrow(run, schema)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all tasks: a kernel's work is large against its input, which may come as one small partition."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


# --- PCM -----------------------------------------------------------------------------------------


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """16-bit mono WAV."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def wav_header(samples: int, rate: int) -> bytes:
    """What precedes the samples of a 16-bit mono WAV."""
    return b"RIFF" + struct.pack("<I", 36 + 2 * samples) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", 2 * samples)


def decode_wav(data: bytes, rate: int = 22_050) -> np.ndarray:
    """SRC-08: mono float PCM at ``rate`` from 8, 16 or 32 bit WAV; other containers need a decoder that isn't here."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, own = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width not in (1, 2, 4):
        raise ValueError(f"{8 * width} bit samples")
    x = np.frombuffer(raw, dtype={1: "u1", 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
    x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    x = x.reshape(-1, channels).mean(axis=1)
    if own != rate and len(x):
        x = resample(x, Fraction(rate, own))
    return x


def decode(data: bytes, rate: int = 22_050, other: Callable[[bytes, int], np.ndarray] | None = None) -> np.ndarray:
    """SRC-08: WAV is read here; any other container goes to ``other`` (bytes, rate) -> mono PCM, say one that pipes it through
    an audio tool on the executors, and is an error without it."""
    if data[:4] == b"RIFF":
        return decode_wav(data, rate)
    if other is None:
        raise ValueError("not a WAV file, and no other decoder is given")
    return np.asarray(other(data, rate), dtype=np.float64)


def tone(hz: float, seconds: float, rate: int, level: float = 0.5) -> np.ndarray:
    """SCL-29: a note with three partials and a soft attack and end."""
    t = np.arange(int(seconds * rate)) / rate
    x = sum(level / k * np.sin(2 * np.pi * hz * k * t) for k in (1, 2, 3)) / 1.8333
    ramp = np.minimum(1, np.minimum(t, t[::-1]) / 0.01) if len(t) else t
    return x * ramp


def layer(original: np.ndarray, added: np.ndarray, gain: float = 0.86, added_gain: float = 0.34, peak: float = 0.98) -> np.ndarray:
    """SCL-29: mix of two signals over the shorter one, peak normalised."""
    n = min(len(original), len(added))
    return normalise_peak(gain * original[:n] + added_gain * added[:n], peak)


def normalise_peak(x: np.ndarray, peak: float = 0.98) -> np.ndarray:
    """SCL-26: NaN to 0, scaled to the peak; silence stays."""
    x = np.nan_to_num(np.asarray(x, dtype=np.float64))
    top = np.abs(x).max(initial=0)
    return x * (peak / top) if top > 0 else x


# --- spectra -------------------------------------------------------------------------------------


def _frames(x: np.ndarray, size: int, hop: int, centred: bool) -> np.ndarray:
    if centred:
        x = np.pad(x, size // 2, mode="reflect" if len(x) > size // 2 else "constant")
    if len(x) < size:
        x = np.pad(x, (0, size - len(x)))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def _unit(m: np.ndarray, floor: float = 1e-8) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), floor)


def chroma(x: np.ndarray, rate: int = 22_050, size: int = 4096, hop: int = 2048, low: float = 55.0, high: float = 5000.0, centred: bool = True) -> np.ndarray:
    """SCL-08: [frames, 12] energy per pitch class, each frame of unit length."""
    spec = np.abs(np.fft.rfft(_frames(np.asarray(x, dtype=np.float64), size, hop, centred) * np.hanning(size), axis=1))
    hz = np.fft.rfftfreq(size, 1 / rate)
    use = (hz >= low) & (hz <= high)
    pc = np.mod(np.rint(69 + 12 * np.log2(hz[use] / 440.0)).astype(int), 12)
    out = np.zeros((len(spec), 12))
    for k in range(12):
        out[:, k] = spec[:, use][:, pc == k].sum(axis=1)
    return _unit(out)


def evidence(x: np.ndarray, rate: int = 22_050, size: int = 2048, hop: int = 512, low: float = 80.0, high: float = 4000.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """SCL-09: (histogram of the strongest pitch class of each frame, mean chroma, onset strength), from frames without
    padding. The onset strength is the positive flux of the band's spectrum, each frame taken as shares of its sum."""
    x = np.asarray(x, dtype=np.float64)
    if len(x) < size:
        raise ValueError(f"{len(x)} samples are too short for a spectrum of {size}")
    spec = np.abs(np.fft.rfft(_frames(x, size, hop, False) * np.hanning(size), axis=1))
    hz = np.fft.rfftfreq(size, 1 / rate)
    use = (hz >= low) & (hz <= high)
    part = spec[:, use]
    pc = np.mod(np.rint(69 + 12 * np.log2(hz[use] / 440.0)).astype(int), 12)
    top = part.argmax(axis=1)
    pitch = np.bincount(pc[top], weights=part[np.arange(len(part)), top], minlength=12)
    mean = np.array([part[:, pc == k].sum() for k in range(12)])
    share = part / np.maximum(part.sum(axis=1, keepdims=True), 1e-8)
    onset = np.r_[0.0, np.clip(share[1:] - share[:-1], 0, None).sum(axis=1)]
    return _unit(pitch), _unit(mean), onset


# --- fingerprints ----------------------------------------------------------------------------------

#: Frames and classes that a fingerprint's filters span, and the cuts of their responses: two bits for each filter.
SPAN, CLASSES, CUTS = 16, 12, (-0.15, 0.0, 0.15)


def box_filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) of 16 filters by rule. Kind 0: later less earlier half; 1: upper less lower half of
    the classes; 2: quarters crosswise; 3: the middle less both ends."""
    return [(i % 4, 5 * i % 8, 3 + i // 4 % 2, 4 + 4 * (i * 7 // 4 % 4)) for i in range(16)]


def box_responses(frames: np.ndarray) -> np.ndarray:
    """The response of every filter at every frame from which SPAN frames are left, by sums of boxes taken from a summed-area
    table: the log of one part's sum over the other's."""
    area = np.zeros((len(frames) + 1, CLASSES + 1))
    area[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    n = max(0, len(frames) - SPAN + 1)
    t = np.arange(n)
    box = lambda a, b, low, high: area[t + b][:, high] - area[t + a][:, high] - area[t + b][:, low] + area[t + a][:, low]
    out = np.zeros((n, 16))
    for k, (kind, y, h, w) in enumerate(box_filters()):
        top, half, mid = min(CLASSES, y + h), w // 2, y + max(1, h // 2)
        if kind == 0:
            a, b = box(half, w, y, top), box(0, half, y, top)
        elif kind == 1:
            a, b = box(0, w, mid, top), box(0, w, y, mid)
        elif kind == 2:
            a, b = box(half, w, mid, top) + box(0, half, y, mid), box(0, half, mid, top) + box(half, w, y, mid)
        else:
            a, b = box(w // 4, w - w // 4, y, top), box(0, w // 4, y, top) + box(w - w // 4, w, y, top)
        out[:, k] = np.log((1e-3 + np.maximum(a, 0)) / (1e-3 + np.maximum(b, 0)))
    return out


def fingerprint(x: np.ndarray, rate: int, size: int = 4096, hop: int = 1365, least_s: float = 10.0, most_s: float = 1800.0) -> list[int]:
    """SRC-10: 32-bit words, one for each chroma frame from which SPAN frames are left; between 10 and 1,800 seconds of audio.
    Frames are of unit length, so gain doesn't count; a clip that begins at a frame has a run of its source's words."""
    if not least_s <= len(x) / rate <= most_s:
        raise ValueError("TOO_SHORT" if len(x) / rate < least_s else "TOO_LONG")
    bits = np.zeros(0, dtype=np.int64)
    step = 4096 * hop  # frames are made in stretches, each with the SPAN - 1 frames that its last words need
    for a in range(0, max(1, len(x) - size + 1), step):
        piece = x[a : a + step + (SPAN - 2) * hop + size]
        if len(piece) >= size:
            r = box_responses(_unit(chroma(piece, rate, size, hop, centred=False)))
            level = sum((r >= c).astype(np.int64) for c in CUTS)
            gray = level ^ (level >> 1)
            bits = np.concatenate([bits, (gray << (2 * np.arange(16))).sum(axis=1)])
    if not len(bits):
        raise ValueError("EMPTY_FINGERPRINT")
    return bits.tolist()


def rolled_cosine(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
    """SCL-12: best cosine of a with b rolled by 0..11, and the first shift that gives it."""
    scores = [float(np.dot(a, np.roll(b, s))) for s in range(12)]
    s = int(np.argmax(np.round(scores, 12)))
    return scores[s], s


def onset_profile(onset: np.ndarray, lags: range = range(10, 90)) -> np.ndarray:
    """SCL-13: autocorrelation of the centred onset strength at each lag; zero where the signal is too short."""
    o = onset - onset.mean() if len(onset) else onset
    return np.array([float(np.dot(o[:-k], o[k:])) if k < len(o) else 0.0 for k in lags])


def rhythm_score(a: np.ndarray, b: np.ndarray) -> float:
    """SCL-13: cosine of two onset profiles, not below 0."""
    p, q = onset_profile(a), onset_profile(b)
    d = np.linalg.norm(p) * np.linalg.norm(q)
    return max(0.0, float(np.dot(p, q) / d)) if d > 1e-12 else 0.0


def bins(frames: np.ndarray, per: int = 11, width: int = 10, step: int = 5) -> list[tuple[int, np.ndarray]]:
    """SCL-07: means of ``per`` frames (of what is left in the last bin), unit length, as (first bin, window of ``width``
    bins) every ``step`` bins and once more at the end; fewer bins than a window are padded with zeros."""
    if not len(frames):
        raise ValueError("no chroma frames")
    starts = np.arange(0, len(frames), per)
    means = np.add.reduceat(frames, starts, axis=0) / np.diff(np.r_[starts, len(frames)])[:, None]
    return chroma_windows(_unit(means), width, step)


def chroma_windows(frames: np.ndarray, width: int = 108, step: int = 54) -> list[tuple[int, np.ndarray]]:
    """SCL-06: (start, window) every ``step`` frames plus a last one at the end; shorter input is padded with zeros."""
    n = len(frames)
    if n < width:
        return [(0, np.vstack([frames, np.zeros((width - n, frames.shape[1]))]))] if n else []
    starts = sorted({*range(0, n - width + 1, step), n - width})
    return [(s, frames[s : s + width]) for s in starts]


def aligned_scores(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The scores of ``aligned_score`` for all pairs of windows, twelve products of matrices; rounded, so that equal windows
    tie wherever they stand."""
    x, y = np.stack(a).reshape(len(a), -1), np.stack(b)
    rolled = (x @ np.roll(y, s, axis=2).reshape(len(b), -1).T for s in range(12))
    return np.round(reduce(np.maximum, rolled) / len(a[0]), 12)


def aligned_score(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
    """SCL-16 for one window pair: mean frame dot product, best of 12 rolls."""
    scores = [float((a * np.roll(b, s, axis=1)).sum(axis=1).mean()) for s in range(12)]
    s = int(np.argmax(np.round(scores, 12)))
    return scores[s], s


#: SCL-16's result.
COMPARED = ("top3_mean double, best_segment double, best_query_s double, best_candidate_s double, query_segments int, candidate_segments int, "
            "selected array<struct<score: double, query_s: double, candidate_s: double>>")


def compare_chroma(a: np.ndarray, b: np.ndarray, frame_s: float = 2048 / 22_050, apart_s: float = 10.0, k: int = 3) -> dict:
    """SCL-16: the best window pair (ties: the earliest), and of the k best that lie ``apart_s`` apart on both sides, taken in
    order (score, query, candidate) descending, the pairs and their mean."""
    wa, wb = chroma_windows(a), chroma_windows(b)
    if not wa or not wb:
        raise ValueError("no chroma windows")
    scores = aligned_scores([x for _, x in wa], [y for _, y in wb])
    at_a, at_b = (np.array([s for s, _ in w]) * frame_s for w in (wa, wb))
    i, j = (x.ravel() for x in np.indices(scores.shape))
    kept: list[tuple[int, int]] = []
    for at in np.lexsort((j, i, scores.ravel()))[::-1]:
        p = (int(i[at]), int(j[at]))
        if all(abs(at_a[p[0]] - at_a[q]) >= apart_s and abs(at_b[p[1]] - at_b[r]) >= apart_s for q, r in kept):
            kept.append(p)
            if len(kept) == k:
                break
    best = np.unravel_index(int(scores.argmax()), scores.shape)
    return {"top3_mean": float(np.mean([scores[p] for p in kept])), "best_segment": float(scores[best]), "best_query_s": float(at_a[best[0]]), "best_candidate_s": float(at_b[best[1]]),
            "query_segments": len(wa), "candidate_segments": len(wb),
            "selected": [{"score": float(scores[p]), "query_s": float(at_a[p[0]]), "candidate_s": float(at_b[p[1]])} for p in kept]}


def dtw(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
    """SCL-14: (1 - cost of the cheapest monotone path / max length, shift) after transposing b to the best shift of the mean
    chroma; 0 if either side is empty. Cells are filled by antidiagonals."""
    if not len(a) or not len(b):
        return 0.0, 0
    means = a.mean(axis=0), b.mean(axis=0)
    shift = int(np.argmax(np.round([means[0] @ np.roll(means[1], -s) for s in range(12)], 12)))
    cost = 1 - np.clip(a @ np.roll(b, -shift, axis=1).T, 0, 1)
    n, m = cost.shape
    acc = np.full((n + 1, m + 1), np.inf)
    acc[0, 0] = 0
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        acc[i, j] = cost[i - 1, j - 1] + np.minimum(np.minimum(acc[i - 1, j], acc[i, j - 1]), acc[i - 1, j - 1])
    return max(0.0, 1 - float(acc[n, m]) / max(n, m)), shift


#: SCL-15's result.
ALIGNED = ("dtw_score double, coarse_score double, windows int, match_s double, query_s double, candidate_s double, shifts array<int>, "
           "query_windows int, candidate_windows int")


def aligned_dtw(a: np.ndarray, b: np.ndarray, frame_s: float = 2048 / 22_050, window_s: float = 10.0, step_s: float = 5.0, tolerance: float = 0.6) -> dict:
    """SCL-15: windows of 1 s bins are compared by the best rolled product of their means; the best run of three, else two
    windows that both advance by ``step_s`` (less than ``tolerance`` off), else the best single pair, is scored by the mean
    DTW similarity of its window pairs."""
    per = max(1, round(1 / frame_s))
    wa, wb = bins(a, per), bins(b, per)
    ma, mb = (np.array([w.mean(axis=0) for _, w in x]) for x in (wa, wb))
    coarse = np.maximum(0, np.max([ma @ np.roll(mb, s, axis=1).T for s in range(12)], axis=0))
    at_a, at_b = (np.array([s for s, _ in w]) * per * frame_s for w in (wa, wb))
    for run in (3, 2, 1):
        n, m = len(wa) - run + 1, len(wb) - run + 1
        if min(n, m) < 1:
            continue
        even = [np.all([np.abs(at[k + 1 : k + 1 + c] - at[k : k + c] - step_s) < tolerance for k in range(run - 1)], axis=0) if run > 1 else np.ones(c, dtype=bool) for at, c in ((at_a, n), (at_b, m))]
        score = np.where(np.outer(*even), np.mean([coarse[k : k + n, k : k + m] for k in range(run)], axis=0), -np.inf)
        i, j = (int(x) for x in np.unravel_index(int(np.argmax(np.round(score, 12))), score.shape))
        if np.isfinite(score[i, j]):
            found = [dtw(wa[i + k][1], wb[j + k][1]) for k in range(run)]
            return {"dtw_score": float(np.mean([f[0] for f in found])), "coarse_score": float(score[i, j]), "windows": run, "match_s": window_s + (run - 1) * step_s, "query_s": float(at_a[i]), "candidate_s": float(at_b[j]),
                    "shifts": [f[1] for f in found], "query_windows": len(wa), "candidate_windows": len(wb)}
    raise AssertionError("single windows always match")


def embed(x: np.ndarray, rate: int, dim: int = 64) -> np.ndarray:
    """UDF-01 stand-in: log energies of ``dim`` bands, centred, of unit length; a model with the same signature replaces it."""
    if not len(x):
        return np.zeros(dim)
    spec = np.abs(np.fft.rfft(_frames(np.asarray(x, dtype=np.float64), 2048, 1024, False) * np.hanning(2048), axis=1)).mean(axis=0)
    bands = np.array([np.log1p(b.sum()) for b in np.array_split(spec, dim)])
    return _unit(bands - bands.mean())


def embed_windows(df: DataFrame, keep: list[str], pcm: str, rate: int, model: Callable = embed) -> DataFrame:
    """UDF-01: one unit vector for each PCM row; ``model`` is sent to the workers once with the task."""
    return apply_kernel(df, keep, [pcm], lambda x: [float(v) for v in model(np.array(x), rate)], "array<double>")
