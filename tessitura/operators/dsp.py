"""Filters over mono PCM: resampling, equalizer, echo and time stretching, and the filter chains of the edits.

Each works in pieces of bounded size: a signal of any length costs memory for its samples and one piece.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction
from functools import lru_cache

import numpy as np

CROSSINGS, PIECE, BLOCK = 24, 1 << 14, 64


def resample(x: np.ndarray, ratio: Fraction | float) -> np.ndarray:
    """x at ``ratio`` times its rate, by a polyphase bank of windowed sincs that ends below the lower rate's half, so that
    higher tones are taken out rather than folded down. ceil(n * ratio) samples."""
    ratio = Fraction(ratio).limit_denominator(100_000)
    up, down = ratio.numerator, ratio.denominator
    if up == down or not len(x):
        return np.array(x, dtype=np.float64)
    scale = min(1.0, up / down)  # the bank's cut, as a share of the input's
    half = math.ceil(CROSSINGS / scale)
    n, out = math.ceil(len(x) * ratio), []
    padded = np.concatenate([np.zeros(half), x, np.zeros(half + 1)])
    near = np.arange(-half + 1, half + 1)
    for a in range(0, n, PIECE):
        at = np.arange(a, min(n, a + PIECE), dtype=np.int64) * down
        whole, phase = at // up, at % up
        kinds, which = np.unique(phase, return_inverse=True)
        bank = _bank(kinds / up, near, scale * 0.95, half)
        out.append(np.einsum("ij,ij->i", np.lib.stride_tricks.sliding_window_view(padded, 2 * half)[whole + 1], bank[which]))
    return np.concatenate(out)


def _bank(place: np.ndarray, near: np.ndarray, cut: float, half: int) -> np.ndarray:
    """Windowed sincs at place - near; sine and cosine of the differences follow from those of both sides."""
    x = np.pi * cut * (place[:, None] - near[None, :])
    p, k = np.pi * cut * place, np.pi * cut * near
    sine = np.column_stack([np.sin(p), -np.cos(p)]) @ np.array([np.cos(k), np.sin(k)])
    at = np.abs(x) < 1e-9
    x[at], sine[at] = 1.0, 1.0
    p, k = np.pi / 2 / (half + 1) * place, np.pi / 2 / (half + 1) * near
    bell = np.column_stack([np.cos(p), np.sin(p)]) @ np.array([np.cos(k), np.sin(k)])
    bank = sine / x * bell * bell
    return bank / bank.sum(axis=1, keepdims=True)  # a constant stays what it is


@lru_cache(maxsize=256)
def _responses(b: tuple[float, float, float], a: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """The recurrence's response to each sample of a block and to both remembered numbers, and what it then remembers."""
    x = np.vstack([np.eye(BLOCK), np.zeros((2, BLOCK))])
    s1, s2 = np.zeros(BLOCK + 2), np.zeros(BLOCK + 2)
    s1[BLOCK] = s2[BLOCK + 1] = 1.0
    out = np.zeros((BLOCK + 2, BLOCK))
    for i in range(BLOCK):
        y = b[0] * x[:, i] + s1
        s1, s2 = b[1] * x[:, i] - a[0] * y + s2, b[2] * x[:, i] - a[1] * y
        out[:, i] = y
    return out, np.column_stack([s1, s2])


class Biquad:
    """y[n] = b0 x[n] + b1 x[n-1] + b2 x[n-2] - a1 y[n-1] - a2 y[n-2], a block of samples as one product with the
    recurrence's own response; what it remembers carries over from call to call."""

    def __init__(self, b: tuple[float, float, float], a: tuple[float, float]):
        self.state = np.zeros(2)
        self.out, self.next = _responses(b, a)
        self.b, self.a = b, a

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = np.empty(len(x))
        whole = len(x) - len(x) % BLOCK
        for i in range(0, whole, BLOCK):
            z = np.concatenate([x[i : i + BLOCK], self.state])
            y[i : i + BLOCK], self.state = z @ self.out, z @ self.next
        s1, s2 = self.state
        for i in range(whole, len(x)):
            y[i] = self.b[0] * x[i] + s1
            s1, s2 = self.b[1] * x[i] - self.a[0] * y[i] + s2, self.b[2] * x[i] - self.a[1] * y[i]
        self.state = np.array([s1, s2])
        return y


def peaking(rate: int, hz: float, gain_db: float, q: float = 1.0) -> Biquad:
    """An equalizer band: ``gain_db`` at ``hz``, nothing far from it."""
    level, w = 10 ** (gain_db / 40), 2 * np.pi * hz / rate
    alpha = np.sin(w) / (2 * q)
    whole = 1 + alpha / level
    return Biquad(((1 + alpha * level) / whole, -2 * np.cos(w) / whole, (1 - alpha * level) / whole), (-2 * np.cos(w) / whole, (1 - alpha / level) / whole))


def echo(x: np.ndarray, rate: int, gain_in: float, gain_out: float, delay_ms: float, decay: float) -> np.ndarray:
    """The signal and one delayed copy, longer by the delay."""
    late = round(delay_ms * rate / 1000)
    y = np.zeros(len(x) + late)
    y[: len(x)] = gain_in * x
    y[late:] += decay * x
    return gain_out * y


def stretch(x: np.ndarray, tempo: float, rate: int, window_s: float = 0.04, search_s: float = 0.01) -> np.ndarray:
    """x played ``tempo`` times as fast at its own pitch: windows overlap by half, each taken from near its place where it
    best continues the one before. round(n / tempo) samples."""
    size = 2 * max(8, int(window_s * rate / 2))
    hop, reach, n = size // 2, int(search_s * rate), round(len(x) / tempo)
    if len(x) < 2 * size or tempo == 1:
        return resample(x, Fraction(max(n, 0), len(x)))[:n] if len(x) and tempo != 1 else np.array(x[:n], dtype=np.float64)
    fade, ones = np.hanning(size + 1)[:-1], np.ones(size)
    padded = np.concatenate([np.zeros(reach), x, np.zeros(size + hop + reach)])
    y, weight, at = np.zeros(n + 2 * size), np.zeros(n + 2 * size), 0
    for k in range(0, n, hop):
        ideal = int(k * tempo)
        if k:
            follow = padded[at + hop : at + hop + size]  # what would come next of the last window
            near = padded[ideal : ideal + 2 * reach + size]
            energy = np.sqrt(np.correlate(near * near, ones)) + 1e-9
            at = ideal + int((np.correlate(near, follow) / energy).argmax())
        else:
            at = reach
        y[k : k + size] += fade * padded[at : at + size]
        weight[k : k + size] += fade
    return y[:n] / np.maximum(weight[:n], 1e-3)


def apply_filters(x: np.ndarray, rate: int, chain: str | None) -> np.ndarray:
    """A chain of the edit manifest (``name=options`` joined by commas): asetrate with aresample, equalizer, atempo, aecho."""
    own = float(rate)
    for part in (chain or "").split(","):
        name, _, told = part.partition("=")
        if name == "asetrate":
            base, _, ratio = told.partition("*")
            own = float(base) * float(ratio or 1)
        elif name == "aresample":
            x, own = resample(x, Fraction(told) / Fraction(str(round(own, 6)))), float(told)
        elif name == "equalizer":
            o = dict(kv.split("=") for kv in told.split(":"))
            x = peaking(rate, float(o["f"]), float(o["g"]), float(o["w"]))(x)
        elif name == "atempo":
            x = stretch(x, float(told), rate)
        elif name == "aecho":
            x = echo(x, rate, *map(float, re.split(":", told)))
        elif part:
            raise ValueError(f"no filter {name}")
    return x
