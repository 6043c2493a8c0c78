"""Filters against closed forms, container headers of hand-made files, and the digest tree."""

from __future__ import annotations

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest

from tessitura.operators import dsp, metrics, signal
from tessitura.plans.q_signal import made_file
from tessitura.sources import containers

RATE = 22_050


def sine(hz, rate, n):
    return np.sin(2 * np.pi * hz * np.arange(n) / rate)


def level(x):
    return np.sqrt(2 * np.mean(x[len(x) // 4 : -len(x) // 4] ** 2))


@pytest.mark.parametrize(("own", "to"), [(48_000, 22_050), (44_100, 22_050), (8_000, 22_050), (22_050, 48_000)])
def test_resampling_keeps_tones_and_rejects_aliases(own, to):
    n, ratio = 20_000, Fraction(to, own)
    low = dsp.resample(sine(1000, own, n), ratio)
    assert len(low) == -(-n * to // own)
    want = sine(1000, to, len(low))
    assert np.abs(low - want)[500:-500].max() < 2e-3
    if to < own:
        for hz in (0.58 * to, 0.8 * to, 0.45 * own):
            assert level(dsp.resample(sine(hz, own, n), ratio)) < 1e-3, hz
    assert np.abs(dsp.resample(np.ones(3000), ratio)[200:-200] - 1).max() < 1e-9
    assert len(dsp.resample(np.zeros(0), ratio)) == 0


def test_equalizer_gain_and_carried_state():
    for hz, gain in ((1200, -3.0), (180, 2.0)):
        at = dsp.peaking(RATE, hz, gain)(sine(hz, RATE, 40_000))
        assert abs(20 * np.log10(level(at)) - gain) < 0.02
        assert abs(20 * np.log10(level(dsp.peaking(RATE, hz, gain)(sine(9000, RATE, 40_000))))) < 0.1
    x, whole, parts = np.random.default_rng(1).normal(size=5000), dsp.peaking(RATE, 300, 6.0, 2.0), dsp.peaking(RATE, 300, 6.0, 2.0)
    y = whole(x)
    assert np.abs(y - np.concatenate([parts(p) for p in np.split(x, [1, 100, 164, 2000, 4999])])).max() < 1e-12
    plain, (b0, b1, b2), (a1, a2) = np.zeros(500), whole.b, whole.a
    for i in range(500):
        plain[i] = b0 * x[i] + (b1 * x[i - 1] - a1 * plain[i - 1] if i else 0) + (b2 * x[i - 2] - a2 * plain[i - 2] if i > 1 else 0)
    assert np.abs(y[:500] - plain).max() < 1e-10


def test_echo_and_stretch():
    x = np.zeros(4000)
    x[10] = 1
    y = dsp.echo(x, RATE, 0.8, 0.75, 70, 0.12)
    assert len(y) == 4000 + 1544 and np.flatnonzero(y).tolist() == [10, 1554] and np.allclose(y[[10, 1554]], [0.6, 0.09])
    for tempo in (0.94, 0.98, 1.25):
        x = sine(440, RATE, 40_000)
        y = dsp.stretch(x, tempo, RATE)
        spectrum = np.abs(np.fft.rfft(y[2000:-2000] * np.hanning(len(y) - 4000)))
        assert len(y) == round(40_000 / tempo) and abs(spectrum.argmax() * RATE / (len(y) - 4000) - 440) < 1.5 and abs(level(y) - 1) < 0.1
    assert len(dsp.stretch(np.ones(100), 0.5, RATE)) == 200 and len(dsp.stretch(np.zeros(0), 0.5, RATE)) == 0


def test_chains():
    x = sine(440, RATE, 22_050)
    y = dsp.apply_filters(x, RATE, "asetrate=22050*1.1000,aresample=22050,equalizer=f=1200:t=q:w=1:g=0.0")
    spectrum = np.abs(np.fft.rfft(y))
    assert len(y) == -(-22_050 * 10 // 11) and abs(spectrum.argmax() * RATE / len(y) - 484) < 2
    assert np.array_equal(dsp.apply_filters(x, RATE, None), x)
    with pytest.raises(ValueError, match="no filter"):
        dsp.apply_filters(x, RATE, "reverb=1")
    wav = signal.decode(signal.wav_bytes(0.5 * sine(15_000, 48_000, 48_000), 48_000), RATE)
    assert len(wav) == 22_050 and level(wav) < 1e-3  # beyond half the new rate: gone, not folded down


def test_durations_of_containers():
    for key in range(1, 60):
        data = made_file(key)
        at = lambda d: containers.duration(d[: containers.HEAD], d[-containers.TAIL :], len(d))
        if key % 11 < 10:
            assert abs(at(data) - (1 + key / 8)) < 1e-9
        elif key % 4 < 3:
            with pytest.raises(ValueError):
                at(data)
    xing = b"\xff\xfb\x90\x00" + bytes(32) + b"Xing" + (1).to_bytes(4, "big") + (1000).to_bytes(4, "big") + bytes(400)
    assert abs(containers.duration(xing, xing, len(xing)) - 1000 * 1152 / 44_100) < 1e-9
    opus = b"OggS\0\2" + bytes(8) + bytes(12) + b"\1\x13" + b"OpusHead\1\2" + (312).to_bytes(2, "little") + bytes(7)
    last = b"OggS\0\4" + (48_312).to_bytes(8, "little") + bytes(13)
    assert containers.duration(opus, last, 10**6) == 1.0
    for bad in (b"", b"RIFF", b"text " * 100, b"fLaC\x04", b"OggS", b"\xff\xfb\x90\x00"):
        with pytest.raises(ValueError):
            containers.duration(bad, bad, len(bad))


def test_digest_tree(spark, monkeypatch):
    monkeypatch.setattr(metrics, "FAN", 3)
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), f"{rng.randrange(30):02d}") for _ in range(60)]
    want = {}
    for key in ("a", "b", None):
        level_ = sorted(h for k, h in rows if k == key)
        for _ in range(metrics.LEVELS):
            level_ = [hashlib.sha256("".join(level_[i : i + 3]).encode()).hexdigest() for i in range(0, len(level_), 3)]
        want[key] = level_
    for parts in (1, 5):
        got = {}
        for r in metrics.digest_tree(spark.createDataFrame(rows, "k string, h string").repartition(parts), "k", "h").collect():
            got.setdefault(r["k"], []).append(r["h"])
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_fingerprint_filters_and_invariance():
    rng = np.random.default_rng(5)
    frames = np.abs(rng.normal(size=(40, 12)))
    got = signal.box_responses(frames)
    assert got.shape == (40 - signal.SPAN + 1, 16)
    for t in (0, 7, 24):
        for k, (kind, y, h, w) in enumerate(signal.box_filters()):
            box, mid = frames[t : t + w, y : min(12, y + h)], max(1, h // 2)
            late, up = np.arange(w)[:, None] >= w // 2, np.arange(box.shape[1])[None, :] >= mid
            plus = (late & (up | ~up), (late | ~late) & up, late == up, (np.arange(w)[:, None] >= w // 4) & (np.arange(w)[:, None] < w - w // 4) & (up | ~up))[kind]
            assert abs(got[t, k] - np.log((1e-3 + box[plus].sum()) / (1e-3 + box[~plus].sum()))) < 1e-9
    x = np.concatenate([signal.tone(hz, 0.7, 8000) for hz in rng.uniform(100, 1500, 20)])
    words = signal.fingerprint(x, 8000)
    assert all(0 <= w < 1 << 32 for w in words) and len(set(words)) > 20
    assert signal.fingerprint(0.25 * x, 8000) == words and signal.fingerprint(x[5 * 1365 :], 8000) == words[5:]
    away = signal.fingerprint(x[300:], 8000)
    assert sum((a ^ b).bit_count() for a, b in zip(words, away, strict=False)) < 0.2 * 32 * len(away)  # most bits stay
    other = signal.fingerprint(rng.normal(size=len(x)), 8000)
    assert sum((a ^ b).bit_count() for a, b in zip(words, other, strict=False)) > 0.3 * 32 * len(other)
    long = np.tile(x, 60)
    assert len(signal.fingerprint(long, 8000)) == (len(long) - 4096) // 1365 + 1 - signal.SPAN + 1
    for n, why in ((100, "TOO_SHORT"), (8000 * 1801, "TOO_LONG")):
        with pytest.raises(ValueError, match=why):
            signal.fingerprint(np.zeros(n), 8000)


def test_headers_never_hold_a_file():
    """The ends are those of the whole file, and a file of a large key costs two blocks."""
    import tracemalloc

    from tessitura.plans.q_signal import made_ends

    for key in [*range(1, 60), 395, 396, 399, 2000, 2004]:
        data = made_file(key)
        assert made_ends(key) == (data[: containers.HEAD], data[-containers.TAIL :], len(data))
    assert made_file(40) == signal.wav_bytes(np.zeros(48_000), 8000)
    tracemalloc.start()
    assert containers.duration(*made_ends(60_000)) == 1 + 60_000 / 8
    assert tracemalloc.get_traced_memory()[1] < 1 << 20
    tracemalloc.stop()


def test_kernels_are_dealt_to_all_tasks(spark):
    """A table of one small partition, or one label, doesn't leave the kernels to one task."""
    from conftest import DATA

    from tessitura.plans import q_signal

    note = q_signal.frames(spark, f"{DATA}/sf0.001")
    assert note.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_fast_filters_equal_plain_ones():
    """The bank, the recurrence's responses and all window pairs at a time against one by one."""
    place, near = np.array([0.0, 0.25, 1e-5, 0.999]), np.arange(-23, 25)
    offset = place[:, None] - near[None, :]
    plain = np.sinc(offset * 0.8) * np.cos(offset / 25 * np.pi / 2) ** 2
    assert np.allclose(dsp._bank(place, near, 0.8, 24), plain / plain.sum(axis=1, keepdims=True), atol=1e-10)
    b, a, x = (0.3, 0.2, 0.1), (-0.5, 0.25), np.random.default_rng(5).normal(size=200)
    want, s1, s2 = [], 0.0, 0.0
    for u in x:
        want.append(b[0] * u + s1)
        s1, s2 = b[1] * u - a[0] * want[-1] + s2, b[2] * u - a[1] * want[-1]
    assert np.allclose(dsp.Biquad(b, a)(x), want) and dsp._responses.cache_info().hits + dsp._responses.cache_info().misses
    w = [np.abs(np.random.default_rng(k).normal(size=(108, 12))) for k in range(5)]
    plain = [[signal.aligned_score(p, q)[0] for q in w[2:]] for p in w[:3]]
    assert np.allclose(signal.aligned_scores(w[:3], w[2:]), plain, atol=1e-11)
