"""Word shingles of whole texts as 64-bit hashes, computed on Arrow buffers with array operations.

Words are maximal runs of anything but ASCII white space after lower-casing A-Z. A word's hash is a polynomial over
mixed byte codes (wrapping 64-bit arithmetic, so prefix sums give every word at once), a shingle's hash mixes its words'
in order; both include their length. Work is done on pieces of about ``PIECE`` bytes that end at white space or at a
text's end, so memory doesn't follow the length of a text but for 8 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_UNBASE = pow(_BASE, -1, 1 << 64)
_LENGTH, _COUNT = U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)
_PLACE = np.array([0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165,
                   0x2F2F2F2B5C0B9A11, 0x9C6E6877736C46E3, 0x4CF5AD432745937F, 0x52DCE729DA3ED0A7, 0x38495AB5B1A29C45], dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on all."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_CODE = mix((np.arange(256) + 32 * ((np.arange(256) >= 65) & (np.arange(256) <= 90))).astype(U) + U(1))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        p = np.full(max(n, PIECE + 4096), base, dtype=U)
        p[0] = 1
        _powers[base] = np.cumprod(p, dtype=U)
    return _powers[base][:n]


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges that end at a text's end or after white space."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = at + PIECE
        if to >= end:
            to = end
        else:
            k = int(np.searchsorted(offsets, to, side="right")) - 1  # the last text that begins at or before `to`
            if offsets[k] > at:
                to = int(offsets[k])
            else:  # one text longer than a piece
                stop, to0 = int(offsets[k + 1]), to
                while to < stop and not _SPACE[data[to - 1]]:
                    gap = np.flatnonzero(_SPACE[data[to : min(stop, to + 65536)]])
                    to = to + int(gap[0]) + 1 if len(gap) else min(stop, to + 65536)
                to = max(to, to0)
        yield at, to
        at = to


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of every text); null is a text without words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    raw = texts.buffers()[2] if n else None
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    hashes, owners = [np.zeros(0, dtype=U)], [np.zeros(0, dtype=np.int64)]
    for a, b in _pieces(data, offsets):
        piece = data[a:b]
        inside = ~_SPACE[piece]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        lo, hi = np.searchsorted(offsets, [a, b])
        cuts = offsets[lo : hi + 1]
        cuts = cuts[(cuts > a) & (cuts < b)] - a
        first[cuts] = inside[cuts]  # a text's first byte begins a word even right after another text's last
        last[cuts - 1] = inside[cuts - 1]
        start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(len(piece) + 1, dtype=U)
        np.cumsum(_CODE[piece] * _power(_BASE, len(piece)), out=sums[1:])
        h = (sums[stop] - sums[start]) * _power(_UNBASE, len(piece))[start]
        hashes.append(mix(h + (stop - start).astype(U) * _LENGTH))
        owners.append(np.searchsorted(offsets, start + a, side="right") - 1)
    return np.concatenate(hashes), np.bincount(np.concatenate(owners), minlength=n)


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of every text in a row, offsets of the texts)."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    begins = ends - counts
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_ends = np.cumsum(made)
    out = np.zeros(int(out_ends[-1]) if len(out_ends) else 0, dtype=U)
    long = counts >= width
    at = np.arange(int(made[long].sum())) - np.repeat(np.cumsum(made[long]) - made[long], made[long]) + np.repeat(begins[long], made[long])
    h = np.full(len(at), width, dtype=U) * _COUNT
    for k in range(width):
        h += words[at + k] * _PLACE[k]
    out[np.repeat(long, made)] = mix(h)
    for i in np.flatnonzero(~long & (counts > 0)):
        w = words[begins[i] : ends[i]]
        out[out_ends[i] - 1] = mix((w * _PLACE[: len(w)]).sum(dtype=U, keepdims=True) + np.full(1, len(w), dtype=U) * _COUNT)[0]
    starts = out_ends - made
    for a, b in zip(starts.tolist(), out_ends.tolist(), strict=True):
        out[a:b].sort()
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = out[1:] != out[:-1]
    keep[starts[made > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], np.concatenate([[0], kept[out_ends]]).astype(np.int64)
