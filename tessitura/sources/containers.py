"""SRC-09: durations of audio files from their containers' headers, of which only the first and the last block is read."""

from __future__ import annotations

import struct

HEAD, TAIL = 1 << 16, 1 << 16

# Fixed values of the MPEG audio frame header: kbit/s of layer III by version, and samples a second of version 1.
_RATES_1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
_RATES_2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
_SAMPLES = (44_100, 48_000, 32_000)


def duration(head: bytes, tail: bytes, size: int) -> float:
    """Seconds of a file of ``size`` bytes by its first and last bytes; ValueError for what is no WAV, FLAC, Ogg or MP3 file,
    or is cut off."""
    kinds = ((b"RIFF", _riff), (b"fLaC", _flac), (b"OggS", _ogg))
    read = next((f for magic, f in kinds if head.startswith(magic)), _mpeg)
    try:
        return read(head, tail, size)
    except (struct.error, IndexError, ZeroDivisionError) as e:
        raise ValueError("cut off or damaged header") from e


def _riff(head: bytes, tail: bytes, size: int) -> float:
    at, per_second = 12, 0
    while True:
        kind, n = struct.unpack_from("<4sI", head, at)
        if kind == b"fmt ":
            per_second = struct.unpack_from("<I", head, at + 16)[0]
        if kind == b"data":
            if at + 8 + n > size:
                raise ValueError("WAV data is cut off")
            return n / per_second
        at += 8 + n + n % 2


def _flac(head: bytes, tail: bytes, size: int) -> float:
    if head[4] & 0x7F or size < 42:
        raise ValueError("FLAC without its stream's description")
    packed = int.from_bytes(head[18:26], "big")
    rate, samples = packed >> 44, packed & ((1 << 36) - 1)
    if not samples:
        raise ValueError("FLAC of unknown length")
    return samples / rate


def _ogg(head: bytes, tail: bytes, size: int) -> float:
    body = 27 + head[26]
    start = head[body:]
    if start.startswith(b"\x01vorbis"):
        rate, skip = struct.unpack_from("<I", start, 12)[0], 0
    elif start.startswith(b"OpusHead"):
        rate, skip = 48_000, struct.unpack_from("<H", start, 10)[0]
    else:
        raise ValueError("Ogg stream that is neither Vorbis nor Opus")
    at = tail.rfind(b"OggS")
    if at < 0 or not tail[at + 5] & 4:
        raise ValueError("Ogg stream without its last page")
    return (struct.unpack_from("<q", tail, at + 6)[0] - skip) / rate


def _mpeg(head: bytes, tail: bytes, size: int) -> float:
    at = 0
    if head.startswith(b"ID3"):
        at = 10 + sum((b & 0x7F) << 7 * (3 - i) for i, b in enumerate(head[6:10])) + (10 if head[5] & 0x10 else 0)
    if at + 4 > len(head):
        raise ValueError("MP3 tag beyond the first block")
    word = struct.unpack_from(">I", head, at)[0]
    version, layer, rate, freq = word >> 19 & 3, word >> 17 & 3, word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version == 1 or layer != 1 or rate in (0, 15) or freq == 3:
        raise ValueError("no audio container")
    first = version == 3
    samples, hz = (1152 if first else 576), _SAMPLES[freq] // (1 if first else 2 if version == 2 else 4)
    mono = word >> 6 & 3 == 3
    side = (17 if mono else 32) if first else (9 if mono else 17)
    told = head[at + 4 + side : at + 16 + side]
    if told[:4] in (b"Xing", b"Info") and told[7] & 1:
        return int.from_bytes(told[8:12], "big") * samples / hz
    end = size - (128 if tail[-128:].startswith(b"TAG") else 0)
    kbit = (_RATES_1 if first else _RATES_2)[rate]
    frame = samples // 8 * kbit * 1000 // hz
    if end - at < frame:
        raise ValueError("MP3 frame is cut off")
    return (end - at) * 8 / (1000 * kbit)
