"""SentencePiece models on the tokenizers library: encoding and decoding.

The model protobuf is parsed here (wire format only), and normaliser (character map, squeezed spaces, dummy prefix, space
marker), scores or merges and byte fallback are rebuilt for the tokenizers library, which does all encoding, in batches
over its threads. Unigram models get their scores; merge models get one rule for every split of a piece into two pieces,
ranked by the piece's score. Where no piece holds a marker after another letter (checked), the library cuts text before
each run of markers, which changes no result and keeps its words short. Texts of more than ``CHUNK`` characters go in
parts that end at single spaces, so memory stays bounded by one text's ids.

The model file is read on the driver and sent to the executors as bytes (``MAX_MODEL`` at most): executors need no
path. Encoding is one pass without a shuffle. ``parity`` holds ids against those of the sentencepiece library.

Defined cases: null text has null ids, 0 tokens and a true round trip; an empty text has no ids; characters outside the
vocabulary become bytes; a lone surrogate becomes U+FFFD first; round_trip tells whether decoding the ids gives the text
itself, so it is false where the model's normaliser changes the text, where an id stands for unknown letters, and for
texts that hold the marker letter; repeated ids are separate rows; an empty table gives an empty result; other columns are kept. A text that spells the
name of a byte piece in letters that a unigram model doesn't know is taken for that piece.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, tidy

CHUNK, BATCH, MAX_MODEL, THREADS = 400_000, 1 << 20, 64 << 20, 2
MARK = "▁"
#: Before a single space: neither side is another space or a marker.
_SINGLE = re.compile(f"[^ {MARK}](?= [^ {MARK}])")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
DEFAULT_MODEL = "piece_bpe_32k.model"


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message: ints, 4 or 8 raw bytes, or the bytes of a length-delimited field."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = out = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + n]
        at += n


class PieceModel:
    """pieces: (text, score, type) by id; kind: 1 unigram, 2 merges."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.charsmap = 1, False, b""
        self.dummy_prefix = self.escape = self.squeeze = True
        for k, v in _fields(data):
            if k == 1:
                f = dict(_fields(v))
                self.pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif k == 2:
                f = dict(_fields(v))
                self.kind, self.byte_fallback = f.get(3, 1), bool(f.get(35, 0))
            elif k == 3:
                f = dict(_fields(v))
                self.charsmap = f.get(2, b"")
                self.dummy_prefix, self.squeeze, self.escape = bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
        self.unk = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER, UNUSED)}
        found = []
        for piece, score, kind in self.pieces:
            if kind != NORMAL or len(piece) < 2:
                continue
            for cut in range(1, len(piece)):
                a, b = piece[:cut], piece[cut:]
                if a in ids and b in ids:
                    found.append((-score, ids[a], ids[b], a, b))
        return [x[3:] for x in sorted(found)]

    def tokenizer(self):
        """The library's tokenizer."""
        from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

        vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        if self.kind == 2:
            model = models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unk][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        elif self.kind == 1:
            # control, byte and unused pieces never match a text's letters: they score below any path of normal pieces
            low = 8 * min([s for _, s, t in self.pieces if t == NORMAL], default=0.0) - 100
            model = models.Unigram([(p, s if t in (NORMAL, USER, UNKNOWN) else low) for p, s, t in self.pieces], self.unk, self.byte_fallback)
        else:
            raise ValueError(f"model kind {self.kind} has neither scores nor merges")
        t = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if self.escape else " "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        if steps:
            t.normalizer = normalizers.Sequence(steps)
        if self.cuttable():
            t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
        return t

    def cuttable(self) -> bool:
        return self.escape and not any(MARK in p.lstrip(MARK) for p, _, t in self.pieces if t == NORMAL)

    def surface(self) -> list[bytes]:
        """The bytes each id stands for."""
        out = []
        for p, _, t in self.pieces:
            out.append(b"" if t == CONTROL else bytes([int(p[1:-1], 16)]) if t == BYTE else " ⁇ ".encode() if t == UNKNOWN else p.replace(MARK, " ").encode())
        return out


class Codec:
    """Encodes with one library tokenizer and decodes by a table of the bytes that each id stands for."""

    def __init__(self, data: bytes, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = PieceModel(data)
        self.library = self.model.tokenizer()
        self.table = self.model.surface()

    def _parts(self, text: str) -> list[str]:
        """Parts of a long text that encode one after another to what the whole does. They end before a single space, which
        the dummy prefix of the next part stands for, so it is left out where there is one."""
        if len(text) <= CHUNK or not self.model.cuttable():
            return [text]
        out, at = [], 0
        while at < len(text):
            cut = _SINGLE.search(text, at + CHUNK)
            end = cut.start() + 1 if cut else len(text)
            out.append(text[at:end])
            at = end + (1 if cut and self.model.dummy_prefix else 0)
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in a row, the number of ids of each text, and whether decoding gives the text again (null: yes)."""
        parts, of = [], []
        for i, t in enumerate(texts):
            if t:
                found = self._parts(_whole(t))
                parts += found
                of += [i] * len(found)
        ids = [e.ids for e in self.library.encode_batch_fast(parts, add_special_tokens=False)]
        counts, good = np.zeros(len(texts), dtype=np.int64), np.ones(len(texts), dtype=bool)
        np.add.at(counts, np.array(of, dtype=np.int64), np.array([len(x) for x in ids], dtype=np.int64))
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(counts.sum()))
        ends = np.cumsum(counts)
        for i, t in enumerate(texts):
            if t is not None:
                good[i] = self.decode(flat[ends[i] - counts[i] : ends[i]].tolist()) == t
        return flat, counts, good

    def decode(self, ids) -> str | None:
        if ids is None:
            return None
        out = b"".join([self.table[i] for i in ids])
        if self.model.dummy_prefix and out[:1] == b" ":
            out = out[1:]
        return out.decode("utf-8", "replace")


def _whole(text: str) -> str:
    """text with lone surrogates replaced."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


@lru_cache(maxsize=2)
def codec(data: bytes) -> Codec:
    return Codec(data)


def model_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(DEFAULT_MODEL)
    if os.path.getsize(path) > MAX_MODEL:
        raise ValueError(f"{path} is larger than {MAX_MODEL} bytes")
    with open(path, "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, keep: list[str], text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """``keep`` columns, ids array<int>, n_tokens long and round_trip boolean (decoding gives the text again)."""
    lean(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            start, size = 0, 0
            for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_pylist()):
                size += n
                if size >= BATCH or i == batch.num_rows - 1:
                    yield part(c, batch.slice(start, i + 1 - start))
                    start, size = i + 1, 0

    def part(c: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, n, same = c.encode(batch.column("_text").to_pylist())
        ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(flat), mask=pc.is_null(batch.column("_text")))
        cols = [*(batch.column(k) for k in keep), ids, pa.array(n), pa.array(same)]
        return pa.RecordBatch.from_arrays(cols, [*keep, "ids", "n_tokens", "round_trip"])

    schema = docs.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType())).add("n_tokens", "long").add("round_trip", "boolean")
    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(tidy(run), schema)


def decode_ids(df: DataFrame, keep: list[str], ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """``keep`` columns and the decoded text; null ids give null."""
    shared = df.sparkSession.sparkContext.broadcast(model_bytes(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            texts = [c.decode(x.as_py()) for x in batch.column("_ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(texts, pa.string())], [*keep, "text"])

    return df.select(*keep, F.col(ids_col).alias("_ids")).mapInArrow(tidy(run), df.select(*keep).schema.add("text", "string"))


def parity(docs: DataFrame, keep: list[str], text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """``keep`` columns and same: whether the ids of a text equal those of the sentencepiece library (null text: yes)."""
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(model_path))
    lean(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        c, other = codec(shared.value), sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            flat, n, _ = c.encode(texts)
            ids = np.split(flat, np.cumsum(n)[:-1])
            same = [t is None or other.encode(_whole(t)) == i.tolist() for t, i in zip(texts, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(same, pa.bool_())], [*keep, "same"])

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(tidy(run), docs.select(*keep).schema.add("same", "boolean"))
