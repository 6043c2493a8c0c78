"""Data source ``npz``: NumPy archives as tables, and tables as archives.

    spark.dataSource.register(NpzSource)
    spark.read.format("npz").load(path)             # a file, or a folder of *.npz
    df.write.format("npz").mode("append").save(path)

Each member of an archive is a column, its first axis the rows; a member of two axes is an array column. The archive's
directory gives every member's place, so a file is read in stretches of ``rowsPerPartition`` rows, each by offset; members
that are compressed are read by one task a file. Files are reached by pyarrow's file systems (local or shared paths,
s3://, gs://, hdfs://).

Errors, not rows: a file that is no archive, is cut off, has members of different lengths, objects (which would be
unpickled), or other columns than the first file; an archive without members.
"""

from __future__ import annotations

import ast
import struct
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

ROWS, BATCH = 100_000, 4096
_KINDS = {"f4": FloatType(), "f8": DoubleType(), "i4": IntegerType(), "i8": LongType(), "b1": BooleanType()}


def store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(path) if ":/" in path else (pyarrow.fs.LocalFileSystem(), path)


def archives(path: str) -> list[str]:
    fs, at = store(path)
    if fs.get_file_info(at).type == pyarrow.fs.FileType.File:
        return [at]
    found = fs.get_file_info(pyarrow.fs.FileSelector(at, recursive=False))
    return sorted(f.path for f in found if f.type == pyarrow.fs.FileType.File and f.path.endswith(".npz") and not f.base_name.startswith("."))


def delete_hidden(fs: pyarrow.fs.FileSystem, folder: str, name: str, run: str) -> None:
    """Delete the hidden files of one write."""
    for f in fs.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True)):
        if f.base_name.startswith(f".{name}.{run}"):
            fs.delete_file(f.path)


def members(fs: pyarrow.fs.FileSystem, file: str) -> dict[str, tuple]:
    """By name: (dtype, shape, offset of the first row, or None where the member is compressed)."""
    out = {}
    try:
        with fs.open_input_file(file) as f:
            size = f.size()
            with zipfile.ZipFile(f) as z:
                for info in z.infolist():
                    with z.open(info) as m:
                        dtype, shape, head = _header(m)
                    f.seek(info.header_offset)
                    name, extra = struct.unpack("<HH", f.read(30)[26:30])
                    data = info.header_offset + 30 + name + extra + head
                    plain = info.compress_type == zipfile.ZIP_STORED
                    if plain and data + dtype.itemsize * int(np.prod(shape)) > size:
                        raise ValueError(f"member {info.filename} is cut off")
                    out[info.filename.removesuffix(".npy")] = (dtype, shape, data if plain else None)
    except (zipfile.BadZipFile, ValueError, OSError, struct.error) as e:
        raise ValueError(f"damaged archive {file}: {e}") from e
    if not out:
        raise ValueError(f"damaged archive {file}: no member")
    if len({shape[0] for _, shape, _ in out.values()}) > 1:
        raise ValueError(f"damaged archive {file}: members of different lengths")
    return out


def _header(m) -> tuple[np.dtype, tuple, int]:
    """dtype, shape and length of a member's header."""
    magic = m.read(8)
    if magic[:6] != b"\x93NUMPY":
        raise ValueError("no array")
    width = 2 if magic[6] == 1 else 4
    n = int.from_bytes(m.read(width), "little")
    told = ast.literal_eval(m.read(n).decode("latin-1"))
    dtype = np.dtype(told["descr"])
    if dtype.hasobject or told["fortran_order"] and len(told["shape"]) > 1 or not 1 <= len(told["shape"]) <= 2:
        raise ValueError("an array of objects, in column order or not of one or two axes")
    return dtype, told["shape"], 8 + width + n


def _type(dtype: np.dtype, shape: tuple):
    kind = StringType() if dtype.kind == "U" else _KINDS.get(dtype.str[1:])
    if kind is None:
        raise ValueError(f"members of type {dtype} aren't read")
    return ArrayType(kind) if len(shape) == 2 else kind


class Stretch(InputPartition):
    def __init__(self, file: str, first: int, last: int):
        super().__init__((file, first, last))


class NpzReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, rows: int):
        self.path, self.schema, self.rows = path, schema, rows

    def partitions(self) -> list[Stretch]:
        fs, _ = store(self.path)
        out = []
        for file in archives(self.path):
            held = members(fs, file)
            if StructType([StructField(k, _type(d, s)) for k, (d, s, _) in held.items()]) != self.schema:
                raise ValueError(f"archive {file} has other columns than {self.schema.fieldNames()}")
            n = next(iter(held.values()))[1][0]
            step = self.rows if all(at is not None for _, _, at in held.values()) else max(1, n)
            out += [Stretch(file, a, min(n, a + step)) for a in range(0, n, step)]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        file, first, last = partition.value
        fs, _ = store(self.path)
        held = members(fs, file)
        with fs.open_input_file(file) as f:
            whole = {}
            if any(at is None for _, _, at in held.values()):
                with zipfile.ZipFile(f) as z:
                    for k, (dtype, shape, _) in held.items():
                        with z.open(f"{k}.npy") as m:
                            _header(m)
                            whole[k] = np.frombuffer(m.read(), dtype=dtype).reshape(shape)
            for a in range(first, last, BATCH):
                b, cols = min(last, a + BATCH), []
                for k, (dtype, shape, at) in held.items():
                    if k in whole:
                        x = whole[k][a:b]
                    else:
                        row = dtype.itemsize * int(np.prod(shape[1:]))
                        f.seek(at + a * row)
                        x = np.frombuffer(f.read((b - a) * row), dtype=dtype).reshape((b - a, *shape[1:]))
                    x = x.astype(x.dtype.newbyteorder("="))
                    flat = pa.array(x.ravel().tolist(), pa.string()) if dtype.kind == "U" else pa.array(x.ravel())
                    cols.append(flat if x.ndim == 1 else pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1] or 1)[: len(x) + 1] if x.shape[1] else np.zeros(len(x) + 1), pa.int32()), flat))
                yield pa.RecordBatch.from_arrays(cols, names=list(held))


class Written(WriterCommitMessage):
    def __init__(self, file: str):
        self.file = file


class NpzWriter(DataSourceArrowWriter):
    """One archive for each task, of rows that fit its memory; a hidden file until the job commits."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = store(self.path)
        fs.create_dir(at, recursive=True)
        batches = [b for b in iterator if b.num_rows]
        if not batches:
            return Written("")
        t, arrays = pa.Table.from_batches(batches).combine_chunks(), {}
        for name in t.column_names:
            c = t[name].combine_chunks()
            if pa.types.is_list(c.type):
                width = {len(v) if v.is_valid else -1 for v in c}
                if len(width) > 1 or -1 in width:
                    raise ValueError(f"column {name}: an archive holds arrays of one length, and no nulls")
                arrays[name] = c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), width.pop())
            elif c.null_count:
                raise ValueError(f"column {name}: an archive holds no nulls")
            else:
                arrays[name] = np.array(c.to_pylist(), dtype=str) if pa.types.is_string(c.type) else c.to_numpy(zero_copy_only=False)
        file = f"{at}/.part.{self.run}.{uuid.uuid4().hex}.npz"
        with fs.open_output_stream(file) as out:
            np.savez(out, **arrays)
        return Written(file)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = store(self.path)
        fs.create_dir(at, recursive=True)
        if self.overwrite:
            for old in archives(self.path):
                if not old.rpartition("/")[2].startswith("."):
                    fs.delete_file(old)
        for m in messages:
            if m and m.file:
                folder, _, name = m.file.rpartition("/")
                fs.move(m.file, f"{folder}/{name[1:]}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = store(self.path)
        delete_hidden(fs, at, "part", self.run)


class NpzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> StructType:
        path = self.options["path"]
        files = archives(path)
        if not files:
            raise ValueError(f"no archive in {path}")
        return StructType([StructField(k, _type(d, s)) for k, (d, s, _) in members(store(path)[0], files[0]).items()])

    def reader(self, schema: StructType) -> NpzReader:
        return NpzReader(self.options["path"], schema, int(self.options.get("rowsPerPartition", ROWS)))

    def writer(self, schema: StructType, overwrite: bool) -> NpzWriter:
        return NpzWriter(self.options["path"], overwrite)
