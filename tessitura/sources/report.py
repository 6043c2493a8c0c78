"""Data source ``report``: one CSV file that spreadsheets open, written by many tasks.

    spark.dataSource.register(ReportSource)
    df.write.format("report").mode("overwrite").save(path)

The file begins with a byte order mark and one header; nested cells are JSON with their own characters; rows end with a
carriage return and a line feed. Tasks write hidden parts; the commit puts them together, in the order of the tasks, into
a new file that then takes the old one's place, so a write that fails leaves the old file as it was. Append mode carries
the old rows over and needs the same header. The driver copies bytes in pieces and holds no row.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .npz import delete_hidden, store

MARK, PIECE = b"\xef\xbb\xbf", 1 << 20


def _cell(v):
    plain = lambda x: {k: plain(y) for k, y in x.asDict().items()} if isinstance(x, Row) else {str(k): plain(y) for k, y in x.items()} if isinstance(x, dict) else [plain(y) for y in x] if isinstance(x, (list, tuple)) else x
    return json.dumps(plain(v), ensure_ascii=False, default=str) if isinstance(v, (Row, dict, list, tuple)) else v


def _line(cells: list) -> bytes:
    text = io.StringIO()
    csv.writer(text).writerow(cells)
    return text.getvalue().encode()


class Part(WriterCommitMessage):
    def __init__(self, task: int, file: str):
        self.task, self.file = task, file


class ReportWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.names, self.overwrite, self.run = path, schema.fieldNames(), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, at = store(self.path)
        folder, _, name = at.rpartition("/")
        fs.create_dir(folder, recursive=True)
        file = f"{folder}/.{name}.{self.run}.{context.taskAttemptId()}"
        with fs.open_output_stream(file) as out:
            for row in iterator:
                out.write(_line([_cell(v) for v in row]))
        return Part(context.partitionId(), file)

    def commit(self, messages: list[Part | None]) -> None:
        fs, at = store(self.path)
        header = _line(self.names)
        folder, _, name = at.rpartition("/")
        made = f"{folder}/.{name}.{self.run}"
        old = fs.get_file_info(at).is_file and not self.overwrite
        with fs.open_output_stream(made) as out:
            out.write(MARK + header)
            if old:
                with fs.open_input_stream(at) as f:
                    if f.read(len(MARK + header)) != MARK + header:
                        raise ValueError(f"{self.path} has another header than {self.names}")
                    self._copy(f, out)
            for m in sorted((m for m in messages if m), key=lambda m: m.task):
                with fs.open_input_stream(m.file) as f:
                    self._copy(f, out)
        fs.move(made, at)
        self.abort(messages)

    @staticmethod
    def _copy(source, out) -> None:
        while piece := source.read(PIECE):
            out.write(piece)

    def abort(self, messages: list[Part | None]) -> None:
        """Delete what this write has left, parts of failed tasks too."""
        fs, at = store(self.path)
        delete_hidden(fs, *at.rpartition("/")[::2], self.run)


class ReportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "report"

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["path"], schema, overwrite)


def append_report(df: DataFrame, path: str, key: str) -> None:
    """SNK-06: rows appended to a report, unless one of their keys is there already: then nothing is written."""
    from .readers import csv_table

    spark = df.sparkSession
    spark.dataSource.register(ReportSource)
    fs, at = store(path)
    if fs.get_file_info(at).is_file:
        held = csv_table(spark, path, ", ".join(f"`{c}` string" for c in df.columns)).select(key)
        if not df.select(df[key].cast("string").alias(key)).join(held, key, "left_semi").isEmpty():
            raise ValueError(f"rows of {path} are there already")
    df.write.format("report").mode("append").save(path)
