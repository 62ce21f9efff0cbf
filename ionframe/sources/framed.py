"""A sink for text files with a beginning and an end around many lines: ``df.write.format("framed_text")``.

Every task writes its lines to a part of its own beside the target. When all have, the commit puts the parts in the order
of their partitions between ``header`` and ``trailer`` into one file, block by block, under another name, and renames it at
the end; a job that fails, or a task that runs twice, leaves no trace in the target. Rows keep the order that the plan
gives them: a sorted frame comes out sorted, any other is not shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

BLOCK = 8 << 20


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str
    rows: int


class FramedText(DataSource):
    """Options: ``path``, ``header`` and ``trailer``. The frame has one string column."""

    @classmethod
    def name(cls) -> str:
        return "framed_text"

    def writer(self, schema: StructType, overwrite: bool) -> FramedWriter:
        if len(schema) != 1:
            raise ValueError("framed_text writes one column")
        return FramedWriter(self.options["path"], self.options.get("header", ""), self.options.get("trailer", ""), overwrite)


class FramedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, header: str, trailer: str, overwrite: bool):
        self.path, self.header, self.trailer, self.overwrite = path, header, trailer, overwrite
        self.work = f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        task = TaskContext.get()
        system, work = opened(self.work)
        system.create_dir(work, recursive=True)
        target, rows = f"{work}/{task.partitionId():06d}-{task.attemptNumber()}-{task.taskAttemptId()}", 0
        with system.open_output_stream(target) as out:
            for batch in iterator:
                lines = batch.column(0).drop_null()
                if len(lines):
                    out.write(("\n".join(lines.to_pylist()) + "\n").encode())
                    rows += len(lines)
        return Part(task.partitionId(), target, rows)

    def commit(self, messages: list[Part | None]) -> None:
        system, path = opened(self.path)
        _, work = opened(self.work)
        if not self.overwrite and system.get_file_info(path).is_file:
            self.abort(messages)
            raise FileExistsError(path)
        system.create_dir(work, recursive=True)
        whole = f"{work}/whole"
        with system.open_output_stream(whole) as out:
            out.write(f"{self.header}\n".encode() if self.header else b"")
            for part in sorted((m for m in messages if m is not None), key=lambda m: m.number):
                with system.open_input_stream(part.path) as given:
                    while block := given.read(BLOCK):
                        out.write(block)
            out.write(f"{self.trailer}\n".encode() if self.trailer else b"")
        system.move(whole, path)
        system.delete_dir(work)

    def abort(self, messages: list[Part | None]) -> None:
        system, work = opened(self.work)
        if system.get_file_info(work).type.name == "Directory":
            system.delete_dir(work)


def write_framed(lines: DataFrame, path: str, header: str, trailer: str) -> None:
    """One text file of the lines (one column) between a header and a trailer; a file of that name is replaced."""
    lines.sparkSession.dataSource.register(FramedText)
    lines.write.format("framed_text").mode("overwrite").option("path", path).option("header", header).option("trailer", trailer).save()
