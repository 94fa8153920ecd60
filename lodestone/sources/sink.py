"""A sink of files: each row (path string, content binary) becomes one file under a folder, on any file system that Arrow knows (local, HDFS, object stores).

Tasks write into a staging folder of the job, under a name of their own attempt; what they report is only a list. When all have ended, the job lists its moves in one file and makes them, so a file is seen whole or not at all under its name. A
task that is killed, or runs twice, leaves nothing but staged files, which the job deletes at its end or when it fails. If the driver is lost between two moves, `finish_moves` makes the rest.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

STAGING = "_staging"
SCHEMA = "path string, content binary"


def opened(folder: str) -> tuple[FileSystem, str]:
    """A folder's file system and its path there; a bare path is local."""
    return FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def inside(path: str) -> str:
    """A path that stays under the folder, or an error."""
    clean = posixpath.normpath(path)
    if clean.startswith(("/", "..")) or clean in ("", "."):
        raise ValueError(f"not a path under the folder: {path!r}")
    return clean


@dataclass
class Staged(WriterCommitMessage):
    """The files of one task: where they are, and where they go."""

    moves: list[tuple[str, str]]


class FilesWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def _job(self) -> tuple[FileSystem, str, str]:
        fs, base = opened(self.folder)
        return fs, base, f"{base}/{STAGING}/{self.job}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        fs, base, job = self._job()
        attempt = f"{job}/{uuid.uuid4().hex}"
        fs.create_dir(attempt)
        moves = []
        for i, row in enumerate(iterator):
            final = inside(row["path"])
            with fs.open_output_stream(f"{attempt}/{i}") as out:
                out.write(bytes(row["content"] or b""))
            moves.append((f"{attempt}/{i}", f"{base}/{final}"))
        return Staged(moves)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, _, job = self._job()
        moves = [m for message in messages if message for m in message.moves]
        fs.create_dir(job)
        with fs.open_output_stream(f"{job}/moves.json") as out:
            out.write(json.dumps(moves).encode())
        make_moves(fs, moves)
        fs.delete_dir(job)

    def abort(self, messages: list[Staged | None]) -> None:
        fs, _, job = self._job()
        if fs.get_file_info(job).type != FileType.NotFound:
            fs.delete_dir(job)


def make_moves(fs: FileSystem, moves: list[tuple[str, str]]) -> None:
    """Give staged files their names; those that have them already are passed over."""
    for folder in {posixpath.dirname(final) for _, final in moves}:
        fs.create_dir(folder)
    for staged, final in moves:
        if fs.get_file_info(staged).type == FileType.File:
            fs.move(staged, final)


def finish_moves(folder: str) -> int:
    """Make what is left of the moves of jobs whose driver was lost while it made them, and delete what jobs have staged that never got there; returns how many jobs. For when no job is writing."""
    fs, base = opened(folder)
    jobs = [i.path for i in fs.get_file_info(FileSelector(f"{base}/{STAGING}", allow_not_found=True))]
    for job in jobs:
        if fs.get_file_info(f"{job}/moves.json").type == FileType.File:
            with fs.open_input_stream(f"{job}/moves.json") as f:
                make_moves(fs, [tuple(m) for m in json.loads(f.read())])
        fs.delete_dir(job)
    return len(jobs)


class FilesSource(DataSource):
    """`df.write.format("lodestone_files").mode("append").save(folder)` for frames with path and content."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        if overwrite:
            raise ValueError("files are added or replaced one by one; a folder is not overwritten")
        return FilesWriter(self.options["path"])


def write_files(files: DataFrame, folder: str) -> None:
    """Write rows (path, content) as files, all or none. Paths should be distinct: of two files with one path either may stay."""
    spark: SparkSession = files.sparkSession
    spark.dataSource.register(FilesSource)
    files.select("path", "content").write.format(FilesSource.name()).mode("append").save(folder)
