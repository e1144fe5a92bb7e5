"""Transcript files that grow, as a stream of their appended lines.

A file source takes every path once and never sees what is appended later. This source remembers how
far each file has been read: an offset is the end of the last whole line of every file, and a
micro-batch reads what lies between two offsets, a file in ranges of bounded size.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "session_id string, path string, start long, size_before long, size_now long, raw string"
#: Bytes of a file that one task reads; a line is read by the task in whose range it begins.
RANGE_BYTES = 64 << 20
_STEP = 1 << 16


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def listed(folder: str, suffix: str = ".jsonl") -> list[fs.FileInfo]:
    """The files below a folder that end so, in order of their paths."""
    system, place = opened(folder)
    found = system.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True))
    return sorted((f for f in found if f.is_file and f.path.endswith(suffix)), key=lambda f: f.path)


def last_line_end(system: fs.FileSystem, path: str, size: int, least: int = 0) -> int:
    """The place after the last line end at or before `size`; `least` if there is none after it."""
    with system.open_input_file(path) as file:
        end = size
        while end > least:
            start = max(least, end - _STEP)
            at = file.read_at(end - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return least


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, before: int, now: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end, self.before, self.now = path, start, end, before, now


class TranscriptReader(DataSourceStreamReader):
    def __init__(self, folder: str, range_bytes: int):
        self.folder, self.range_bytes = folder, range_bytes
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The end of the last whole line of each file; a file that shrinks keeps the greatest it had."""
        system, _ = opened(self.folder)
        for file in listed(self.folder):
            had = self.seen.get(file.path, 0)
            if file.size > had:
                self.seen[file.path] = last_line_end(system, file.path, file.size, had)
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path, stop in end.items():
            begin = start.get(path, 0)
            out += [_Range(path, at, min(at + self.range_bytes, stop), begin, stop) for at in range(begin, stop, self.range_bytes)]
        return out

    def read(self, part: InputPartition) -> Iterator[tuple]:
        system, _ = opened(self.folder)
        session = os.path.basename(part.path).removesuffix(".jsonl")
        with system.open_input_stream(part.path) as file:
            # a line that begins before the range belongs to the range before
            at = part.start - 1 if part.start > part.before else part.start
            file.seek(at) if file.seekable() else file.read(at)
            data = b""
            if at < part.start:
                data, at = self._skip(file, at)
            while at < part.end:
                cut = data.find(b"\n")
                if cut < 0:
                    more = file.read(_STEP)
                    if not more:
                        return
                    data += more
                    continue
                line, data = data[:cut], data[cut + 1 :]
                if line.strip():
                    yield session, part.path, at, part.before, part.now, line.decode("utf-8", "replace").strip()
                at += cut + 1

    @staticmethod
    def _skip(file, at: int) -> tuple[bytes, int]:
        while True:
            more = file.read(_STEP)
            cut = more.find(b"\n")
            if cut >= 0 or not more:
                return more[cut + 1 :], at + cut + 1
            at += len(more)


class Transcripts(DataSource):
    """Options: path (the folder), range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "skein_transcripts"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TranscriptReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


def stream(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The whole lines of the *.jsonl files below a folder, and those appended to them later.

    Rows: session_id, path, start (the line's first byte), size_before and size_now (bytes of the
    file at the last offset and at this one), raw. Offsets hold one number a file.
    """
    spark.dataSource.register(Transcripts)
    return spark.readStream.format("skein_transcripts").option("path", folder).option("range_bytes", str(range_bytes)).load()
