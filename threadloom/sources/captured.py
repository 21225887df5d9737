"""Captured event streams in files, as a data source: split into events at blank lines, in batch and as a stream.

The driver lists files and their lengths, and reads the end of each to find its last blank line; events are read
in tasks, a range of bytes of one file each. A stream goes on in a file where it stopped, so files may grow; an event
whose blank line has not been written yet waits. Paths go through Arrow's file systems (file, hdfs, s3, gs).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from threadloom.sources.events import event_columns

SCHEMA = "file string, at bigint, raw string"
BLANK = re.compile(rb"\r?\n\r?\n")
#: Bytes read at a time, and of one task.
STEP, SPAN = 1 << 20, 64 << 20


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    #: Whether the last event may lack its blank line.
    whole: bool


def files(folder: str) -> dict[str, int]:
    """Lengths of the files below a folder, or of one file; names with a leading dot or underscore are left out."""
    source, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    found = source.get_file_info(path)
    if found.type == fs.FileType.NotFound:
        return {}
    infos = [found] if found.is_file else source.get_file_info(fs.FileSelector(path, recursive=True))
    return {i.path: i.size for i in infos if i.is_file and not i.base_name.startswith((".", "_"))}


def opened(folder: str, path: str):
    source = fs.FileSystem.from_uri(folder)[0] if "://" in folder or folder.startswith("file:") else fs.LocalFileSystem()
    return source.open_input_file(path)


def last_blank(folder: str, path: str, start: int, size: int) -> int:
    """Where the last event that has its blank line ends; start if there is none behind it. Reads from the end on."""
    high, tail = size, b""
    with opened(folder, path) as f:
        while high > start:
            low = max(start, high - STEP)
            f.seek(low)
            tail = f.read(high - low) + tail[:3]
            ends = [m.end() for m in BLANK.finditer(tail)]
            if ends:
                return low + ends[-1]
            high = low
    return start


def events(folder: str, part: Range) -> Iterator[tuple[str, int, str]]:
    """(file, at, raw) of the events that begin in [start, end): an event begins at the file's start or behind a blank line.

    A range that begins within an event leaves that to the range before, which reads on to its end.
    """
    with opened(folder, part.path) as f:
        size = f.size()
        at = part.start
        if at > 0:  # the first beginning at or after start: a blank line may end right there
            f.seek(max(at - 4, 0))
            held, base = b"", max(at - 4, 0)
            while True:
                more = f.read(STEP)
                held += more
                found = next((m.end() for m in BLANK.finditer(held) if base + m.end() >= at), None)
                if found is not None or not more:
                    break
            if found is None:
                return
            at = base + found
        f.seek(at)
        held = b""
        while at < part.end:
            m = BLANK.search(held)
            while m is None:
                more = f.read(STEP)
                if not more:
                    break
                seen = max(len(held) - 3, 0)
                held += more
                m = BLANK.search(held, seen)
            raw = held[: m.start()] if m else held
            if raw.strip() and (m or part.whole):
                yield part.path, at, raw.decode("utf-8", "replace").replace("\r\n", "\n")
            if m is None:
                return
            at, held = at + m.end(), held[m.end() :]
            if at >= size:
                return


def ranges(path: str, start: int, end: int, whole: bool) -> list[Range]:
    return [Range(path, low, min(low + SPAN, end), whole) for low in range(start, end, SPAN)]


class Captured(DataSource):
    """spark.read.format("captured_events").load(folder), and readStream."""

    @classmethod
    def name(cls) -> str:
        return "captured_events"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Whole(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Growing(self.options["path"])


class Whole(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Range]:
        return [r for path, size in sorted(files(self.folder).items()) for r in ranges(path, 0, size, True)] or [Range("", 0, 0, True)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return events(self.folder, partition) if partition.path else iter(())


class Growing(DataSourceStreamReader):
    """Offsets are lengths of files up to their last blank line."""

    def __init__(self, folder: str):
        self.folder = folder
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for path, size in files(self.folder).items():
            done = self.known.get(path, 0)
            if size > done:
                self.known[path] = last_blank(self.folder, path, done, size)
        return {p: n for p, n in sorted(self.known.items()) if n}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [r for path, n in end.items() for r in ranges(path, start.get(path, 0), n, False)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return events(self.folder, partition)

    def commit(self, end: dict) -> None:
        pass


def read_events(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """(stream_id, seq, event, data, type, fields) as event_rows gives them: a file is a stream, seq the byte at which an event begins."""
    spark.dataSource.register(Captured)
    rows = (spark.readStream if stream else spark.read).format("captured_events").load(folder)
    return event_columns(rows.withColumnsRenamed({"file": "stream_id", "at": "seq"}))
