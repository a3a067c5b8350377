"""Change files that other machines append to, read from where the last read stopped.

``spark.readStream.format("appended_lines")`` gives each whole line once: ``file``, ``position`` (its first byte), ``value``. Offsets are bytes by file, which
Spark keeps in the stream's checkpoint; a line that is still being written waits for the next read, and so does nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes that are looked through at once, and bytes of a task.
STEP, TASK_BYTES = 1 << 16, 1 << 26


@dataclass
class Stretch(InputPartition):
    """The lines of a file that begin from ``start`` on and before ``end``; ``first`` if ``start`` begins a line."""

    file: str
    start: int
    end: int
    first: bool


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def whole_lines_end(path: str, since: int, size: int) -> int:
    """The byte after the last line break between ``since`` and ``size``; ``since`` without one. Looks back from the end."""
    store, place = opened(path)
    with store.open_input_file(place) as f:
        end = size
        while end > since:
            start = max(since, end - STEP)
            f.seek(start)
            found = f.read(end - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            end = start
    return since


def lines_of(part: Stretch) -> Iterator[tuple[str, int, str]]:
    """Lines of a stretch, without breaks and empty ones. What isn't UTF-8 is damaged and left out."""
    store, place = opened(part.file)
    with store.open_input_file(place) as f:
        at = part.start if part.first else part.start - 1  # a break right before makes it the first byte of a line
        f.seek(at)
        skipping, rest = not part.first, b""
        while at < part.end or rest or skipping:
            more = f.read(STEP)
            pieces = (rest + more).split(b"\n")
            begins = at
            rest = pieces.pop()
            for piece in pieces:
                if skipping:
                    skipping = False
                elif begins >= part.end:
                    return
                elif piece.strip():
                    try:
                        yield part.file, begins, piece.rstrip(b"\r").decode("utf-8")
                    except UnicodeDecodeError:
                        pass
                begins += len(piece) + 1
            at = begins
            if not more or (at >= part.end and not skipping):
                return


class _Lines:
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.ending = options["path"].rstrip("/"), options.get("ending", ".jsonl")
        self.task_bytes, self.known = int(options.get("task_bytes", TASK_BYTES)), {}

    def ends(self) -> dict[str, int]:
        """The end of the whole lines of each file, by name."""
        store, place = opened(self.folder)
        for info in store.get_file_info(fs.FileSelector(place, allow_not_found=True)):
            if info.type == fs.FileType.File and info.base_name.endswith(self.ending) and not info.base_name.startswith((".", "_")):
                self.known[info.base_name] = whole_lines_end(f"{self.folder}/{info.base_name}", self.known.get(info.base_name, 0), info.size)
        return dict(self.known)

    def between(self, start: dict[str, int], end: dict[str, int]) -> list[Stretch]:
        out = []
        for name in sorted(end):
            begin = start.get(name, 0)
            out += [Stretch(f"{self.folder}/{name}", a, min(a + self.task_bytes, end[name]), a == begin) for a in range(begin, end[name], self.task_bytes)]
        return out


class _StreamReader(_Lines, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.ends()

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return self.between(start, end)

    def read(self, partition: Stretch) -> Iterator[tuple[str, int, str]]:
        return lines_of(partition)

    def commit(self, end: dict) -> None:
        """Spark keeps the offsets."""


class _BatchReader(_Lines, DataSourceReader):
    def partitions(self) -> list[Stretch]:
        return self.between({}, self.ends()) or [Stretch(self.folder, 0, 0, True)]

    def read(self, partition: Stretch) -> Iterator[tuple[str, int, str]]:
        return lines_of(partition) if partition.end > partition.start else iter(())


class AppendedLines(DataSource):
    """Options: ``path`` (a folder), ``ending`` of the files' names (``.jsonl``), ``task_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "file string, position long, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _BatchReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AppendedLines)
