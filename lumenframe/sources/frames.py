"""A data source of frame files, for batches and streams that resume at their offset.

``spark.dataSource.register(FrameFiles)``, then ``spark.read.format("frame_files").load(folder)`` or ``readStream``. The folder
holds a folder for each source with files named by their frame's number, such as ``gate/000017.jpg``. It must be
mounted on the driver, which lists names, and on the executors, which read the frames; for object stores Spark's
own binary files serve (``sources.tables``). Files whose name holds no number are passed over; empty files are frames
of no bytes; a missing folder is an error.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source string, frame long, file string, size long, content binary"
#: Frames that a task reads, unless the option perTask says otherwise.
PER_TASK = 64


class Frames(InputPartition):
    """Files (source, frame, path) that one task reads."""

    def __init__(self, files: list[tuple[str, int, str]]):
        super().__init__(None)
        self.files = files


def listed(folder: str) -> Iterator[tuple[str, int, str]]:
    """(source, frame, path) of all frame files, in order of source and frame."""
    for source in sorted(e.name for e in os.scandir(folder) if e.is_dir()):
        found = [(int(m[0]), e.path) for e in os.scandir(f"{folder}/{source}") if e.is_file() and not e.name.startswith((".", "_")) and (m := re.search(r"\d+", e.name))]
        yield from ((source, frame, path) for frame, path in sorted(found))


def dealt(files: list[tuple[str, int, str]], size: int) -> list[Frames]:
    return [Frames(files[i : i + size]) for i in range(0, len(files), size)]


def rows(part: Frames | None) -> Iterator[tuple]:
    for source, frame, path in part.files if part else ():  # Spark makes one task of no partitions
        with open(path, "rb") as f:
            content = f.read()
        yield source, frame, path, len(content), content


class FrameReader(DataSourceReader):
    def __init__(self, folder: str, size: int):
        self.folder, self.size = folder, size

    def partitions(self) -> list[Frames]:
        return dealt(list(listed(self.folder)), self.size)

    def read(self, partition: Frames | None) -> Iterator[tuple]:
        return rows(partition)


class FrameStream(DataSourceStreamReader):
    """Offsets are the last frame of each source, so a source may appear at any time; a frame counts once it is newer than its source's last."""

    def __init__(self, folder: str, size: int):
        self.folder, self.size = folder, size

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        last: dict[str, int] = {}
        for source, frame, _ in listed(self.folder):
            last[source] = max(frame, last.get(source, -1))
        return last

    def partitions(self, start: dict, end: dict) -> list[Frames]:
        return dealt([f for f in listed(self.folder) if start.get(f[0], -1) < f[1] <= end.get(f[0], -1)], self.size)

    def read(self, partition: Frames | None) -> Iterator[tuple]:
        return rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing is removed: a failed batch is read again."""


class FrameFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options["path"], int(self.options.get("perTask", PER_TASK)))

    def streamReader(self, schema) -> FrameStream:
        return FrameStream(self.options["path"], int(self.options.get("perTask", PER_TASK)))
