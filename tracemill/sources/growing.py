"""Files that grow, as a streaming source: each batch has the lines that were completed since the one before.

``spark.readStream.format("growing_lines").option("path", folder)`` gives path, mtime, at (where in the file a line
begins, in bytes) and raw. The offset holds, for each file, up to where it was read: the end of its last whole line. A line
whose end hasn't come is left for a later batch, or read as it is with the option ``tail``. A file that shrank is read anew.
Files lie on a disk that the driver and all executors mount; one that has grown by much is read by several tasks.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, mtime timestamp, at long, raw string"
#: Bytes that one task reads, and that are looked at in one go for a line's end.
STRETCH, LOOK = 64 << 20, 1 << 16


@dataclass
class Stretch(InputPartition):
    """The lines of a file that begin in [start, end); inside says that a line may be under way at start."""

    path: str
    start: int
    end: int
    inside: bool
    mtime: float


def whole_lines(path: str, size: int) -> int:
    """Where the last line that has an end ends."""
    with open(path, "rb") as f:
        at = size
        while at > 0:
            low = max(0, at - LOOK)
            f.seek(low)
            found = f.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return 0


class GrowingLinesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.tail = options.get("tail", "false").lower() == "true"
        self.stretch = int(options.get("stretch", STRETCH))
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for folder, _, names in os.walk(self.root):
            for name in names:
                if name.endswith(self.suffix):
                    path = os.path.join(folder, name)
                    size = os.stat(path).st_size
                    if self.known.get(path, (None, 0))[0] != size:
                        self.known[path] = (size, size if self.tail else whole_lines(path, size))
                    out[path] = self.known[path][1]
        return out

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for path, upto in sorted(end.items()):
            begun = start.get(path, 0) if start.get(path, 0) <= upto else 0
            mtime = os.stat(path).st_mtime if begun < upto else 0.0
            out += [Stretch(path, a, min(upto, a + self.stretch), a > begun, mtime) for a in range(begun, upto, self.stretch)]
        return out or [Stretch("", 0, 0, False, 0.0)]

    def read(self, stretch: Stretch) -> Iterator[tuple]:
        if not stretch.path:
            return
        mtime = dt.datetime.fromtimestamp(stretch.mtime)
        with open(stretch.path, "rb") as f:
            f.seek(stretch.start - stretch.inside)
            if stretch.inside:
                f.readline()
            while (at := f.tell()) < stretch.end:
                for piece in f.readline().rstrip(b"\n").removesuffix(b"\r").split(b"\r"):  # a bare return ends a line too
                    yield stretch.path, mtime, at, piece.decode("utf-8", "replace")
                    at += len(piece) + 1


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingLinesReader:
        return GrowingLinesReader(self.options)
