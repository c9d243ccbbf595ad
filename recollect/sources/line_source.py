"""A data source of text lines by byte ranges: ``spark.read.format("text_ranges")`` and ``spark.readStream``.

A file is cut into ranges of ``rangebytes`` bytes, and a task reads one of them or, where they are small against all that is
read, several; a line belongs to the range in which it begins, and is numbered within it. Rows are (source, block, inside, value): the file, the byte at which the range begins,
the line's number in the range, and the line. Lines end with a line feed, with or without a carriage return before it;
bytes that aren't UTF-8 are replaced.

As a stream, an offset is the size up to which each file has been read; a batch takes files to their last line feed, so a
line that is still being written is read when it is whole. Files only grow; one that has shrunk is an error. Paths are
whatever pyarrow's file systems open (local and shared mounts, hdfs, s3, gs), by option ``path``, with ``pattern`` for the
names of files.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator, Sequence
from itertools import chain

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window

SCHEMA = "source string, block long, inside long, value string"
RANGE_BYTES, TAIL, PIECE, TASKS = 32 << 20, 1 << 16, 1 << 20, 64


class _Range(InputPartition):
    def __init__(self, source: str, begin: int, end: int, size: int):
        """The lines that begin in [begin, end) of a file of which ``size`` bytes count."""
        self.source, self.begin, self.end, self.size = source, begin, end, size


class _Ranges(InputPartition):
    def __init__(self, ranges: list[_Range]):
        """The ranges of a task."""
        self.ranges = ranges


def _packed(ranges: list[_Range]) -> list[_Ranges]:
    """The ranges in their order, dealt to tasks: a task takes a ``TASKS``th of all bytes, of ``RANGE_BYTES`` at most, or one range."""
    most, out, held = min(RANGE_BYTES, sum(r.end - r.begin for r in ranges) // TASKS), [], 0
    for own in ranges:
        if not out or held + own.end - own.begin > most:
            out.append(_Ranges([]))
            held = 0
        out[-1].ranges.append(own)
        held += own.end - own.begin
    return out


def _open(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _pieces(file, at: int, end: int, size: int) -> Iterator[bytes]:
    """A file's bytes from ``at``: up to the end of the range, and then, while more is asked for, in growing pieces."""
    file.seek(at)
    beyond = min(TAIL, PIECE)
    while at < size:
        data = file.read(min(PIECE, end - at if at < end else beyond, size - at))
        if not data:
            return
        beyond = beyond if at < end else min(2 * beyond, PIECE)
        at += len(data)
        yield data


def lines(own: _Range) -> Iterator[tuple]:
    """The rows of a range."""
    system, path = _open(own.source)
    with system.open_input_file(path) as file:
        # a line that begins before the range belongs to the one before: go on behind its end
        place, skipping, held, number = max(own.begin - 1, 0), own.begin > 0, b"", 0
        for data in _pieces(file, place, own.end, own.size):
            if skipping:
                cut = data.find(b"\n")
                if cut < 0:
                    place += len(data)
                    continue
                data, place, skipping = data[cut + 1 :], place + cut + 1, False
            held += data
            *whole, held = held.split(b"\n")
            for line in whole:
                if place >= own.end:
                    return
                yield own.source, own.begin, number, line.removesuffix(b"\r").decode(errors="replace")
                place, number = place + len(line) + 1, number + 1
        if held and not skipping and place < own.end:
            yield own.source, own.begin, number, held.removesuffix(b"\r").decode(errors="replace")


class _Folder:
    def __init__(self, options: dict):
        self.path, self.pattern, self.size = options["path"], options.get("pattern", "*"), int(options.get("rangebytes", RANGE_BYTES))
        if self.size < 1:
            raise ValueError("rangebytes is a positive number")

    def sizes(self) -> dict[str, int]:
        system, path = _open(self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        shown = lambda p: not any(part.startswith((".", "_")) for part in p[len(path) :].split("/"))
        return {prefix + f.path: f.size for f in found if f.type == fs.FileType.File and shown(f.path) and fnmatch.fnmatch(f.base_name, self.pattern)}

    def ranges(self, begin: dict[str, int], end: dict[str, int]) -> list[_Range]:
        out = []
        for source, size in sorted(end.items()):
            for at in range(begin.get(source, 0), size, self.size):
                out.append(_Range(source, at, min(at + self.size, size), size))
        return out


class _Reader(DataSourceReader):
    def __init__(self, folder: _Folder):
        self.folder = folder

    def partitions(self) -> Sequence[InputPartition]:
        return _packed(self.folder.ranges({}, self.folder.sizes())) or [_Ranges([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return chain.from_iterable(map(lines, partition.ranges))


class _StreamReader(DataSourceStreamReader):
    def __init__(self, folder: _Folder):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps({source: self._whole(source, size) for source, size in sorted(self.folder.sizes().items())})}

    def _whole(self, source: str, size: int) -> int:
        """Up to where a file's lines have ended."""
        system, path = _open(source)
        with system.open_input_file(path) as file:
            while size:
                begin = max(0, size - TAIL)
                file.seek(begin)
                cut = file.read(size - begin).rfind(b"\n")
                if cut >= 0:
                    return begin + cut + 1
                size = begin
        return 0

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        if any(after.get(s, 0) < n for s, n in before.items()):
            raise ValueError("a file has shrunk or is gone")
        return _packed(self.folder.ranges(before, after))

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return chain.from_iterable(map(lines, partition.ranges))

    def commit(self, end: dict) -> None:
        pass


class TextRanges(DataSource):
    """Text lines by byte ranges."""

    @classmethod
    def name(cls) -> str:
        return "text_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Folder(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(_Folder(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TextRanges)


def numbered(rows: DataFrame) -> DataFrame:
    """(source, line, value) of a batch of rows: lines numbered from 0 over the ranges of each file."""
    before = F.sum("n").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = rows.groupBy("source", "block").agg(F.count("*").alias("n")).select("source", "block", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(blocks, ["source", "block"]).select("source", (F.col("before") + F.col("inside")).alias("line"), "value")
