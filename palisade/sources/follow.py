"""Lines of log files with the byte each begins at, read in batch or followed as the files grow.

``log_lines`` is a data source of its own, since the built-in text source neither tells where a line stands nor looks at a file
twice. Files are cut into ranges of bytes that tasks read by themselves; a line belongs to the range it begins in. A line's
place (``position``, and ``seq`` over all files) does not depend on how files are cut or packed into tasks, and numbering needs
no shuffle.

Followed, the source keeps for each file how many bytes of whole lines were read and a hash of its first bytes. Appended lines
come with the next micro-batch, a line without its end waits for it, and a file that became shorter or begins otherwise is
another one and read from its start. All of this is in the query's checkpoint. The state is one entry a file in the folder, so
move rolled files away in time.
"""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Iterator, Sequence
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from palisade.functions.timeparse import strip

SCHEMA = "value string, source_uri string, position bigint, seq bigint"
#: Bytes that a file is recognised by, bytes of one task's range, bytes read at a time, lines of one Arrow batch.
HEAD, RANGE, BLOCK, BATCH = 256, 64 << 20, 1 << 20, 10_000
#: A file's lines are numbered from its place among the files times this.
PLACES = 1 << 43


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, limit: int, first: int):
        #: Lines that begin in [start, end) are read, none beyond ``limit``; ``first`` is the ``seq`` of byte 0.
        self.path, self.start, self.end, self.limit, self.first = path, start, end, limit, first


#: Spark wants one partition at least.
NOTHING = Range("", 0, 0, 0, 0)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else posixpath.abspath(path))


class _Folder:
    """The files of a folder, or a single file, whose names match."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.pattern = options.get("pattern", "*")
        self.range = int(options.get("rangebytes", RANGE))
        if self.range < 1:
            raise ValueError("rangeBytes must be at least 1")

    def files(self) -> list[tuple[str, int]]:
        """Path and size, by path. Names that begin with a dot or underscore are no logs."""
        system, path = _opened(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [(self.path, info.size)]
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        names = ((posixpath.basename(f.path), f) for f in found if f.type == fs.FileType.File)
        return sorted((posixpath.join(self.path, name), f.size) for name, f in names
                      if name[0] not in "._" and fnmatchcase(name, self.pattern))

    def ranges(self, path: str, start: int, end: int, first: int) -> list[Range]:
        return [Range(path, low, min(low + self.range, end), end, first) for low in range(start, end, self.range)]


def _bytes_at(path: str, start: int, size: int) -> bytes:
    system, name = _opened(path)
    with system.open_input_file(name) as f:
        return f.read_at(size, start)


def _whole_lines(path: str, start: int, size: int) -> int:
    """How far the lines from ``start`` on have their ends: one behind the last line feed before ``size``, or ``start``."""
    high = size
    while high > start:
        low = max(start, high - BLOCK)
        at = _bytes_at(path, low, high - low).rfind(b"\n")
        if at >= 0:
            return low + at + 1
        high = low
    return start


def _lines(part: Range) -> Iterator[tuple[int, bytes]]:
    """The lines that begin in the range and where, read a block at a time; none if the file is gone by now."""
    system, name = _opened(part.path)
    if system.get_file_info(name).type != fs.FileType.File:
        return
    with system.open_input_file(name) as f:
        at = part.start
        if at:
            # The line under way at the start belongs to the range before, unless the start is where one begins.
            f.seek(at - 1)
            at = _skip(f, part.limit)
        # The beginning of a line under way, in blocks.
        begun: list[bytes] = []
        f.seek(at)
        read = at
        while at < part.end:
            block = f.read(min(BLOCK, part.limit - read))
            read += len(block)
            if not block:
                if begun:
                    yield at, b"".join(begun)
                return
            *ended, rest = block.split(b"\n")
            for line in ended:
                if at >= part.end:
                    return
                line = b"".join([*begun, line])
                begun = []
                yield at, line
                at += len(line) + 1
            if rest:
                begun.append(rest)


def _skip(f, limit: int) -> int:
    """The place behind the next line feed, or the limit if there is none before it."""
    at = f.tell()
    while at < limit:
        block = f.read(min(BLOCK, limit - at))
        found = block.find(b"\n")
        if not block or found >= 0:
            return at + found + 1 if block else limit
        at += len(block)
    return limit


def _rows(part: Range) -> Iterator[pa.RecordBatch]:
    def batch(values: list[str], places: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(values, pa.string()), pa.array([part.path] * len(values), pa.string()), pa.array(places, pa.int64()),
             pa.array([part.first + p for p in places], pa.int64())], ["value", "source_uri", "position", "seq"])

    values, places, size = [], [], 0
    for at, line in _lines(part) if part.path else ():
        values.append(line.decode("utf-8", "replace").removesuffix("\r"))
        places.append(at)
        size += len(line)
        if len(values) == BATCH or size > 16 * BLOCK:
            yield batch(values, places)
            values, places, size = [], [], 0
    if values:
        yield batch(values, places)


class _Reader(DataSourceReader):
    def __init__(self, folder: _Folder):
        self.folder = folder

    def partitions(self) -> Sequence[Range]:
        return [r for i, (path, size) in enumerate(self.folder.files()) for r in self.folder.ranges(path, 0, size, i * PLACES)] or [NOTHING]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _rows(partition)


class _Follower(DataSourceStreamReader):
    """Offsets map a file's path to ``[bytes of whole lines, length of its head, hash of its head]``."""

    def __init__(self, folder: _Folder, from_end: bool):
        self.folder, self.from_end = folder, from_end

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.from_end else {"files": {}}

    def latestOffset(self) -> dict:
        files = {}
        for path, size in self.folder.files():
            whole = _whole_lines(path, 0, size)
            head = _bytes_at(path, 0, min(HEAD, whole))
            files[path] = [whole, len(head), hashlib.sha256(head).hexdigest()]
        return {"files": files}

    def partitions(self, start: dict, end: dict) -> Sequence[Range]:
        out = []
        for i, (path, (size, *_)) in enumerate(sorted(end["files"].items())):
            done = start["files"].get(path)
            low = done[0] if done and _goes_on(path, done, size) else 0
            out += self.folder.ranges(path, low, size, i * PLACES)
        return out or [NOTHING]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing is removed."""


def _goes_on(path: str, done: list, size: int) -> bool:
    """Whether a file of ``size`` bytes continues what was read of it."""
    read, head, digest = done
    try:
        return size >= read and hashlib.sha256(_bytes_at(path, 0, head)).hexdigest() == digest
    except FileNotFoundError:
        return False


class LogLines(DataSource):
    """Options: ``path`` (a folder or a file on any store that Arrow knows), ``pattern`` of file names, ``rangeBytes`` of a task,
    and for streams ``fromEnd`` to begin with what is appended from now on."""

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Folder(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Follower(_Folder(self.options), self.options.get("fromend", "false").lower() == "true")


def _raw(lines: DataFrame) -> DataFrame:
    return lines.selectExpr(f"{strip('value')} AS raw", "source_uri", "cast(position AS string) AS position", "seq").where(F.col("raw") != "")


def read_lines_at(spark: SparkSession, path: str, pattern: str = "*", range_bytes: int = RANGE) -> DataFrame:
    """Stripped non-blank lines of all files, each with its file, the byte it begins at (``position``), and ``seq``: the order of
    files by name and of lines within them. The last line of a file needs no end."""
    spark.dataSource.register(LogLines)
    return _raw(spark.read.format("log_lines").option("pattern", pattern).option("rangeBytes", range_bytes).load(path))


def follow_lines_at(spark: SparkSession, path: str, pattern: str = "*", from_end: bool = False, range_bytes: int = RANGE) -> DataFrame:
    """The same lines as a stream that goes on as files grow. ``seq`` orders the lines of one micro-batch."""
    spark.dataSource.register(LogLines)
    reader = spark.readStream.format("log_lines").option("pattern", pattern).option("rangeBytes", range_bytes)
    return _raw(reader.option("fromEnd", str(from_end).lower()).load(path))
