"""A streaming source over text logs that still grow.

The offset of a stream is a byte position for each file, so lines added to a file after a run are
read by the next one. A line counts once its line end is written.
"""

from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "run string, file string, place bigint, line string"
RANGE_BYTES = 32 << 20
READ_BYTES = 1 << 20
BATCH_LINES = 10_000
RANGE_FILES = 500
OPEN_FILES = 16


class LogRanges(InputPartition):
    """(file, first, start, end): the lines that start in [start, end) of each file."""

    def __init__(self, ranges: list):
        self.ranges = ranges


def file_system(path: str) -> tuple:
    """(file system, path there) of a plain path or a URI."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _run_of(file: str) -> str | None:
    """The value of the folder `run=…` that a file is in."""
    for part in reversed(file.split("/")[:-1]):
        if part.startswith("run="):
            return part[4:]
    return None


def line_end(stream, size: int) -> int:
    """The position after the last line end before `size`, looked for from the back; 0 if none."""
    at = size
    while at > 0:
        start = max(0, at - READ_BYTES)
        stream.seek(start)
        found = stream.read(at - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        at = start
    return 0


def lines_of(stream, first: int, start: int, end: int):
    """(place, line) of the lines that start in [start, end); `first` is where a line starts for sure.

    A range begins after the first line end at or after the byte before it, and goes on past its end
    to finish its last line, so that the ranges of a file give each line once.
    """
    place, rest = start, b""
    if start > first:
        place = start - 1
    stream.seek(place)
    skipping = start > first
    at = place
    while place < end:
        block = stream.read(READ_BYTES)
        if not block:
            return
        rest += block
        *lines, rest = rest.split(b"\n")
        for line in lines:
            after = place + len(line) + 1
            if skipping:
                skipping = False
            elif place < end:
                yield place, line.rstrip(b"\r").decode("utf-8", "replace")
            place = after
            if place >= end and not skipping:
                return
        at += len(block)


class LogReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.range_bytes = options["path"], int(options.get("rangeBytes", RANGE_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, root = file_system(self.path)

        def end(info) -> int:
            with system.open_input_file(info.path) as stream:
                return line_end(stream, info.size)

        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        found = [x for x in found if x.type == fs.FileType.File and x.size and not x.base_name.startswith(("_", "."))]
        with ThreadPoolExecutor(OPEN_FILES) as pool:
            ends = list(pool.map(end, found))
        return {info.path: end for info, end in zip(found, ends) if end}

    def partitions(self, start: dict, end: dict) -> list:
        parts, size = [], self.range_bytes
        for file, stop in sorted(end.items()):
            first = start.get(file, 0)
            first = first if first <= stop else 0  # the file was written anew
            edges = [*range(first, stop, self.range_bytes), stop]
            for a, b in zip(edges, edges[1:]):
                if size + b - a > self.range_bytes or len(parts[-1]) == RANGE_FILES:
                    parts.append([])
                    size = 0
                parts[-1].append((file, first, a, b))
                size += b - a
        return [LogRanges(ranges) for ranges in parts]

    def read(self, partition: LogRanges):
        system, _ = file_system(self.path)
        held = []

        def batch():
            runs, files, places, lines = zip(*held)
            columns = [pa.array(runs, pa.string()), pa.array(files), pa.array(places), pa.array(lines)]
            return pa.RecordBatch.from_arrays(columns, names=["run", "file", "place", "line"])

        for file, first, start, end in partition.ranges:
            run = _run_of(file)
            with system.open_input_file(file) as stream:
                for place, line in lines_of(stream, first, start, end):
                    held.append((run, file, place, line))
                    if len(held) == BATCH_LINES:
                        yield batch()
                        held = []
        if held:
            yield batch()

    def commit(self, end: dict) -> None:
        pass


class GrowingLogs(DataSource):
    """`spark.readStream.format("growing_logs").load(folder)`: (run, file, place, line)."""

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options)
