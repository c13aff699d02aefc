"""JSON-lines files as a source with byte offsets: batch splits by byte range, streams that resume where they stopped.

Files are opened through Arrow's file systems, so a path may name any store these know (a local path or a URI such as
file://, hdfs://, s3://, gs://); nothing is assumed to lie on the machine of the driver.
"""

from __future__ import annotations

import fnmatch
import io
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lixivium.functions.ordering import numbered

SPLIT = 16 << 20  # bytes
POSITIONS = 1 << 20  # bytes of a file that one task numbers the lines of


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


def store_of(path: str):
    """The file system a path or URI belongs to, and the path inside it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def open_file(path: str) -> io.BufferedReader:
    store, inside = store_of(path)
    return io.BufferedReader(store.open_input_file(inside), 1 << 20)


def read_range(part: Range) -> Iterator[tuple[str, int, str]]:
    """file, position, text of the lines that begin within the range; each stripped, as readers of such files expect."""
    with open_file(part.path) as f:
        at = part.start
        if at > 0:
            f.seek(at - 1)
            at = at - 1 + len(f.readline())  # the line that began before belongs to the range before
        f.seek(at)
        while at < part.end:
            line = f.readline()
            if not line:
                return
            yield part.path, at, line.decode("utf-8", "replace").strip()
            at += len(line)


def files_of(options: dict) -> list[tuple[str, int]]:
    """Path and size of the file, or of the directory's files that match the pattern; a URI's scheme stays before the path."""
    from pyarrow import fs

    path = options["path"]
    store, inside = store_of(path)
    info = store.get_file_info(inside)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    prefix = path[: len(path) - len(inside.lstrip("/"))] if "://" in path else ""
    pattern = options.get("pathglobfilter", "*.jsonl")
    found = [i for i in store.get_file_info(fs.FileSelector(inside)) if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, pattern)]
    return sorted((prefix + i.path.lstrip("/") if prefix else i.path, i.size) for i in found)


def ranges(path: str, start: int, end: int, step: int) -> list[InputPartition]:
    return [Range(path, a, min(a + step, end)) for a in range(start, end, step)]


class LinesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        step = int(self.options.get("splitbytes", SPLIT))
        return [r for p, n in files_of(self.options) for r in ranges(p, 0, n, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return read_range(partition)


class LinesStream(DataSourceStreamReader):
    """Offsets are {file: bytes read}, one entry a file, kept by the stream's checkpoint. Files that appear or grow are read from
    where they were left, in ranges of splitBytes. A last line without an end is taken as still being written and is left for
    later, unless the option finished says that the files grow no more."""

    def __init__(self, options: dict) -> None:
        self.options = options
        self.step = int(options.get("splitbytes", SPLIT))
        self.finished = options.get("finished", "false").lower() == "true"

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {p: n if self.finished else self._whole(p, n) for p, n in files_of(self.options)}

    @staticmethod
    def _whole(path: str, size: int) -> int:
        """The size up to the last line end."""
        with open_file(path) as f:
            at = size
            while at > 0:
                step = min(at, 65536)
                f.seek(at - step)
                block = f.read(step)
                if (i := block.rfind(b"\n")) >= 0:
                    return at - step + i + 1
                at -= step
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [r for p, n in end.items() for r in ranges(p, start.get(p, 0), n, self.step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return read_range(partition)


class JsonLines(DataSource):
    """format("jsonlines"): file string, position bigint, text string. Options: path, pathGlobFilter, splitBytes, finished."""

    @classmethod
    def name(cls) -> str:
        return "jsonlines"

    def schema(self) -> str:
        return "file string, position bigint, text string"

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema) -> LinesReader:
        return LinesReader(self._options())

    def streamReader(self, schema) -> LinesStream:
        return LinesStream(self._options())


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """lines (file, position, ...) with line_number, from 0 in each file; a file of any size is many tasks."""
    rows = numbered(lines, F.expr(f"position div {POSITIONS}"), F.col("position"), within=["file"], name="line_number")
    return rows.withColumn("line_number", F.col("line_number").cast("bigint") - 1)


def look_up(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """The lines (file, line_number, ...) named by wanted (file, line_number); a line that is wanted twice comes once."""
    return lines.join(wanted.select("file", "line_number").distinct(), ["file", "line_number"], "left_semi")


def after(lines: DataFrame, offsets: DataFrame) -> DataFrame:
    """The lines (file, position, ...) that offsets (file, position: the first byte not read) leave to be read; all of a file it doesn't name."""
    left = offsets.groupBy("file").agg(F.max("position").alias("_from"))
    return lines.join(left, "file", "left").where(F.col("position") >= F.coalesce("_from", F.lit(0))).drop("_from")
