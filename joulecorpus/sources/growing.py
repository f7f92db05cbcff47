"""Files that grow while they are read, as a stream of their finished lines.

The file source of a stream takes a file once and never sees what is appended to it.
This source keeps how far every file has been read: an offset is the size of each file at
the time of listing.  A line belongs to the byte range that holds its line feed, so an
unfinished line waits until its rest has been written, and a large growth is split over
tasks; small growths share one, so that tasks follow the bytes and not the files.  The listing is the driver's only work; lines are read by the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from joulecorpus.sources.byte_ranges import BATCH_BYTES, PIECE, located, opened, pieces

SCHEMA = "file string, at bigint, line string"


def line_begin(file: pa.NativeFile, place: int) -> int:
    """Where the line begins to which the byte at ``place`` belongs."""
    while place > 0:
        back = max(0, place - PIECE)
        found = file.read_at(place - back, back).rfind(b"\n")
        if found >= 0:
            return back + found + 1
        place = back
    return 0


def finished_lines(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """The lines whose line feed lies in ``start`` to ``end``, each with the place where it begins."""
    held: list[bytes] | None = None
    begin = 0
    for at, data in pieces(file, start, end):
        lines = data.split(b"\n")
        if held is None and len(lines) > 1:  # the first line feed of the range: fetch what precedes it
            begin = line_begin(file, start)
            held = [chunk for _, chunk in pieces(file, begin, at)]
        if held is None:
            continue
        for line in lines[:-1]:
            whole = b"".join([*held, line])
            yield begin, whole.removesuffix(b"\r")
            begin, held = begin + len(whole) + 1, []
        held.append(lines[-1])


class GrowingRanges(InputPartition):
    """Ranges of one task: file, start and end of each."""

    def __init__(self, ranges: list[tuple[str, int, int]]) -> None:
        self.ranges = ranges


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"].rstrip("/")
        self.pattern = options.get("pattern", "*")
        self.range_bytes = int(options.get("rangebytes", 64 << 20))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"sizes": {}}

    def latestOffset(self) -> dict:  # noqa: N802
        system, root = located(self.folder)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return {"sizes": {f.base_name: f.size for f in sorted(found, key=lambda f: f.base_name) if f.is_file and self.wanted(f.base_name)}}

    def wanted(self, name: str) -> bool:
        return fnmatch(name, self.pattern) and name[0] not in "._"

    def partitions(self, start: dict, end: dict) -> list[GrowingRanges]:
        out: list[GrowingRanges] = []
        left = 0  # bytes that the last task may still take
        for name, size in end["sizes"].items():
            known = start["sizes"].get(name, 0)
            known = known if known <= size else 0  # a file that was emptied begins anew
            for place in range(known, size, self.range_bytes):
                stop = min(size, place + self.range_bytes)
                if stop - place > left:
                    out.append(GrowingRanges([]))
                    left = self.range_bytes
                out[-1].ranges.append((f"{self.folder}/{name}", place, stop))
                left -= stop - place
        return out

    def read(self, partition: GrowingRanges) -> Iterator[pa.RecordBatch]:
        for path, start, end in partition.ranges:
            with opened(path) as file:
                rows: list[tuple[int, str]] = []
                held = 0
                for at, line in finished_lines(file, start, end):
                    rows.append((at, line.decode("utf-8", "replace")))
                    held += len(line)
                    if held > BATCH_BYTES or len(rows) >= 10_000:
                        yield self.batch(path, rows)
                        rows, held = [], 0
                if rows:
                    yield self.batch(path, rows)

    @staticmethod
    def batch(file: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
        places, lines = zip(*rows)
        return pa.record_batch(
            {
                "file": pa.array([file.rsplit("/", 1)[-1]] * len(rows), pa.string()),
                "at": pa.array(places, pa.int64()),
                "line": pa.array(lines, pa.string()),
            }
        )


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:  # noqa: N802
        return GrowingReader(self.options)


def growing_lines(spark: SparkSession, folder: str, pattern: str = "*", range_bytes: int = 64 << 20) -> DataFrame:
    """A stream of the lines of the files of a folder (``SCHEMA``): name, place of its first byte, text.

    Lines end with LF or CRLF; blank ones are rows.  Each line comes once, also after a restart from a checkpoint.
    A file that has shrunk is read from its beginning; lines written and removed between
    two listings are not seen.  A file renamed within the pattern counts as a new one, so rotated
    logs should leave it.  A file that vanishes before its listed growth was read fails the batch.
    Names that begin with a dot or an underscore are left out, as by other file sources.
    """
    spark.dataSource.register(GrowingLines)
    stream = spark.readStream.format("growing_lines").option("pattern", pattern).option("rangeBytes", range_bytes)
    return stream.load(folder)
