"""Byte ranges of files whose records need what came before, and the state in which each range begins.

A quoted CSV file or one JSON document cannot be cut at line ends.  A range is therefore
summarised as a function of the state it may begin in (inside quotes or not, after a
backslash, how deep); the functions of a file's ranges are composed in order, which gives
every range its true state.  A second pass then reads the ranges independently: a record
belongs to the range that holds its first byte, and is read past the range's end.  Texts are never
shuffled, only one small row per range; memory is bounded by one piece and one record.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_BYTES = 64 << 20
PIECE = 1 << 20
BATCH_BYTES = 8 << 20
_QUOTE, _LF, _SLASH = ord('"'), ord("\n"), ord("\\")
_COMPRESSED = r"(?i)\.(gz|bz2|zst|snappy|lz4|deflate|xz|zip)$"

# A range's effect: for every state it may begin in, the state at its end and the change of depth.
Effect = list[tuple[int, int]]


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the name in it of a path as Spark writes it."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(quote(path.replace("s3a://", "s3://", 1), safe="/:@?=&"))


def opened(path: str) -> pa.NativeFile:
    system, name = located(path)
    return system.open_input_file(name)


def pieces(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Consecutive pieces of ``start`` to ``end`` with their places."""
    while start < end:
        data = file.read_at(min(PIECE, end - start), start)
        if not data:
            return
        yield start, data
        start += len(data)


def compose(first: Effect, then: Effect) -> Effect:
    """The effect of two neighbouring ranges."""
    return [(then[state][0], depth + then[state][1]) for state, depth in first]


class QuotedCsv:
    """States: 0 outside quotes, 1 inside.  A doubled quote leaves and enters again."""

    @staticmethod
    def effect(data: bytes) -> Effect:
        odd = data.count(b'"') & 1
        return [(odd, 0), (1 - odd, 0)]

    @staticmethod
    def records(file: pa.NativeFile, size: int, start: int, end: int, state: int, depth: int, first: int) -> Iterator[bytes]:
        """The records that begin in the range, without their line ends."""
        held: list[bytes] = []
        ours = start == 0 or (state == 0 and file.read_at(1, start - 1) == b"\n")
        for at, data in pieces(file, start, size):
            if not ours and at >= end:
                return
            codes = np.frombuffer(data, np.uint8)
            inside = (np.cumsum(codes == _QUOTE) + state) & 1
            begin = 0
            for cut in np.flatnonzero((codes == _LF) & (inside == 0)).tolist():
                if ours:
                    yield b"".join([*held, data[begin:cut]]).removesuffix(b"\r")
                if at + cut + 1 >= end:
                    return
                ours, held, begin = True, [], cut + 1
            if ours:
                held.append(data[begin:])
            state = int(inside[-1])
        if ours and any(held):
            yield b"".join(held).removesuffix(b"\r")

    @staticmethod
    def finished(state: int, depth: int) -> bool:
        return state == 0


class JsonDocument:
    """States: 0 outside strings, 1 inside, 2 inside and after a backslash that escapes the next byte."""

    @staticmethod
    def scan(codes: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """Whether each byte lies inside a string (the opening quote does), and the state at the end."""
        quotes = codes == _QUOTE
        slash, tail = codes == _SLASH, 0
        if state == 2 or slash.any():
            at = np.arange(len(codes))
            last = np.maximum.accumulate(np.where(slash, -1, at))
            run = at - last + ((last < 0) & (state == 2))
            quotes &= np.concatenate([[int(state == 2)], run[:-1]]) % 2 == 0
            tail = int(run[-1]) % 2 if slash[-1] else 0
        inside = ((np.cumsum(quotes) + (state > 0)) & 1).astype(bool)
        return inside, (2 if tail else 1) if inside[-1] else 0

    @staticmethod
    def steps(codes: np.ndarray) -> np.ndarray:
        return np.isin(codes, (ord("{"), ord("["))).astype(np.int64) - np.isin(codes, (ord("}"), ord("]")))

    @classmethod
    def effect(cls, data: bytes) -> Effect:
        codes = np.frombuffer(data, np.uint8)
        steps = cls.steps(codes)
        seen = [cls.scan(codes, state) for state in (0, 1, 2)]
        return [(end, int(steps[~inside].sum())) for inside, end in seen]

    @classmethod
    def records(cls, file: pa.NativeFile, size: int, start: int, end: int, state: int, depth: int, first: int) -> Iterator[bytes]:
        """The objects that begin in the range: the elements of the document's array, or the document itself."""
        level = int(first == ord("["))
        allowed = b" \t\r\n," if level else b" \t\r\n"
        held: list[bytes] = []
        ours = False
        for at, data in pieces(file, start, size):
            if not ours and at >= end:
                return
            codes = np.frombuffer(data, np.uint8)
            inside, state = cls.scan(codes, state)
            steps = np.where(inside, 0, cls.steps(codes))
            after = depth + np.cumsum(steps)
            between = ~inside & (after == level) & (steps == 0) | (after == level + 1) & (steps > 0) & (codes != ord("{"))
            stray = np.flatnonzero(between & ~np.isin(codes, list(allowed)))
            if len(stray):
                raise ValueError(f"element that is no object at byte {at + int(stray[0])}")
            opens = (steps > 0) & (after == level + 1)
            closes = (steps < 0) & (after == level) & (codes == ord("}"))
            begin = 0
            for place in np.flatnonzero(opens | closes).tolist():
                if opens[place]:
                    if at + place >= end:
                        return
                    ours, held, begin = True, [], place
                elif ours:
                    yield b"".join([*held, data[begin : place + 1]])
                    ours = False
            if ours:
                held.append(data[begin:])
            depth = int(after[-1])

    @staticmethod
    def finished(state: int, depth: int) -> bool:
        return state == 0 and depth == 0


FORMATS = {"csv": QuotedCsv, "json": JsonDocument}


def file_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, size, start, end`` of all ranges of the files below a path; contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size")).where("size > 0")
    checked = F.when(F.col("path").rlike(_COMPRESSED), F.raise_error(F.concat(F.lit("compressed files cannot be split: "), "path")))
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(range_bytes).cast("bigint")))
    ranges = files.select(F.coalesce(checked.cast("string"), "path").alias("path"), "size", starts.alias("start"))
    return ranges.withColumn("end", F.least("size", F.col("start") + range_bytes))


def split_records(spark: SparkSession, path: str, kind: str, range_bytes: int = RANGE_BYTES, encoding: str = "utf-8") -> DataFrame:
    """The records of files as ``path, start, header, value``; one task reads about one range.

    ``start`` is that of the range, ``header`` marks the first record of a file.  A file that ends inside a record is an error.
    """
    if '"\n\\'.encode(encoding) != b'"\n\\':
        raise ValueError(f"{encoding} cannot be cut at bytes")
    rules = FORMATS[kind]
    ranges = file_ranges(spark, path, range_bytes)
    tasks = max(1, ranges.count())

    def effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                with opened(row.path) as file:
                    first = (file.read_at(PIECE, 0).removeprefix(b"\xef\xbb\xbf").lstrip()[:1] or b"\0")[0] if row.start == 0 else None
                    effect = reduce(compose, (rules.effect(data) for _, data in pieces(file, row.start, row.end)))
                ends, depths = zip(*effect)
                yield pd.DataFrame([(*row, list(ends), list(depths), first)], columns=[*batch.columns, "ends", "depths", "first"])

    def settled(file: pd.DataFrame) -> pd.DataFrame:
        file = file.sort_values("start")
        state, depth, begins = 0, 0, []
        for ends, depths in zip(file["ends"], file["depths"]):
            begins.append((state, depth))
            state, depth = int(ends[state]), depth + int(depths[state])
        if not rules.finished(state, depth):
            raise ValueError(f"the file ends inside a record: {file['path'].iloc[0]}")
        states, levels = zip(*begins)
        return file[["path", "size", "start", "end"]].assign(state=states, depth=levels, first=int(file["first"].iloc[0]))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["path"]) as file:
                    texts, held, fresh = [], 0, True
                    for record in rules.records(file, *(row[n] for n in ("size", "start", "end", "state", "depth", "first"))):
                        texts.append(record.decode(encoding, "replace"))
                        held += len(record)
                        if held > BATCH_BYTES:
                            yield _batch(row, texts, fresh)
                            texts, held, fresh = [], 0, False
                    if texts:
                        yield _batch(row, texts, fresh)

    where = "path string, size bigint, start bigint, end bigint"
    summaries = ranges.repartition(tasks).mapInPandas(effects, f"{where}, ends array<int>, depths array<bigint>, first int")
    begun = summaries.groupBy("path").applyInPandas(settled, f"{where}, state int, depth bigint, first int")
    return begun.repartition(tasks).mapInArrow(records, "path string, start bigint, header boolean, value string")


def _batch(row: dict, texts: list[str], fresh: bool) -> pa.RecordBatch:
    """Records of one range; ``fresh`` if the first of them is the first of its range."""
    header = [False] * len(texts)
    header[0] = fresh and row["start"] == 0
    return pa.record_batch(
        {
            "path": pa.array([row["path"]] * len(texts), pa.string()),
            "start": pa.array([row["start"]] * len(texts), pa.int64()),
            "header": pa.array(header, pa.bool_()),
            "value": pa.array(texts, pa.string()),
        }
    )
