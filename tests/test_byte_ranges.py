"""Files cut anywhere: records by byte ranges against readers of whole files."""

from __future__ import annotations

import csv
import io
import json
import random
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException

from joulecorpus.session import scratch_path
from joulecorpus.sources import byte_ranges, readers


def ranged(kind: str, data: bytes, size: int) -> list[bytes]:
    """The records of all ranges, each begun in the state that the composed effects give."""
    rules, file = byte_ranges.FORMATS[kind], pa.BufferReader(data)
    state = depth = 0
    first, out = (data.lstrip()[:1] or b"\0")[0], []
    for start in range(0, len(data), size):
        end = min(len(data), start + size)
        out += rules.records(file, len(data), start, end, state, depth, first)
        after, change = rules.effect(data[start:end])[state]
        state, depth = after, depth + change
    assert rules.finished(state, depth)
    return out


def random_text(rng: random.Random) -> str:
    return "".join(rng.choice('ab",\n\\{}[]é: ') for _ in range(rng.randrange(12)))


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_csv_records_at_all_range_sizes(ends):
    rng = random.Random(3)
    rows = [[random_text(rng) or "x" for _ in range(3)] for _ in range(30)]
    out = io.StringIO()
    csv.writer(out, lineterminator=ends).writerows(rows)
    data = out.getvalue().encode()
    for size in [*range(1, 40), 97, len(data)]:
        found = [next(csv.reader(io.StringIO(record.decode(), newline=""))) for record in ranged("csv", data, size)]
        assert found == rows, size
    assert len(ranged("csv", data.rstrip(b"\r\n"), 7)) == 30  # the last line end is optional


def test_json_elements_at_all_range_sizes():
    rng = random.Random(4)
    rows = [{random_text(rng): random_text(rng), "n": [1, {"m": random_text(rng)}, []]} for _ in range(20)]
    data = (" \n" + json.dumps(rows, ensure_ascii=False, indent=1)).encode()
    for size in [*range(1, 40), 97, len(data)]:
        assert [json.loads(e) for e in ranged("json", data, size)] == rows, size
    single = json.dumps(rows[0]).encode()
    assert [json.loads(e) for e in ranged("json", single, 5)] == rows[:1]
    assert ranged("json", b" [ ] ", 2) == []
    for bad in (b'[{"a": 1}, 2]', b'["x"]', b'[[{"a": 1}]]'):
        with pytest.raises(ValueError):
            ranged("json", bad, 3)


def test_pieces_smaller_than_records(monkeypatch):
    monkeypatch.setattr(byte_ranges, "PIECE", 3)
    assert ranged("csv", b'a,"b\n""c"\nlong,record\n', 5) == [b'a,"b\n""c"', b"long,record"]
    assert ranged("json", b'[{"a":"\\\\\\"}"},{"b":{}}]', 4) == [b'{"a":"\\\\\\"}"}', b'{"b":{}}']


def written(spark, name: str, data: bytes) -> str:
    folder = Path(scratch_path(spark, "ranges"))
    folder.mkdir(parents=True)
    (folder / name).write_bytes(data)
    return str(folder)


def test_csv_equals_the_reader_of_whole_files(spark):
    rng = random.Random(5)
    out = io.StringIO()
    table = csv.writer(out, lineterminator="\n")
    table.writerow(["id", "text", "my col"])
    table.writerows([str(i), rng.choice(["NA", "", "two\nlines", 'say "so"', "cr\r\nlf", "é" * 9]), random_text(rng)] for i in range(300))
    path = written(spark, "a b.csv", out.getvalue().encode())
    found = readers.read_csv_split(spark, path, range_bytes=500)
    want = readers.read_csv(spark, path)
    assert found.columns == want.columns
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect())) and want.count() == 300
    assert byte_ranges.split_records(spark, path, "csv", 500).select("start").distinct().count() > 10
    typed = readers.read_csv_split(spark, path, schema="id bigint, text string, other string", range_bytes=500)
    assert sorted(r.id for r in typed.collect()) == list(range(300))


def test_json_equals_the_reader_of_whole_documents(spark):
    rows = [{"id": i, "text": 'a "}" \\ [' * (i % 5), "more": {"x": [i]}} for i in range(200)]
    path = written(spark, "doc.json", json.dumps(rows).encode())
    schema = "id bigint, text string, more struct<x: array<bigint>>"
    found = readers.read_json_split(spark, path, schema, range_bytes=300)
    assert sorted(found.collect()) == sorted(readers.read_json(spark, path, schema).collect())
    with pytest.raises(PySparkException, match="inside a record"):
        readers.read_json_split(spark, written(spark, "cut.json", json.dumps(rows).encode()[:-9]), schema, 300).collect()


def test_files_that_cannot_be_cut(spark):
    with pytest.raises(ValueError, match="utf-16"):
        byte_ranges.split_records(spark, "anywhere", "csv", encoding="utf-16")
    with pytest.raises(PySparkException, match="compressed"):
        byte_ranges.split_records(spark, written(spark, "a.csv.gz", b"x"), "csv").collect()
    empty = written(spark, "empty.json", b"")
    assert readers.read_json_split(spark, empty, "id bigint").collect() == []


@pytest.mark.parametrize("name", ["read_csv_split", "read_json_split"])
def test_large_tables_are_split_over_files(spark, monkeypatch, name):
    from joulecorpus.plans import registry

    sf_dir = "/root/testdata/sf0.001"
    one = sorted(map(tuple, registry.QUERIES[name](spark, sf_dir).collect()), key=str)
    paths = []
    split = byte_ranges.split_records
    monkeypatch.setattr(byte_ranges, "split_records", lambda spark, path, *rest: paths.append(path) or split(spark, path, *rest))
    monkeypatch.setattr(registry, "FILE_BYTES", 1 << 15)
    assert sorted(map(tuple, registry.QUERIES[name](spark, sf_dir).collect()), key=str) == one
    files = byte_ranges.file_ranges(spark, paths[0]).select("path", "size").distinct().collect()
    assert len(files) > 3 and max(f.size for f in files) < 0.5 * sum(f.size for f in files)
