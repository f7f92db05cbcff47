"""Growing files: every finished line once, whatever the cuts."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark import cloudpickle

from joulecorpus.plans.registry import log_sizes
from joulecorpus.session import scratch_path
from joulecorpus.sources import byte_ranges, growing
from joulecorpus.sources.smi import growing_smi_lines, parse_smi_lines
from joulecorpus.streaming import marker_state
from joulecorpus.streaming.snapshots import drain_append


@pytest.mark.parametrize("piece", [1, 3, 1 << 20])
def test_lines_of_all_ranges(monkeypatch, piece):
    monkeypatch.setattr(growing, "PIECE", piece)
    monkeypatch.setattr("joulecorpus.sources.byte_ranges.PIECE", piece)
    data = "one\r\n\n\nlonger line é\nx\nunfinished".encode()
    file = pa.BufferReader(data)
    want = [(0, b"one"), (5, b""), (6, b""), (7, "longer line é".encode()), (22, b"x")]
    for size in range(1, len(data) + 1):
        found = [row for at in range(0, len(data), size) for row in growing.finished_lines(file, at, min(len(data), at + size))]
        assert found == want, size


def test_workers_need_no_installed_package(tmp_path):
    """A worker that cannot import the package still loads the source, the range rules and the state function."""
    parts = [growing.GrowingLines, growing.GrowingReader({"path": "/x"}), byte_ranges.JsonDocument, byte_ranges.QuotedCsv, marker_state._advance(5.0)]
    (tmp_path / "parts.bin").write_bytes(cloudpickle.dumps(parts))
    script = "import pickle; print(len(pickle.load(open('parts.bin', 'rb'))))"
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "5", done.stderr


def test_small_growths_share_a_task():
    reader = growing.GrowingReader({"path": "/x", "rangebytes": "100"})
    sizes = {f"{k:03}.log": 30 for k in range(10)} | {"big.log": 250, "same.log": 7}
    parts = [p.ranges for p in reader.partitions({"sizes": {"000.log": 10, "big.log": 20, "same.log": 7}}, {"sizes": sizes})]
    ranges = [r for part in parts for r in part]
    assert [(f, a, b) for f, a, b in ranges if "big" in f] == [("/x/big.log", 20, 120), ("/x/big.log", 120, 220), ("/x/big.log", 220, 250)]
    assert len(ranges) == 13 and len({f for f, *_ in ranges}) == 11
    assert len(parts) <= 7 and all(sum(b - a for _, a, b in part) <= 100 for part in parts)


def test_logs_and_ranges_grow_with_the_table_and_not_their_number():
    small, large = log_sizes(1 << 19), log_sizes(720 << 20)
    assert small == (2000, 1 << 15) and large[0] > 100_000 and 32 << 20 < large[1] <= 64 << 20


def drained(spark, folder, progress, table, **options):
    drain_append(growing.growing_lines(spark, str(folder), "*.log", **options), "lines", progress, table)
    return sorted((r.file, r.at, r.line) for r in spark.read.schema(growing.SCHEMA).parquet(table).collect())


def test_appended_lines_come_once(spark):
    folder, progress, table = Path(scratch_path(spark, "logs")), scratch_path(spark, "progress"), scratch_path(spark, "lines")
    run = lambda: drained(spark, folder, progress, table, range_bytes=4)
    assert run() == []  # no folder yet
    folder.mkdir(parents=True)
    (folder / "a.log").write_text("first\nsec")
    (folder / "other.txt").write_text("no\n")
    (folder / ".hidden.log").write_text("no\n")
    assert run() == [("a.log", 0, "first")]
    assert run() == [("a.log", 0, "first")]
    with (folder / "a.log").open("a") as log:
        log.write("ond\n\nlast")
    (folder / "b.log").write_text("new\n")
    second = [("a.log", 0, "first"), ("a.log", 6, "second"), ("a.log", 13, ""), ("b.log", 0, "new")]
    assert run() == second
    (folder / "a.log").write_text("again\n")  # emptied and written anew
    assert run() == sorted([*second, ("a.log", 0, "again")])


def test_device_lines_with_rejects(spark):
    folder, progress, table = Path(scratch_path(spark, "logs")), scratch_path(spark, "progress"), scratch_path(spark, "lines")
    folder.mkdir(parents=True)
    log = folder / "gpu.log"
    whole = "0, A, 10.5, 40, 50, 1, 2\n \nbroken\n1, B, [N/A], 41, 51, 1, 2\n"
    for upto in (9, 30, len(whole)):
        log.write_text(whole[:upto])
        drain_append(parse_smi_lines(growing_smi_lines(spark, str(folder))).drop("file", "at"), "smi", progress, table)
    found = {r.line: (r.parsed, r.gpu_id, r.power_w) for r in spark.read.parquet(table).collect()}
    assert found == {"0, A, 10.5, 40, 50, 1, 2": (True, 0, 10.5), "broken": (False, None, None), "1, B, [N/A], 41, 51, 1, 2": (True, 1, None)}
