"""Markers as a second stream against the batch, with rows out of order, ties and late rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from joulecorpus.operators import telemetry
from joulecorpus.session import scratch_path
from joulecorpus.streaming import marker_state
from joulecorpus.streaming.snapshots import drain_append

READING = "run_id bigint, gpu_id bigint, ts double, name string, power double, temperature double, utilization double, memory_used double"
MARKER = "run_id bigint, ts double, step bigint"


def run(spark, arrivals, lateness_s=10.0, block_s=5.0):
    inbox = {"readings": scratch_path(spark, "readings"), "markers": scratch_path(spark, "markers")}
    progress, table = scratch_path(spark, "progress"), scratch_path(spark, "parts")
    for readings, markers in arrivals:
        spark.createDataFrame(readings, READING).write.mode("append").parquet(inbox["readings"])
        spark.createDataFrame(markers, MARKER).write.mode("append").parquet(inbox["markers"])
        sides = (spark.readStream.schema(schema).parquet(inbox[name]) for name, schema in (("readings", READING), ("markers", MARKER)))
        drain_append(marker_state.stream_marker_parts(*sides, lateness_s, block_s), "parts", progress, table)
    return spark.read.schema(marker_state.REPORT_SCHEMA).parquet(table)


def reading(run_id, ts, gpu=0, power=10.0, name="A"):
    return (run_id, gpu, ts, name, power, 40.0, None, 1.0)


BEAT = ([(None, None, 1000.0, None, None, None, None, None)], [(None, 1000.0, None)])


def test_equals_the_batch(spark):
    rng = random.Random(6)
    readings = [reading(r, rng.randrange(0, 400) / 4, rng.randrange(2), float(rng.randrange(9)), rng.choice(["A", "B", None])) for r in (1, 2, 3) for _ in range(150)]
    readings += readings[:20]
    markers = [(r, rng.randrange(0, 400) / 4, s) for r in (1, 2) for s in range(12)] + [(1, 30.0, 50), (1, 30.0, 51), (4, 5.0, 1)]
    when = lambda ts: min(3, int((ts + rng.random() * 9) // 30))
    dealt = [([], []) for _ in range(4)]
    for row in readings:
        dealt[when(row[2])][0].append(row)
    for row in markers:
        dealt[when(row[1])][1].append(row)
    parts = run(spark, [*dealt, BEAT])
    assert not parts.where(F.col("kind").startswith("late")).count()
    bases = spark.createDataFrame([(r, 2.0) for r in (1, 2, 3, 4)], "run_id bigint, baseline_power_w double")
    ends = spark.createDataFrame([(r, 100.0) for r in (1, 2, 3, 4)], "run_id bigint, end_ts double")
    want = telemetry.marker_energy(spark.createDataFrame(readings, READING), spark.createDataFrame(markers, MARKER), bases, ends, 5.0)
    found = marker_state.marker_energy_so_far(parts, bases, ends, 5.0)
    assert found.columns == want.columns
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect())) and want.count() > 20


def test_late_rows_are_reported(spark):
    first = ([reading(1, 1.0), reading(1, None)], [(1, 0.5, 7)])
    pushed = ([reading(1, 60.0)], [(1, 60.0, 8)])
    straggler = ([reading(1, 2.0)], [(1, 3.0, 9)])
    parts = run(spark, [first, pushed, straggler, BEAT])
    found = {(r.kind, r.marker_step, r.last_ts) for r in parts.collect()}
    assert found == {
        ("marker", 7, None), ("part", 7, 1.0), ("marker", 8, None), ("part", 8, 60.0),
        ("late_reading", None, 2.0), ("late_marker", 9, 3.0),
    }


def test_slower_side_holds_the_other(spark):
    parts = run(spark, [([reading(1, 1.0), reading(1, 500.0)], []), ([], [(1, 0.0, 1)])])
    assert parts.count() == 0  # markers have only come to 0
    assert run(spark, [([], []), BEAT]).count() == 0
