"""Synchronised windows against a plain sequential simulation."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from joulecorpus.config import SyncConfig
from joulecorpus.operators import report, sync, telemetry
from joulecorpus.plans import energy_job
from joulecorpus.session import scratch_path
from joulecorpus.sources import smi
from joulecorpus.streaming import snapshots as streams
from joulecorpus.streaming import sync_state

READING = "run_id bigint, gpu_id bigint, ts double, name string, power_w double, temperature_c double, utilization_percent double, memory_used_mb double, error string"
STEP = "run_id bigint, step bigint, ts double, epoch double"


def simulate(readings, steps, start, config):
    """Step events of one run in order, with mutable state."""
    last_sync, last_step, out = start, 0, []
    for _, step, t, epoch in steps:
        by_time, by_step = t - last_sync >= config.interval_s, step % config.logging_steps == 0
        inside = [r for r in readings if last_sync <= r[2] <= t]
        good = [r for r in inside if r[8] is None]
        if not (by_time or by_step) or not good:
            continue
        power = [r[4] for r in good]
        average = sum(power) / len(power)
        out.append(
            {
                "step": step, "last_sync": last_sync, "last_step": last_step, "by_time": by_time, "by_step": by_step,
                "power_avg_w": average, "power_max_w": max(power), "power_min_w": min(power),
                "energy_consumed_wh": average * (t - last_sync) / 3600,
                "temperature_avg_c": sum(r[5] for r in good) / len(good), "temperature_max_c": max(r[5] for r in good),
                "utilization_avg_percent": sum(r[6] for r in good) / len(good),
                "memory_used_avg_mb": sum(r[7] for r in good) / len(good),
                "gpu_name": ", ".join(sorted({r[3] for r in good})),
                "duration_s": t - last_sync, "samples_count": len({r[2] for r in inside}), "epoch": epoch, "timestamp": t,
            }
        )
        if by_time:
            last_sync = t
        last_step = step
    return out


def random_run(run, seed, n_steps, n_readings, gap):
    """Times on a coarse grid so that steps, readings and cuts coincide."""
    rng = random.Random(seed)
    t, steps = 0.0, []
    for number in range(1, n_steps + 1):
        t += rng.choice([0.0, 0.5, 1.0, 1.0, gap])
        steps.append((run, number, t, number / 10))
    readings = []
    for _ in range(n_readings):
        at = round(rng.uniform(0, t) * 2) / 2
        error = "x" if rng.random() < 0.3 else None
        gpu = rng.randint(0, 3)
        readings.append((run, gpu, at, f"G{gpu}", rng.uniform(1, 300), rng.uniform(30, 90), rng.uniform(1, 99), 5.0 * gpu, error))
    return readings, steps


def check(found, expected):
    assert [(r["run_id"], r["step"]) for r in found] == [(run, e["step"]) for run, e in expected]
    for row, (_, want) in zip(found, expected):
        for name, figure in want.items():
            assert row[name] == (pytest.approx(figure) if isinstance(figure, float) else figure), (name, want)


CASES = [
    SyncConfig(interval_s=4.0, logging_steps=5, block_s=3.0, block_rows=7),
    SyncConfig(interval_s=4.0, logging_steps=5, block_s=1000.0, block_rows=10_000),
    SyncConfig(interval_s=60.0, logging_steps=3, block_s=10.0, block_rows=4),
    SyncConfig(interval_s=0.5, logging_steps=1000, block_s=2.0, block_rows=16),
    SyncConfig(interval_s=1e9, logging_steps=7, block_s=25.0, block_rows=50),
]


def make(spark):
    runs = {
        1: random_run(1, 11, 400, 600, 3.0),
        2: random_run(2, 12, 60, 12, 9.0),
        3: random_run(3, 13, 25, 200, 40.0),
        4: random_run(4, 14, 30, 0, 1.0),
    }
    runs[1] = (runs[1][0] + [r for r in runs[1][0][:40]], runs[1][1])  # copies of readings
    all_readings = [r for readings, _ in runs.values() for r in readings]
    all_steps = [s for _, steps in runs.values() for s in steps]
    random.Random(1).shuffle(all_readings)
    random.Random(2).shuffle(all_steps)
    starts = spark.createDataFrame([(run, 0.0) for run in runs], "run_id bigint, start_ts double")
    return runs, spark.createDataFrame(all_readings, READING), spark.createDataFrame(all_steps, STEP), starts


@pytest.mark.parametrize("config", CASES)
def test_windows_equal_the_simulation(spark, monkeypatch, config):
    monkeypatch.setattr(sync, "FAN", 2)  # a tree of several levels
    runs, readings, steps, starts = make(spark)
    expected = [(run, w) for run, (r, s) in runs.items() for w in simulate(r, s, 0.0, config)]
    fired = sync.sync_windows(steps, readings, starts, config)
    windows = sync.window_metrics(fired, telemetry.unify_readings(readings, errors="flag"), config)
    check(windows.orderBy("run_id", "step").collect(), expected)


@pytest.mark.parametrize("interval_s, block_rows", [(3.0, 64), (100.0, 64), (700.0, 10_000)])
def test_long_runs_are_cut_block_by_block(spark, interval_s, block_rows):
    config = SyncConfig(interval_s=interval_s, logging_steps=10**9, block_s=50.0, block_rows=block_rows)
    n, every = 6000, int(interval_s * 4)
    steps = spark.range(1, n + 1).select(
        F.lit(1).cast("bigint").alias("run_id"), F.col("id").alias("step"), (F.col("id") * 0.25).alias("ts"), F.lit(0.0).alias("epoch")
    )
    starts = spark.createDataFrame([(1, 0.0)], "run_id bigint, start_ts double")
    fired = sync.sync_windows(steps, steps.select("run_id", "ts"), starts, config).orderBy("step").collect()
    assert [r["step"] for r in fired] == list(range(every, n + 1, every))
    assert [r["last_sync"] for r in fired][1:] == [r["ts"] for r in fired][:-1]
    assert [r["last_step"] for r in fired][1:] == [r["step"] for r in fired][:-1]


def test_joined_blocks_are_the_run(spark):
    rng = random.Random(8)
    for _ in range(300):
        n, interval = rng.randint(1, 40), rng.choice([0.3, 1.0, 4.0])
        t = np.cumsum([rng.choice([0.0, 0.1, 0.5, 3.0]) + rng.random() * 0.2 for _ in range(n)])
        ok = np.maximum.accumulate([x if rng.random() < 0.5 else -np.inf for x in t])
        edges = [0, *sorted(rng.sample(range(1, n), min(n - 1, rng.randint(0, 6)))), n]
        maps = [sync._block_map(t[a:b], ok[a:b], interval) for a, b in zip(edges, edges[1:])]
        limits, exits = sync._joined_maps(maps)
        for start in (-5.0, -1.0, t[0] - interval, t[0] - 0.05, float(t[0])):
            cut = start
            for x, y in zip(t, ok):
                if x - cut >= interval and y >= cut:
                    cut = x
            assert sync._apply(limits, exits, np.array([start]))[0] == cut
        assert len(limits) == len(exits) and (np.diff(limits) > 0).all()


def test_pooled_example(spark):
    rows = [
        (1, 0, 1001.0, "A", 200.0, 65.0, 80.0, 1.0, None), (1, 1, 1001.0, "B", 180.0, 65.0, 80.0, 1.0, None),
        (1, 0, 1005.0, "A", 220.0, 65.0, 80.0, 1.0, None), (1, 1, 1005.0, "B", 190.0, 65.0, 80.0, 1.0, None),
    ]
    readings = spark.createDataFrame(rows, READING)
    steps = spark.createDataFrame([(1, 50, 1010.0, 0.5)], STEP)
    starts = spark.createDataFrame([(1, 1000.0)], "run_id bigint, start_ts double")
    config = SyncConfig()
    fired = sync.sync_windows(steps, readings, starts, config)
    row = sync.window_metrics(fired, telemetry.unify_readings(readings, errors="flag"), config).first()
    assert row["power_avg_w"] == 197.5 and row["duration_s"] == 10.0 and row["samples_count"] == 2
    assert row["gpu_name"] == "A, B"
    assert row["energy_all_gpus_wh"] == pytest.approx(395.0 * 10 / 3600)


@pytest.mark.parametrize("arrivals", [1, 5])
def test_stream_equals_batch(spark, arrivals):
    config = CASES[0]
    runs, readings, steps, starts = make(spark)
    flagged = telemetry.unify_readings(readings, errors="flag")
    ends = starts.sparkSession.createDataFrame([(run, 1e6) for run in runs], "run_id bigint, end_ts double")
    events = sync_state.training_events(flagged, steps, starts, ends).cache()
    last = events.where("step is null or step >= 0").agg(F.max("ts")).first()[0]
    inbox, progress, table = (scratch_path(spark, n) for n in ("inbox", "progress", "table"))
    for number in range(arrivals):
        share = F.least(F.lit(arrivals - 1), F.floor(F.col("ts") / (last / arrivals)))
        events.where(share == number).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(sync_state.EVENT_SCHEMA).parquet(inbox)
        streams.drain_append(sync_state.stream_sync(stream, config), "sync", progress, table)
    events.unpersist()
    found = spark.read.schema(sync_state.WINDOW_SCHEMA).parquet(table).orderBy("run_id", "step").collect()
    expected = [(run, w) for run, (r, s) in runs.items() for w in simulate(r, s, 0.0, config)]
    check(found, expected)
    assert {r["late_dropped"] for r in found} == {0}


def test_stream_waits_for_rows_within_the_lateness(spark):
    schema = sync_state.EVENT_SCHEMA
    inbox, progress, table = (scratch_path(spark, n) for n in ("inbox", "progress", "table"))
    config = SyncConfig(interval_s=5.0, logging_steps=1, lateness_s=2.0)

    def arrive(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).parquet(inbox)
        streams.drain_append(sync_state.stream_sync(stream, config), "s", progress, table)
        return [(r["step"], r["power_avg_w"], r["late_dropped"]) for r in spark.read.schema(sync_state.WINDOW_SCHEMA).parquet(table).orderBy("step").collect()]

    def reading(t, power):
        return (1, t, None, None, power, 1.0, 1.0, 1.0, "A")

    def step(t, number):
        return (1, t, number, 0.0, None, None, None, None, None)

    assert arrive([step(0.0, 0), reading(1.0, 10.0), step(2.0, 1), reading(2.5, 40.0)]) == []  # step 1 still waits
    assert arrive([reading(1.5, 30.0), reading(3.0, 30.0), step(4.0, 2)]) == [(1, 20.0, 0)]  # with the row that came late
    assert arrive([reading(0.5, 999.0), reading(4.5, 1.0)])[0] == (1, 20.0, 0)  # too late by far: tallied, not counted
    assert arrive([step(4.6, sync_state.RUN_ENDS)]) == [(1, 20.0, 0), (2, 27.5, 1)]


def test_a_silent_run_is_flushed_and_late_rows_are_reported(spark):
    schema = sync_state.EVENT_SCHEMA
    inbox, progress, table = (scratch_path(spark, n) for n in ("inbox", "progress", "table"))
    config = SyncConfig(interval_s=5.0, logging_steps=1, lateness_s=2.0)

    def arrive(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).parquet(inbox)
        streams.drain_append(sync_state.stream_reports(stream, config, silence_s=10.0), "s", progress, table)
        rows = spark.read.schema(sync_state.REPORT_SCHEMA).parquet(table).orderBy("run_id", "timestamp").collect()
        return [(r["run_id"], r["kind"], r["timestamp"], r["step"], r["power_avg_w"], r["samples_count"], r["late_dropped"]) for r in rows]

    def reading(run, t, power):
        return (run, t, None, None, power, 1.0, 1.0, 1.0, "A")

    def step(run, t, number):
        return (run, t, number, 0.0, None, None, None, None, None)

    assert arrive([step(1, 100.0, 0), reading(1, 101.0, 10.0), step(1, 102.0, 1), step(2, 100.0, 0), reading(2, 103.0, 50.0)]) == []
    # Run 2 goes on; run 1 has crashed, and is consumed once the stream's time is 10 s past it.
    assert arrive([reading(2, 109.0, 50.0)]) == []
    first = (1, "window", 102.0, 1, 10.0, 1, 0)
    assert arrive([reading(2, 113.0, 50.0)]) == [first]
    # A row older than what its run has consumed is reported at once, with no window after it.
    late = (1, "late", 101.5, None, None, 1, 1)
    assert arrive([reading(1, 101.5, 99.0)]) == [late, first]
    # A run may go on after its silence; a beat without a run ends the wait of all.
    beat = (None, 200.0, *[None] * 7)
    found = arrive([reading(1, 114.0, 30.0), step(1, 115.0, 2), step(2, 114.0, 1), beat])
    assert found == [late, first, (1, "window", 115.0, 2, 20.0, 2, 1), (2, "window", 114.0, 1, 50.0, 3, 0)]


def test_snapshot_stream_drops_empty_snapshots(spark):
    path = scratch_path(spark, "snapshots")
    empty = "array<struct<gpu_id: bigint, ts: double, name: string, power_w: double, power_draw_w: double, temperature_c: double, utilization_percent: double, memory_used_mb: double, error: string>>"
    spark.createDataFrame(
        [(1, 1.0, "m", [(0, 1.0, "A", 5.0, None, None, None, None, None)]), (1, 2.0, "m", [])],
        f"run_id bigint, timestamp double, method string, gpus {empty}",
    ).write.parquet(path)
    table = streams.drain_append(streams.snapshot_stream(spark, path, maxFilesPerTrigger=1), "drained")
    assert [r["timestamp"] for r in spark.read.parquet(table).collect()] == [1.0]


def test_snapshots_from_messages(spark):
    messages = [
        ('{"run_id": 1, "timestamp": 2.5, "method": "m", "gpus": [{"gpu_id": 0, "power_w": 5.0}]}',),
        ('{"run_id": 1, "timestamp": 3.5, "gpus": []}',),
        ("not json",),
    ]
    rows = streams.snapshots_from_json(spark.createDataFrame(messages, "value string")).collect()
    assert [(r["timestamp"], r["gpus"][0]["power_w"], r["gpus"][0]["error"]) for r in rows] == [(2.5, 5.0, None)]


def test_device_lines_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("0, A, 1, 2, 3, 4, 5\nbroken\n1, B, [N/A], 2, 3, 4, 5\n")
    stream = smi.parse_smi_csv(smi.read_smi_lines(spark, str(tmp_path / "in"), streaming=True))
    rows = spark.read.parquet(streams.drain_append(stream, "lines")).orderBy("gpu_id").collect()
    assert [(r["gpu_id"], r["power_w"]) for r in rows] == [(0, 1.0), (1, None)]
    assert smi.parse_smi_csv(smi.read_smi_lines(spark, str(tmp_path / "in"))).count() == 2


def test_energy_job_writes_every_table(spark, tmp_path):
    runs, readings, steps, starts = make(spark)
    readings = readings.withColumn("method", F.lit("pynvml"))
    markers = steps.where("step % 20 = 0").withColumn("type", F.lit("training_step"))
    config = SyncConfig(interval_s=4.0, logging_steps=5, baseline_s=2.0)
    tables = energy_job.energy_tables(readings, steps, markers, starts, config)
    paths = energy_job.energy_job(tables, str(tmp_path))
    assert set(paths) == {
        "step_history", "interval_history", "summary", "run_summary", "gpu_statistics", "gpu_samples",
        "metrics_long", "energy_report",
    }
    history = spark.read.json(paths["step_history"])
    counts = {r["run_id"]: r["total_logged_steps"] for r in spark.read.json(paths["summary"]).collect()}
    assert {r["run_id"]: r["count"] for r in history.groupBy("run_id").count().collect()} == {
        run: n for run, n in counts.items() if n
    }
    keys = {r["key"] for r in spark.read.parquet(paths["metrics_long"]).select("key").distinct().collect()}
    assert {f"energy_interval/{k}" for k in report.INTERVAL_KEYS} <= keys
    assert {f"final_energy/{k}" for k in report.FINAL_KEYS} <= keys and "energy/gpu_0/gpu_name" in keys
    rows = {r["run_id"]: r for r in spark.read.json(paths["energy_report"]).collect()}
    assert len(rows) == 4 and rows[4]["gpu_details"] is None
    assert "RELATÓRIO ENERGÉTICO FINAL" in rows[1]["summary_text"]
    long = spark.read.parquet(paths["metrics_long"])
    assert [r["text"] for r in long.where("run_id = 4 and key = 'monitoring_error'").collect()] == [telemetry.NO_DATA]
    samples = spark.read.json(paths["gpu_samples"]).selectExpr("run_id", "size(power_samples_w) AS n")
    used = sum(1 for r in runs[1][0] if r[8] is None and r[2] >= 2.0 + min(x[2] for x in runs[1][0]))
    assert sum(r["n"] for r in samples.where("run_id = 1").collect()) == used


def test_marker_stretches_equal_filtering(spark):
    runs, readings, _, _ = make(spark)
    marks = [(1, 5.0, 1), (1, 50.0, 2), (1, 50.0, 3), (3, 30.0, 1)]
    markers = spark.createDataFrame(marks, "run_id bigint, ts double, step int")
    baselines = spark.createDataFrame([(run, None) for run in runs], "run_id bigint, baseline_power_w double")
    ends = readings.groupBy("run_id").agg(F.max("ts").alias("end_ts"))
    found = telemetry.marker_energy(telemetry.unify_readings(readings), markers, baselines, ends, 6.0).collect()
    expected = {}
    for run, (rows, _) in runs.items():
        for r in rows:
            passed = [m for m in marks if m[0] == run and m[1] <= r[2]]
            if passed and r[8] is None:
                expected.setdefault((run, max(passed, key=lambda m: (m[1], m[2]))[2], r[1]), []).append(r[4])
    assert {(r["run_id"], r["marker_step"], r["gpu_id"]): r["samples_count"] for r in found} == {
        key: len(power) for key, power in expected.items()
    }
    spans = {(r["run_id"], r["marker_step"]): r["duration_s"] for r in found}
    assert spans[(1, 1)] == 45.0 and (1, 2) not in spans


@pytest.mark.parametrize("interval", [50.0, 400.0])
def test_joined_maps_hold_the_limits_of_one_interval(interval):
    rng = np.random.default_rng(3)
    t = np.cumsum(rng.uniform(0.5, 1.5, 4096))
    ok = np.where(rng.random(4096) < 0.9, t, np.concatenate([[-np.inf], t[:-1]]))
    ok = np.maximum.accumulate(ok)
    edges = range(0, 4097, 64)
    pdf = pd.DataFrame([{"run_id": "r", "block": k, "limits": x, "exits": y, "first": t[a]} for k, (a, b) in enumerate(zip(edges, edges[1:]))
                        for x, y in [sync._block_map(t[a:b], ok[a:b], interval)]])
    whole = sync._joined_maps(sync._maps(pdf))
    while len(pdf) > 1:
        pdf = pdf.assign(parent=pdf["block"] // 8)
        pdf = pd.concat([sync._merge_maps(g) for _, g in pdf.groupby("parent")], ignore_index=True)
    joined = sync._maps(pdf)[0]
    # Cuts before the first step lie within one interval of limits.
    assert len(joined[0]) <= np.searchsorted(t, t[0] + interval) + 1
    cuts = np.concatenate([t[0] - rng.uniform(0, 2 * interval, 500), t[:1]])
    assert (sync._apply(*joined, cuts) == sync._apply(*whole, cuts)).all()


def test_waiting_rows_are_packed():
    columns = [*sync_state._WAITING, "names"]
    some = [[float(i), np.nan, np.nan, *[1.5] * 10, ["A"] if i % 2 else ["A", "B"]] for i in range(1000)]
    some += [[7.0, 3.0, 0.5, *[np.nan] * 10, None]]
    waiting, lists = sync_state._packed(pd.DataFrame(some, columns=columns))
    assert len(waiting) == 1001 * 8 * len(columns) and lists == [["A", "B"], ["A"], []]
    back = sync_state._unpacked(waiting, lists)
    assert list(back["names"]) == [row[-1] or [] for row in some]
    assert np.array_equal(back[sync_state._WAITING].to_numpy(), np.array([row[:-1] for row in some]), equal_nan=True)
    empty = sync_state._packed(pd.DataFrame([], columns=columns))
    assert len(empty[0]) == 0 and not len(sync_state._unpacked(*empty))


def test_arrivals_are_bounded_and_late_by_no_more_than_allowed(spark, monkeypatch):
    from joulecorpus.plans import registry

    rows = [(i % 3, 2000.0 * i, i, None, None, None, None, None, None) for i in range(2000)]
    events = spark.createDataFrame(rows, sync_state.EVENT_SCHEMA)
    monkeypatch.setattr(registry, "ARRIVAL_ROWS", 100)
    found, parts, first, last = registry.arrivals(events, "arrivals", F.col("step") == 5)
    assert (parts, first, last) == (20, 0.0, 1999 * 2000.0)
    assert sorted(map(tuple, found.drop("arrival").collect()), key=lambda row: row[1]) == rows
    per = {r.arrival: (r.n, r.least, r.most) for r in found.where("step != 5").groupBy("arrival").agg(F.count("*").alias("n"), F.min("ts").alias("least"), F.max("ts").alias("most")).collect()}
    assert sorted(per) == list(range(20)) and max(n for n, _, _ in per.values()) < 150
    assert all(per[k][1] >= per[k - 1][1] and per[k][1] > per[k - 1][2] - registry.SYNC.lateness_s for k in range(1, 20))
    assert [r.arrival for r in found.where("step = 5").collect()] == [19]
    monkeypatch.setattr(registry, "ARRIVAL_ROWS", 1_000_000)
    assert registry.arrivals(events, "arrivals")[1] == 4
