"""The state of a running stream, read as a table, against a batch over what was consumed."""

from __future__ import annotations

from pyspark.sql import functions as F

from joulecorpus.operators import partials
from joulecorpus.session import scratch_path
from joulecorpus.streaming import live

SCHEMA = "run_id bigint, gpu_id bigint, ts double, name string, power_w double, temperature_c double, utilization_percent double, memory_used_mb double, error string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_live_state_equals_what_was_consumed(spark):
    reading = lambda run, t, power, error=None, name="A": (run, 0, t, name, power, 50.0, 60.0, 1.0, error)
    arrivals = [
        [reading(1, 100.0, 10.0), reading(1, 100.0, 10.0), reading(2, 101.0, None, "lost"), reading(None, 101.0, 5.0)],
        [reading(1, 100.0, 10.0), reading(1, 160.0, 30.0, name=None), reading(2, None, 7.0)],
        [reading(2, 170.0, 40.0)],
    ]
    inbox, progress = scratch_path(spark, "inbox"), scratch_path(spark, "progress")
    seen = []
    for number, rows in enumerate(arrivals):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(inbox)
        tracked = live.track_readings(spark.readStream.schema(SCHEMA).parquet(inbox), keep_s=3600.0)
        if number == 0:  # nothing consumed yet
            assert live.live_readings(spark, progress, tracked).collect() == []
        live.start_tracking(tracked, progress).awaitTermination()
        seen += [r for r in rows if r[2] is not None]
        state = live.live_readings(spark, progress, tracked)
        want = partials.reading_partials(spark.createDataFrame(seen, SCHEMA))
        assert state.columns == want.columns and rows_of(state) == rows_of(want)
    runs = spark.createDataFrame([(1,), (2,), (3,)], "run_id bigint")
    found = {r.run_id: r for r in live.live_metrics(state, runs, 150.0, 165.0, 50.0).collect()}
    assert (found[1].power_avg_w, found[1].baseline_power_w, found[1].total_samples) == (30.0, 10.0, 1)
    assert found[2].error and found[3].error and found[3].total_samples == 0


def test_old_state_leaves(spark):
    inbox, progress = scratch_path(spark, "inbox"), scratch_path(spark, "progress")
    for t in (100.0, 5000.0, 5001.0):
        spark.createDataFrame([(1, 0, t, "A", 1.0, 1.0, 1.0, 1.0, None)], SCHEMA).write.mode("append").parquet(inbox)
        tracked = live.track_readings(spark.readStream.schema(SCHEMA).parquet(inbox), keep_s=600.0)
        live.start_tracking(tracked, progress).awaitTermination()
    assert live.live_readings(spark, progress, tracked).select(F.min("ts")).first()[0] == 5000.0
