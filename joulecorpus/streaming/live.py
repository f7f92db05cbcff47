"""Figures of runs that still go on, read from the state of their stream.

``track_readings`` is an update stream whose state is the table of ``partials.reading_partials``:
distinct unified readings with their copies, combined on the map side.  The state is read as a table at any
time, also by another session, so a question about the running jobs neither stops the stream nor reads the raw
readings again.  State older than ``keep_s`` of event time leaves; questions reach back that far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from joulecorpus.operators import partials, telemetry
from joulecorpus.session import child_names

_COLUMNS = [*partials.KEYS, *partials.VALUES]


def track_readings(stream: DataFrame, keep_s: float = 7 * 86_400.0) -> DataFrame:
    """The maintained readings of a stream of raw ones; rows without a time are none.

    The watermark drops readings that are ``keep_s`` older than the latest one.
    """
    timed = stream.where(F.col("ts").isNotNull()).withColumn("event_time", F.timestamp_micros((F.col("ts") * 1_000_000).cast("bigint")))
    return partials.reading_partials(timed.withWatermark("event_time", f"{int(keep_s * 1000)} milliseconds"), "event_time")


def start_tracking(tracked: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the state of ``track_readings`` below ``checkpoint``; nothing else is written.

    ``trigger`` is that of a stream, everything available by default.
    """
    stream = tracked.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"availableNow": True})).start()


def live_readings(spark: SparkSession, checkpoint: str, like: DataFrame) -> DataFrame:
    """The readings consumed so far, as of the last finished micro-batch; ``like`` is the tracked stream.

    A stream that has not finished one has none.
    """
    kept = [f for f in like.schema.fields if f.name != "event_time"]
    if not child_names(spark, f"{checkpoint.rstrip('/')}/commits"):
        return spark.createDataFrame([], like.schema).select(*[f.name for f in kept])
    state = spark.read.format("statestore").load(checkpoint)
    key = [F.col(f"key.`{f.name}`").alias(name) for f, name in zip(state.schema["key"].dataType.fields, [*_COLUMNS, "event_time"], strict=True)]
    (count,) = state.schema["value"].dataType.fieldNames()
    rows = state.select(*key, F.col(f"value.`{count}`").alias("copies"))
    return rows.select(*[f.name for f in kept])


def live_metrics(readings: DataFrame, runs: DataFrame, since: float, now: float, baseline_s: float) -> DataFrame:
    """``telemetry.metrics_since`` over live readings, for the runs of ``runs`` (``run_id``)."""
    seen = readings.where(F.col("ts") <= F.lit(now))
    facts = telemetry.run_facts(telemetry.tag_phase(seen, baseline_s))
    power = runs.join(facts.select("run_id", "baseline_power_w"), "run_id", "left")
    return telemetry.metrics_since(seen.where(~F.col("failed")), power, seen, since, now)
