"""Fixed-interval energy windows; one definition for tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_metrics(unified: DataFrame, interval_s: int = 30, late_s: int = 60) -> DataFrame:
    """Pooled power, energy, temperature and load per run and interval.

    On a stream, readings later than ``late_s`` are dropped by the watermark.
    The aggregation combines on the map side before it shuffles.
    """
    at = F.timestamp_micros((F.col("ts") * 1_000_000).cast("bigint"))
    timed = unified.withColumn("event_time", at).withWatermark("event_time", f"{late_s} seconds")
    pooled = timed.groupBy("run_id", F.window("event_time", f"{interval_s} seconds").alias("w")).agg(
        F.avg("power").alias("power_avg_w"),
        F.max("power").alias("power_max_w"),
        F.min("power").alias("power_min_w"),
        F.avg("temperature").alias("temperature_avg_c"),
        F.max("temperature").alias("temperature_max_c"),
        F.avg("utilization").alias("utilization_avg_percent"),
        F.avg("memory_used").alias("memory_used_avg_mb"),
        F.count(F.lit(1)).alias("readings"),
    )
    return pooled.select(
        "run_id",
        F.unix_seconds("w.start").alias("window_start"),
        *[name for name in pooled.columns if name not in ("run_id", "w")],
        (F.col("power_avg_w") * F.lit(interval_s / 3600.0)).alias("energy_consumed_wh"),
    )
