"""Long-form metrics and the per-run report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joulecorpus.functions import energy as en

# Metric names by namespace, and the column each one comes from.
INTERVAL_KEYS = {
    "timestamp": "timestamp",
    "step": "step",
    "epoch": "epoch",
    "power_avg_w": "power_avg_w",
    "power_max_w": "power_max_w",
    "power_min_w": "power_min_w",
    "energy_consumed_wh": "energy_consumed_wh",
    "temperature_avg_c": "temperature_avg_c",
    "temperature_max_c": "temperature_max_c",
    "gpu_utilization_avg_percent": "utilization_avg_percent",
    "memory_used_avg_mb": "memory_used_avg_mb",
    "duration_s": "duration_s",
    "samples_count": "samples_count",
    "efficiency_wh_per_step": "efficiency_wh_per_step",
}
STEP_KEYS = {
    "step": "step",
    "epoch": "epoch",
    "power_avg_w": "power_avg_w",
    "energy_per_step_wh": "energy_per_step_wh",
    "temperature_avg_c": "temperature_avg_c",
    "gpu_utilization_avg_percent": "utilization_avg_percent",
    "memory_used_avg_mb": "memory_used_avg_mb",
    "energy_efficiency": "energy_efficiency",
}
FINAL_KEYS = {
    name: name
    for name in (
        "total_duration_s",
        "total_steps",
        "total_epochs",
        "total_energy_consumed_kwh",
        "avg_power_w",
        "max_temperature_c",
        "energy_per_step_wh",
        "energy_per_epoch_kwh",
        "energy_efficiency_score",
        "carbon_footprint_estimate_kg",
    )
}
FINAL_TEXT_KEYS = {"summary": "summary_text"}
FAILED_TEXT_KEYS = {
    "monitoring_error": "error",
    "monitoring_method": "monitoring_method",
    "final_energy/error": "error",
}
RUN_KEYS = {"monitoring_duration_s": "monitoring_duration_s", "total_samples": "total_samples"}
RUN_TEXT_KEYS = {"monitoring_method": "monitoring_method"}
GPU_KEYS = {"power_avg_w": "power_avg_w", "energy_consumed_kwh": "energy_consumed_kwh"}
GPU_TEXT_KEYS = {"gpu_name": "name"}

# The lines of the closing summary.
SUMMARY_LINES = (
    "🔋 RELATÓRIO ENERGÉTICO FINAL:",
    "• Duração: %.0fs (%.2fh)",
    "• Steps: %d",
    "• Épocas: %.2f",
    "• Energia total: %.4f kWh",
    "• Potência média: %.1fW",
    "• Energia por step: %.2fWh",
    "• Energia por época: %.4fkWh",
    "• Score de eficiência: %.4f",
    "• Pegada de carbono estimada: %.6fkg CO2",
)


def _entries(prefix: Column, keys: dict[str, str], text_keys: dict[str, str] | None = None) -> list[Column]:
    def entry(key: str, value: Column, text: Column) -> Column:
        return F.struct(
            F.concat(prefix, F.lit(key)).alias("key"),
            value.cast("double").alias("value"),
            text.cast("string").alias("text"),
        )

    null = F.lit(None)
    numbers = [entry(key, F.col(name), null) for key, name in keys.items()]
    return numbers + [entry(key, null, F.col(name)) for key, name in (text_keys or {}).items()]


def _long(df: DataFrame, step: Column, entries: list[Column]) -> DataFrame:
    return df.select("run_id", step.cast("bigint").alias("step"), F.inline(F.array(*entries)))


def metrics_long(
    intervals: DataFrame, steps: DataFrame, final: DataFrame, summary: DataFrame, gpus: DataFrame
) -> DataFrame:
    """All metric tables as ``run_id, step, key, value, text`` rows.

    A run that failed has its error and method only.
    """
    failed = summary.where(F.col("error").isNotNull()).fillna("unknown", ["monitoring_method"])
    summary = summary.where(F.col("error").isNull())
    final = final.withColumn("summary_text", summary_text())
    per_gpu = F.concat(F.lit("energy/gpu_"), F.col("gpu_id").cast("string"), F.lit("/"))
    none = F.lit(None)
    tables = [
        _long(intervals, F.col("step"), _entries(F.lit("energy_interval/"), INTERVAL_KEYS)),
        _long(steps, F.col("step"), _entries(F.lit("energy_step/"), STEP_KEYS)),
        _long(final, none, _entries(F.lit("final_energy/"), FINAL_KEYS, FINAL_TEXT_KEYS)),
        _long(summary, none, _entries(F.lit("energy/"), RUN_KEYS, RUN_TEXT_KEYS)),
        _long(failed, none, _entries(F.lit(""), {}, FAILED_TEXT_KEYS)),
        _long(gpus, none, _entries(per_gpu, GPU_KEYS, GPU_TEXT_KEYS)),
    ]
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def summary_text() -> Column:
    """The closing summary of a run, from the columns of ``final_metrics``."""
    return F.format_string(
        "\n".join(SUMMARY_LINES),
        en.fixed(F.col("total_duration_s").cast("double"), 0),
        en.fixed(en.hours(F.col("total_duration_s")), 2),
        F.col("total_steps").cast("bigint"),
        en.fixed(F.col("total_epochs").cast("double"), 2),
        en.fixed(F.col("total_energy_consumed_kwh"), 4),
        en.fixed(F.col("avg_power_w"), 1),
        en.fixed(F.col("energy_per_step_wh"), 2),
        en.fixed(F.col("energy_per_epoch_kwh"), 4),
        en.fixed(F.col("energy_efficiency_score"), 4),
        en.fixed(F.col("carbon_footprint_estimate_kg"), 6),
    )


def energy_report(summary: DataFrame, gpus: DataFrame, advice: DataFrame, final: DataFrame) -> DataFrame:
    """One report row per run: configuration, summary, GPU details, advice, text.

    The collected lists hold one entry per GPU of a run, not per reading.
    """
    details = gpus.groupBy("run_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct("gpu_id", *[n for n in gpus.columns if n not in ("run_id", "gpu_id")])
            )
        ).alias("gpu_details")
    )
    told = advice.groupBy("run_id").agg(F.array_sort(F.collect_list("recommendation")).alias("recommendations"))
    texts = final.select("run_id", summary_text().alias("summary_text"))
    return (
        summary.join(details, "run_id", "left")
        .join(told, "run_id", "left")
        .join(texts, "run_id", "left")
        .select(
            "run_id",
            (F.unix_micros(F.current_timestamp()) / 1e6).alias("timestamp"),
            F.struct(
                "sampling_interval_s",
                F.col("high_precision_enabled").alias("high_precision"),
                F.coalesce("monitoring_method", F.lit("unknown")).alias("method"),
            ).alias("monitoring_config"),
            F.struct(
                F.col("monitoring_duration_s").alias("duration_s"),
                "total_samples",
                F.coalesce("baseline_power_w", F.lit(0.0)).alias("baseline_power_w"),
            ).alias("summary"),
            "gpu_details",
            F.coalesce("recommendations", F.array().cast("array<string>")).alias("recommendations"),
            "summary_text",
        )
    )
