"""The energy job: readings, steps and markers to statistics, windows and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joulecorpus.config import SyncConfig
from joulecorpus.operators import partials, report, sync, telemetry
from joulecorpus.session import as_table, durable
from joulecorpus.sinks import writers


def progress(facts: DataFrame, steps: DataFrame) -> DataFrame:
    """Duration, last step and epochs of every run."""
    last = steps.groupBy("run_id").agg(F.max("step").alias("total_steps"), F.max("epoch").alias("total_epochs"))
    return facts.join(last, "run_id", "left").select(
        "run_id",
        "total_duration_s",
        F.coalesce("total_steps", F.lit(0)).alias("total_steps"),
        F.coalesce("total_epochs", F.lit(0.0)).alias("total_epochs"),
    )


def windows(tagged: DataFrame, steps: DataFrame, starts: DataFrame, config: SyncConfig = SyncConfig()) -> DataFrame:
    """Reported windows with their pooled figures, from tagged partials of readings."""
    measured = telemetry.monitored(tagged)
    fired = sync.sync_windows(steps, measured.where(~F.col("failed")), starts, config)
    return sync.window_metrics(fired, measured, config)


def energy_tables(
    readings: DataFrame,
    steps: DataFrame,
    markers: DataFrame,
    runs: DataFrame | None = None,
    config: SyncConfig = SyncConfig(),
) -> dict[str, DataFrame]:
    """Every result table of the job, by name, from one scan of the raw readings."""
    return tables_of_partials(as_table(partials.reading_partials(readings), "partials"), steps, markers, runs, config)


def tables_of_partials(
    readings: DataFrame,
    steps: DataFrame,
    markers: DataFrame,
    runs: DataFrame | None = None,
    config: SyncConfig = SyncConfig(),
) -> dict[str, DataFrame]:
    """Every result table of the job, from a table of ``partials.reading_partials``; small tables read twice are materialised."""
    starts = durable(telemetry.run_starts(readings))
    tagged = telemetry.tag_phase(readings, config.baseline_s, starts)
    facts = durable(telemetry.run_facts(tagged))
    unified = telemetry.monitored(tagged).where(~F.col("failed"))
    gpus = durable(telemetry.gpu_stats_full(unified, facts))
    final = telemetry.final_metrics(telemetry.run_totals(gpus), progress(facts, steps))
    summary = telemetry.run_summary(
        facts, starts if runs is None else runs, markers, config.sampling_interval_s, config.high_precision
    )
    reported = durable(windows(tagged, steps, starts, config))
    intervals, logged = sync.interval_metrics(reported), sync.step_metrics(reported)
    advice = telemetry.recommendations(gpus)
    return {
        "gpu_stats": gpus,
        "unified_readings": partials.expanded(unified),
        "run_summary": summary,
        "final_metrics": final,
        "interval_metrics": intervals,
        "step_metrics": logged,
        "history_counts": sync.history_counts(reported),
        "metrics_long": report.metrics_long(intervals, logged, final, summary, gpus),
        "energy_report": report.energy_report(summary, gpus, advice, final),
    }


def energy_job(tables: dict[str, DataFrame], output_dir: str) -> dict[str, str]:
    """Write the history, the full measurement, the long-form metrics and the reports.

    Output folders accumulate over calls; a run that is written again replaces itself, also where it has
    no rows any more.
    """
    base = output_dir.rstrip("/")
    asked = tables["run_summary"].select("run_id")
    outputs = ("energy_step_history", "energy_interval_history", "energy_monitoring_summary", "metrics_long", "energy_report")
    for name in (*outputs, "energy_data/run_summary", "energy_data/gpu_statistics", "energy_data/gpu_samples"):
        writers.clear_runs(asked.sparkSession, f"{base}/{name}", asked)
    paths = writers.write_energy_history(
        tables["step_metrics"], tables["interval_metrics"], tables["history_counts"], base
    )
    samples = telemetry.gpu_sample_arrays(tables["unified_readings"])
    paths |= writers.write_energy_data(tables["run_summary"], tables["gpu_stats"], samples, base)
    writers.by_run(tables["metrics_long"]).parquet(f"{base}/metrics_long")
    paths["metrics_long"] = f"{base}/metrics_long"
    paths["energy_report"] = writers.write_report(tables["energy_report"], f"{base}/energy_report")
    return paths
