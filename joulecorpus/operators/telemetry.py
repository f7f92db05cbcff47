"""GPU telemetry: unification, baselines and per-run / per-GPU statistics.

A reading is one row ``run_id, gpu_id, ts, method, name, power_w,
power_draw_w, utilization_percent, ..., error``; ``ts`` is epoch seconds.
Every aggregate is a plain ``groupBy`` with map-side partials, so a run that owns
a third of all readings still costs one small row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joulecorpus.functions import energy as en
from joulecorpus.operators.ordered import attach_latest, number_within, time_block
from joulecorpus.session import durable, join_small

# Collection methods from most to least preferred, and result messages.
METHOD_PRIORITY = ("nvidia_smi", "pynvml", "nvitop")
UNKNOWN_NAME = "Unknown"
NO_DATA = "Nenhum dado coletado"
NO_DATA_IN_PERIOD = "Nenhum dado no período especificado"

# Device units.
MILLIWATTS = 1000.0
MIB = 1024 * 1024

ARRAY_ROWS = 1024


def _present(df: DataFrame, *names: str) -> list[Column]:
    return [F.col(name) for name in names if name in df.columns]


def _first_number(df: DataFrame, preferred: str, legacy: str) -> Column:
    """The preferred field unless null or zero, else the legacy one, else 0."""
    choices = [F.nullif(c, F.lit(0.0)) for c in _present(df, preferred)] + _present(df, legacy)
    return F.coalesce(*choices, F.lit(0.0)).cast("double")


def unify_readings(df: DataFrame, keep: Sequence[str] = (), errors: str = "drop") -> DataFrame:
    """Current and legacy readings in one shape.

    Absent and null temperature, utilisation and memory count as 0.  Error
    readings are dropped, or with ``errors="flag"`` kept without any figures.
    """
    figures = {
        "name": F.coalesce(*_present(df, "name"), F.lit(UNKNOWN_NAME)),
        "power": _first_number(df, "power_w", "power_draw_w"),
        "utilization": _first_number(df, "utilization_percent", "utilization_gpu_percent"),
        "temperature": F.coalesce(*_present(df, "temperature_c"), F.lit(0.0)).cast("double"),
        "memory_used": F.coalesce(*_present(df, "memory_used_mb"), F.lit(0.0)).cast("double"),
    }
    if "error" in df.columns:
        usable = F.col("error").isNull()
        if errors == "flag":
            figures = {name: F.when(usable, c) for name, c in figures.items()}
        else:
            df = df.where(usable)
    return df.select("run_id", "gpu_id", "ts", *[c.alias(name) for name, c in figures.items()], *keep)


def explode_readings(snapshots: DataFrame) -> DataFrame:
    """Nested snapshots to one row per usable reading."""
    flat = snapshots.select(
        "run_id", F.col("timestamp").alias("snapshot_ts"), "method", F.explode("gpus").alias("_gpu")
    ).select("run_id", "snapshot_ts", "method", "_gpu.*")
    return flat.where(F.col("error").isNull()) if "error" in flat.columns else flat


def flat_readings(snapshots: DataFrame) -> DataFrame:
    """Nested snapshots to one row per reading, failed ones included: what the energy job takes.

    A reading's own time stands, else its snapshot's.  A snapshot whose readings all failed
    still counts as a snapshot, since its rows stay.
    """
    flat = snapshots.select("run_id", F.col("timestamp").alias("_time"), "method", F.explode("gpus").alias("_gpu"))
    fields = flat.schema["_gpu"].dataType.fieldNames()
    own = [F.col("_gpu.ts")] if "ts" in fields else []
    rest = [F.col(f"_gpu.{name}").alias(name) for name in fields if name not in ("ts", "run_id", "method")]
    return flat.select("run_id", "method", F.coalesce(*own, F.col("_time")).alias("ts"), *rest)


def normalize_readings(df: DataFrame, legacy: bool = False) -> DataFrame:
    """Raw device units to W and MB; the legacy form floors memory and has no nulls."""

    def mib(name: str) -> Column:
        return F.floor(F.col(name) / MIB).cast("double") if legacy else F.col(name) / MIB

    converted = {
        "power_draw_w" if legacy else "power_w": F.col("power_mw") / MILLIWATTS,
        "memory_used_mb": mib("memory_used_bytes"),
        "memory_total_mb": mib("memory_total_bytes"),
    }
    if legacy:
        converted = {name: F.coalesce(c, F.lit(0.0)) for name, c in converted.items()}
    return df.withColumns(converted).drop("power_mw", "memory_used_bytes", "memory_total_bytes")


def method_rank(method: Column) -> Column:
    """Position in the priority list from 1; unlisted methods come last."""
    ranked = F.array_position(F.array(*[F.lit(m) for m in METHOD_PRIORITY]), method)
    return F.when(ranked > 0, ranked).otherwise(F.lit(len(METHOD_PRIORITY) + 1))


def method_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(m) for m in METHOD_PRIORITY]), (rank - 1).cast("int"))


def pick_method(readings: DataFrame) -> DataFrame:
    """Keep only the readings of each run's preferred method."""
    rank = method_rank(F.col("method"))
    best = readings.groupBy("run_id").agg(F.min(rank).alias("_best"))
    return join_small(readings, best, ["run_id"]).where(rank == F.col("_best")).drop("_best")


def run_starts(readings: DataFrame) -> DataFrame:
    return readings.groupBy("run_id").agg(F.min("ts").alias("start_ts"))


def tag_phase(readings: DataFrame, baseline_s: float, starts: DataFrame | None = None) -> DataFrame:
    """Add ``start_ts`` and ``in_baseline`` (the first ``baseline_s`` of the run)."""
    starts = run_starts(readings) if starts is None else starts
    return join_small(readings, starts, ["run_id"]).withColumn(
        "in_baseline", F.col("ts") < F.col("start_ts") + F.lit(float(baseline_s))
    )


def _baseline_value(df: DataFrame) -> Column:
    counts = F.col("in_baseline")
    if "error" in df.columns:
        counts = counts & F.col("error").isNull()
    if "failed" in df.columns:
        counts = counts & ~F.col("failed")
    return F.when(counts, F.col("power_w"))


def baseline_power(tagged: DataFrame) -> DataFrame:
    """Per run the mean non-null ``power_w`` over all GPUs in the baseline phase."""
    return tagged.groupBy("run_id").agg(F.avg(_baseline_value(tagged)).alias("baseline_power_w"))


def monitored(tagged: DataFrame) -> DataFrame:
    """Readings after the baseline phase: what a run is measured on."""
    return tagged.where(~F.col("in_baseline"))


def snapshot_counts(readings: DataFrame) -> DataFrame:
    """Per run the number of snapshots: distinct times, failed readings included."""
    # Two steps, the first keyed by time, so that a hot run is spread.
    times = readings.select("run_id", "ts").distinct()
    return times.groupBy("run_id").agg(F.count(F.lit(1)).alias("total_samples"))


# Partial figures that add up across names, blocks and snapshots, with the function that
# merges them.  All are numbers: with a text among them Spark would aggregate by sorting.
_MERGE = {
    "n": F.sum,
    "last_ts": F.max,
    "power_sum": F.sum,
    "power_max": F.max,
    "power_min": F.min,
    "temperature_sum": F.sum,
    "temperature_max": F.max,
    "utilization_sum": F.sum,
    "utilization_max": F.max,
    "memory_used_sum": F.sum,
    "memory_used_max": F.max,
}


def copies(df: DataFrame) -> Column:
    """How many readings a row stands for: ``copies``, or one."""
    return F.col("copies") if "copies" in df.columns else F.lit(1)


def _partials(unified: DataFrame, *keys: str) -> DataFrame:
    """Partial figures per key and device name; a row counts as often as its ``copies`` say."""
    n = copies(unified)
    return unified.groupBy(*keys, "name").agg(
        F.sum(n).alias("n"),
        F.max("ts").alias("last_ts"),
        F.sum(F.col("power") * n).alias("power_sum"),
        F.max("power").alias("power_max"),
        F.min("power").alias("power_min"),
        F.sum(F.col("temperature") * n).alias("temperature_sum"),
        F.max("temperature").alias("temperature_max"),
        F.sum(F.col("utilization") * n).alias("utilization_sum"),
        F.max("utilization").alias("utilization_max"),
        F.sum(F.col("memory_used") * n).alias("memory_used_sum"),
        F.max("memory_used").alias("memory_used_max"),
    )


def _statistics(partials: DataFrame, keys: Sequence[str], maxima: bool = False) -> DataFrame:
    """Partial figures of the same keys added up; the latest name is kept."""
    total = partials.groupBy(*keys).agg(
        F.max_by("name", F.struct("last_ts", "name")).alias("name"),
        *[merge(name).alias(name) for name, merge in _MERGE.items()],
    )
    mean = {n: F.col(f"{n}_sum") / F.col("n") for n in ("power", "temperature", "utilization", "memory_used")}
    return total.select(
        *keys,
        mean["power"].alias("power_avg_w"),
        F.col("power_max").alias("power_max_w"),
        F.col("power_min").alias("power_min_w"),
        "name",
        F.col("n").alias("samples_count"),
        mean["temperature"].alias("temperature_avg_c"),
        F.col("temperature_max").alias("temperature_max_c"),
        mean["utilization"].alias("utilization_avg_percent"),
        mean["memory_used"].alias("memory_used_avg_mb"),
        *(
            [
                F.col("utilization_max").alias("utilization_max_percent"),
                F.col("memory_used_max").alias("memory_used_max_mb"),
            ]
            if maxima
            else []
        ),
    )


def _with_energy(stats: DataFrame) -> DataFrame:
    """Energy above the baseline; needs ``duration_s`` and ``baseline_power_w``."""
    above = F.greatest(F.lit(0.0), F.col("power_avg_w") - F.coalesce("baseline_power_w", F.lit(0.0)))
    return (
        stats.withColumn("power_baseline_adjusted_w", above)
        .withColumn("energy_consumed_wh", F.col("power_baseline_adjusted_w") * en.hours(F.col("duration_s")))
        .withColumn("energy_consumed_kwh", F.col("energy_consumed_wh") / 1000.0)
    )


def gpu_stats(unified: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run and GPU statistics; ``runs`` has ``run_id, duration_s, baseline_power_w``."""
    stats = _statistics(_partials(unified, "run_id", "gpu_id"), ["run_id", "gpu_id"])
    facts = runs.select("run_id", "duration_s", "baseline_power_w")
    return _with_energy(stats.join(facts, "run_id")).drop("duration_s", "baseline_power_w")


def gpu_stats_full(unified: DataFrame, runs: DataFrame) -> DataFrame:
    """As ``gpu_stats`` over a full run, plus maxima.

    Here ``energy_consumed_wh`` is raw, while ``energy_consumed_kwh`` and the
    ``baseline_adjusted`` pair are above the baseline.
    """
    stats = _statistics(_partials(unified, "run_id", "gpu_id"), ["run_id", "gpu_id"], maxima=True)
    facts = runs.select("run_id", "duration_s", "baseline_power_w")
    return (
        _with_energy(stats.join(facts, "run_id"))
        .withColumn("energy_consumed_baseline_adjusted_wh", F.col("energy_consumed_wh"))
        .withColumn("energy_consumed_baseline_adjusted_kwh", F.col("energy_consumed_kwh"))
        .withColumn("energy_consumed_wh", F.col("power_avg_w") * en.hours(F.col("duration_s")))
        .drop("duration_s", "baseline_power_w")
    )


def run_facts(tagged: DataFrame) -> DataFrame:
    """Everything per run that needs all readings, from one scan and one wide shuffle.

    ``total_duration_s`` spans the whole run, ``duration_s`` and ``total_samples``
    the monitored part; a run that never left the baseline phase has 0 samples.
    """
    value = _baseline_value(tagged)
    after = ~F.col("in_baseline")
    method = F.col("method") if "method" in tagged.columns else F.lit(None).cast("string")
    # First by time, so that a hot run is spread and copies of a time collapse.
    by_time = tagged.groupBy("run_id", "ts").agg(
        F.min("start_ts").alias("start_ts"),
        F.min(F.when(after, method_rank(method))).alias("_rank"),
        F.sum(value * copies(tagged)).alias("_sum"),
        F.sum(F.when(value.isNotNull(), copies(tagged)).otherwise(0)).alias("_n"),
        F.bool_or(after).alias("_after"),
    )
    monitored_ts = F.when(F.col("_after"), F.col("ts"))
    return by_time.groupBy("run_id").agg(
        (F.max("ts") - F.min("start_ts")).alias("total_duration_s"),
        (F.max(monitored_ts) - F.min(monitored_ts)).alias("duration_s"),
        F.count(monitored_ts).alias("total_samples"),
        (F.sum("_sum") / F.nullif(F.sum("_n"), F.lit(0))).alias("baseline_power_w"),
        method_name(F.min("_rank")).alias("method"),
    )


def run_summary(
    facts: DataFrame,
    runs: DataFrame,
    markers: DataFrame,
    sampling_interval_s: float = 1.0,
    high_precision: bool = True,
) -> DataFrame:
    """One row per run of ``runs``; a run without monitored data becomes an error row."""
    noted = markers.groupBy("run_id").agg(F.count(F.lit(1)).alias("sync_markers"))
    samples = F.coalesce("total_samples", F.lit(0))
    return (
        runs.select("run_id")
        .join(facts, "run_id", "left")
        .join(noted, "run_id", "left")
        .select(
            "run_id",
            F.when(samples == 0, F.lit(NO_DATA)).alias("error"),
            F.col("method").alias("monitoring_method"),
            F.coalesce("duration_s", F.lit(0.0)).alias("monitoring_duration_s"),
            samples.alias("total_samples"),
            F.lit(sampling_interval_s).alias("sampling_interval_s"),
            "baseline_power_w",
            F.coalesce("sync_markers", F.lit(0)).alias("sync_markers"),
            F.lit(high_precision).alias("high_precision_enabled"),
        )
    )


def gpu_sample_arrays(
    unified: DataFrame, order: Sequence[str] = ("ts",), rows: int = ARRAY_ROWS, block_s: float = 3600.0
) -> DataFrame:
    """Samples per GPU in time order, as arrays of at most ``rows`` entries.

    Chunks of one GPU, counted from 0, concatenate to its whole series.  Readings are
    numbered by time block plus an offset per block; nothing is sorted as a whole.
    """
    numbered = number_within(unified, ["run_id", "gpu_id"], "ts", order, block_s, "_place")
    chunked = numbered.withColumn("chunk", F.floor((F.col("_place") - 1) / rows))
    entry = F.struct("_place", "ts", "power", "temperature", "utilization", "memory_used", "name")
    series = chunked.groupBy("run_id", "gpu_id", "chunk").agg(F.array_sort(F.collect_list(entry)).alias("_s"))
    return series.select(
        "run_id",
        "gpu_id",
        "chunk",
        F.col("_s.power").alias("power_samples_w"),
        F.col("_s.temperature").alias("temperature_samples_c"),
        F.col("_s.utilization").alias("utilization_gpu_samples"),
        F.col("_s.memory_used").alias("memory_used_samples_mb"),
        F.element_at("_s.name", -1).alias("name"),
    )


def metrics_since(
    unified: DataFrame, runs: DataFrame, snapshots: DataFrame, since: float, now: float
) -> DataFrame:
    """Per-GPU statistics since a time; runs without data in the period give an error row.

    ``runs`` holds ``run_id, baseline_power_w``; ``snapshots`` is any frame with
    the time of every snapshot of a run.
    """
    recent = F.col("ts") >= F.lit(since)
    facts = runs.select("run_id", "baseline_power_w", F.lit(now - since).alias("duration_s"))
    stats = gpu_stats(unified.where(recent), facts)
    seen = snapshot_counts(snapshots.where(recent))
    return (
        facts.select("run_id", "duration_s", "baseline_power_w")
        .join(seen, "run_id", "left")
        .join(stats, "run_id", "left")
        .withColumn("error", F.when(F.col("total_samples").isNull(), F.lit(NO_DATA_IN_PERIOD)))
        .withColumn("total_samples", F.coalesce("total_samples", F.lit(0)))
    )


def run_totals(stats: DataFrame) -> DataFrame:
    """Sums over the GPUs of a run."""
    return stats.groupBy("run_id").agg(
        F.sum("energy_consumed_kwh").alias("total_energy_consumed_kwh"),
        F.sum("power_avg_w").alias("avg_power_w"),
        F.max("temperature_max_c").alias("max_temperature_c"),
    )


def final_metrics(totals: DataFrame, progress: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Whole-run figures; ``progress`` has ``run_id, total_duration_s, total_steps, total_epochs``.

    ``errors`` (``run_id, error``) passes failed runs through as error rows.
    """
    kwh, steps = F.col("total_energy_consumed_kwh"), F.col("total_steps")
    metrics = (
        progress.join(totals, "run_id", "inner" if errors is None else "left")
        .withColumn("energy_per_step_wh", kwh * 1000.0 / F.greatest(F.lit(1), steps))
        .withColumn("energy_per_epoch_kwh", kwh / F.greatest(F.lit(1.0), F.col("total_epochs")))
        .withColumn("energy_efficiency_score", en.efficiency_score(kwh, steps, F.col("total_duration_s")))
        .withColumn("carbon_footprint_estimate_kg", en.carbon_kg(kwh))
    )
    if errors is None:
        return metrics
    figures = [name for name in metrics.columns if name != "run_id"]
    failed = metrics.join(errors.select("run_id", "error"), "run_id", "full")
    return failed.select(
        "run_id", "error", *[F.when(F.col("error").isNull(), F.col(n)).alias(n) for n in figures]
    )


# Limits and wording of the recommendations.
POWER_LIMIT_W = 300.0
TEMPERATURE_LIMIT_C = 80.0
POWER_ADVICE = "gpu_%s: Alto consumo (%.1fW) - considere otimização"
TEMPERATURE_ADVICE = "gpu_%s: Temperatura alta (%.1f°C) - verificar resfriamento"


def recommendations(
    stats: DataFrame, power_limit: float = POWER_LIMIT_W, temperature_limit: float = TEMPERATURE_LIMIT_C
) -> DataFrame:
    """One row per advice."""
    advice = F.array(
        F.when(
            F.col("power_avg_w") > power_limit,
            F.format_string(POWER_ADVICE, "gpu_id", en.fixed(F.col("power_avg_w"), 1)),
        ),
        F.when(
            F.col("temperature_max_c") > temperature_limit,
            F.format_string(TEMPERATURE_ADVICE, "gpu_id", en.fixed(F.col("temperature_max_c"), 1)),
        ),
    )
    return stats.select("run_id", "gpu_id", F.explode(F.array_compact(advice)).alias("recommendation"))


# Blocks that make one block of the next level, and levels: a minute, an hour, two and a half days.
LEVEL_FACTOR = 60
LEVELS = 3


def _levelled(first: Column, last: Column) -> Column:
    """``[first, last)`` blocks as few blocks of several levels: an array of (level, block)."""

    def run(level: int, low: Column, high: Column) -> Column:
        none = F.array().cast("array<struct<level:int,block:bigint>>")
        numbers = F.sequence(low.cast("bigint"), (high - 1).cast("bigint"))
        of = F.transform(numbers, lambda x: F.struct(F.lit(level).alias("level"), x.alias("block")))
        return F.when(low < high, of).otherwise(none)

    def cover(level: int, low: Column, high: Column) -> Column:
        if level == LEVELS - 1:
            return run(level, low, high)
        up, down = F.ceil(low / LEVEL_FACTOR), F.floor(high / LEVEL_FACTOR)
        inside = F.concat(
            run(level, low, up * LEVEL_FACTOR), cover(level + 1, up, down), run(level, down * LEVEL_FACTOR, high)
        )
        return F.when(up < down, inside).otherwise(run(level, low, high))

    return cover(0, first, last)


def period_stats(unified: DataFrame, periods: DataFrame, baselines: DataFrame, block_s: float = 60.0) -> DataFrame:
    """Per-GPU statistics of many closed periods ``run_id, workload, start_ts, end_ts``.

    Periods are cut into time blocks of several lengths, so a long one meets few of them.
    Blocks wholly inside a period are met with per-block partial aggregates, only the
    blocks at its two ends with readings; both are equi-joins on run and block.
    """
    periods = durable(periods.select("run_id", "workload", "start_ts", "end_ts"))  # read twice
    first, last = (time_block(F.col(name), block_s) for name in ("start_ts", "end_ts"))
    blocked = unified.withColumn("block", time_block(F.col("ts"), block_s))
    level = durable(_partials(blocked, "run_id", "block", "gpu_id"))
    levels = [level.withColumn("level", F.lit(0))]
    for number in range(1, LEVELS):  # each from the one below, a fraction of its size
        up = levels[-1].withColumn("block", F.floor(F.col("block") / LEVEL_FACTOR))
        up = up.groupBy("run_id", "block", "gpu_id", "name").agg(*[merge(name).alias(name) for name, merge in _MERGE.items()])
        levels.append(up.withColumn("level", F.lit(number)))
    per_block = reduce(DataFrame.unionByName, levels)
    keys = ["run_id", "workload", "start_ts", "end_ts", "gpu_id"]
    inner = periods.where(last - first >= 2).select(*periods.columns, F.inline(_levelled(first + 1, last)))
    whole = inner.join(per_block, ["run_id", "level", "block"]).select(*keys, "name", *_MERGE)
    ends = periods.withColumn("block", F.explode(F.array_distinct(F.array(first, last))))
    inside = join_small(blocked, ends, ["run_id", "block"]).where(F.col("ts").between(F.col("start_ts"), F.col("end_ts")))
    edges = _partials(inside, *keys)
    stats = _statistics(whole.unionByName(edges), keys).withColumn("duration_s", F.col("end_ts") - F.col("start_ts"))
    return _with_energy(stats.join(baselines.select("run_id", "baseline_power_w"), "run_id")).drop("baseline_power_w")


def workload_compare(stats: DataFrame) -> DataFrame:
    """Per workload period: Wh over all GPUs, Wh per second, and the most efficient of the run."""
    per_period = stats.groupBy("run_id", "workload").agg(
        F.max("duration_s").alias("duration_s"), F.sum("energy_consumed_wh").alias("energy_wh")
    )
    rated = per_period.withColumn(
        "efficiency_wh_per_s",
        F.when(F.col("duration_s") > 0, F.col("energy_wh") / F.col("duration_s")).otherwise(F.lit(0.0)),
    )
    best = rated.groupBy("run_id").agg(
        F.min_by("workload", F.struct("efficiency_wh_per_s", "workload")).alias("most_efficient")
    )
    return rated.join(best, "run_id").withColumn(
        "is_most_efficient", F.col("workload") == F.col("most_efficient")
    ).drop("most_efficient")


def sync_markers(events: DataFrame) -> DataFrame:
    """Marker rows; absent metadata becomes an empty map."""
    empty = F.create_map().cast("map<string,string>")
    given = F.col("metadata") if "metadata" in events.columns else F.lit(None).cast("map<string,string>")
    return events.select(
        "run_id",
        F.col("ts").alias("timestamp"),
        "type",
        *[
            (F.col(n) if n in events.columns else F.lit(None)).cast(kind).alias(n)
            for n, kind in (("step", "bigint"), ("epoch", "double"))
        ],
        F.coalesce(given, empty).alias("metadata"),
    )


def marker_energy(
    unified: DataFrame, markers: DataFrame, baselines: DataFrame, ends: DataFrame, block_s: float = 60.0
) -> DataFrame:
    """Per-GPU statistics of the stretch from each marker to the next one.

    ``markers`` has ``run_id, ts, step``; ``ends`` (``run_id, end_ts``) closes the
    last stretch of a run.  Readings before the first marker belong to none.
    """
    marks = durable(markers.select("run_id", "ts", F.struct("ts", "step").alias("marker")))  # read four times
    # Copies of a reading time collapse before rows are ordered within a block.
    partials = _partials(unified, "run_id", "gpu_id", "ts")
    tagged = attach_latest(partials, marks, ["run_id"], "ts", "marker", block_s, times=unified)
    return stretch_energy(tagged, marks, baselines, ends, block_s)


def stretch_energy(tagged: DataFrame, marks: DataFrame, baselines: DataFrame, ends: DataFrame, block_s: float) -> DataFrame:
    """Statistics of partial figures tagged with their ``marker``; ``marks`` has ``run_id, ts, marker``."""
    stats = _statistics(tagged.where(F.col("marker").isNotNull()), ["run_id", "marker", "gpu_id"])
    following = attach_next_marker(marks, block_s).join(ends, "run_id", "left")
    spans = following.select(
        "run_id", "marker", (F.coalesce("next_ts", "end_ts") - F.col("marker.ts")).alias("duration_s")
    )
    joined = stats.join(spans, ["run_id", "marker"]).join(baselines.select("run_id", "baseline_power_w"), "run_id")
    rated = _with_energy(joined)
    return rated.select(
        "run_id",
        F.col("marker.step").alias("marker_step"),
        F.col("marker.ts").alias("marker_ts"),
        *[n for n in rated.columns if n not in ("run_id", "marker", "baseline_power_w")],
    )


def attach_next_marker(marks: DataFrame, block_s: float) -> DataFrame:
    """Each marker with the time of the following one, by time block plus carry."""
    blocked = marks.withColumn("_block", time_block(F.col("ts"), block_s))
    inside = Window.partitionBy("run_id", "_block").orderBy("marker")
    firsts = blocked.groupBy("run_id", "_block").agg(F.min("ts").alias("_first"))
    later = Window.partitionBy("run_id").orderBy("_block")
    carried = firsts.select("run_id", "_block", F.lead("_first").over(later).alias("_later"))
    return (
        blocked.withColumn("_next", F.lead("ts").over(inside))
        .join(carried, ["run_id", "_block"])
        .select("run_id", "ts", "marker", F.coalesce("_next", "_later").alias("next_ts"))
    )
