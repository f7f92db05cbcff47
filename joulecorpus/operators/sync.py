"""Step- and time-synchronised energy windows.

A run is cut greedily: a step end that lies ``interval_s`` after the last cut
becomes the next cut, and every ``logging_steps``-th step is reported in between.
Which steps are cuts depends on all earlier cuts, but a block of consecutive
steps is only a function "last cut before the block -> last cut after it", a step
function with few steps: the first cut inside a block must be a step of the block's
first interval (or the first step after it, or after the first usable reading).  Such
functions join into one for the blocks together.  So:

1. every block computes its function, in parallel;
2. functions are joined a few blocks at a time, up a tree, and the cuts are handed down
   again, which gives every block its incoming cut; no task sees a whole run;
3. every block replays its own steps, in parallel.

Readings never take part in the sequential part.  They are reduced to one row per
snapshot, then to one row per stretch between reported steps, and windows are
running totals of stretches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joulecorpus.config import SyncConfig
from joulecorpus.functions import energy as en
from joulecorpus.operators.ordered import attach_latest, attach_next, time_block
from joulecorpus.operators.telemetry import copies
from joulecorpus.session import durable

_NEVER = float("-inf")

# Blocks that are joined into one at a time.
FAN = 32


def _first_reached(t: np.ndarray, ok: np.ndarray, cut: np.ndarray, interval: float) -> np.ndarray:
    """Index of the first step that may follow each cut; ``len(t)`` if none.

    Both the elapsed time and the latest usable reading grow along a block, so
    two binary searches decide.  The time test is ``t - cut >= interval`` as
    written; neighbours are corrected where rounding of the sum differs.
    """
    at = np.searchsorted(t, cut + interval, side="left")
    back = (at > 0) & (t[np.maximum(at - 1, 0)] - cut >= interval)
    at = np.where(back, at - 1, at)
    ahead = (at < len(t)) & (t[np.minimum(at, len(t) - 1)] - cut < interval)
    at = np.where(ahead, at + 1, at)
    return np.maximum(at, np.searchsorted(ok, cut, side="left"))


# A block is a function of the cut before it: up to each limit the block's last cut is the one
# stated, and beyond the last limit the cut before it stays.  Kept as two ascending lists, with
# the time that no cut before the block exceeds.
_MAP = "limits array<double>, exits array<double>, first double"


def _block_map(t: np.ndarray, ok: np.ndarray, interval: float) -> tuple[np.ndarray, np.ndarray]:
    """The function of one block of steps."""
    follow = _first_reached(t, ok, t, interval)
    exit_at = np.arange(len(t))
    # Follow the cuts to the last one; the reach doubles each time.
    ahead = np.append(follow, len(t))
    while (ahead[exit_at] < len(t)).any():
        exit_at = np.where(ahead[exit_at] < len(t), ahead[exit_at], exit_at)
        ahead = np.where(ahead[ahead] < len(t), ahead[ahead], ahead)
    # The latest cut from which each step can be the next one, if no earlier step is.
    limit = np.minimum(_latest_cut(t, interval), ok)
    grows = limit > np.concatenate([[_NEVER], np.maximum.accumulate(limit)[:-1]])
    # A cut lies before the block, so limits beyond its first step never matter.
    limits, exits = limit[grows], t[exit_at][grows]
    enough = int(np.searchsorted(limits, t[0], side="left")) + 1
    return limits[:enough], exits[:enough]


def _latest_cut(t: np.ndarray, interval: float) -> np.ndarray:
    """The largest cut with ``t - cut >= interval``, as that is computed."""
    cut = t - interval
    for _ in range(3):
        cut = np.where(t - cut >= interval, cut, np.nextafter(cut, _NEVER))
    for _ in range(3):
        more = np.nextafter(cut, np.inf)
        cut = np.where(t - more >= interval, more, cut)
    return cut


def _apply(limits: np.ndarray, exits: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    at = np.searchsorted(limits, cuts, side="left")
    return np.where(at < len(limits), np.append(exits, 0.0)[np.minimum(at, len(exits))], cuts)


def _joined_maps(maps: list[tuple[np.ndarray, np.ndarray]], first: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """The function of consecutive blocks together, for cuts up to ``first``."""
    limits, exits = maps[0]
    for more, out in maps[1:]:
        exits = _apply(more, out, exits)
        beyond = more > (limits[-1] if len(limits) else _NEVER)
        limits, exits = np.concatenate([limits, more[beyond]]), np.concatenate([exits, out[beyond]])
        enough = int(np.searchsorted(limits, first, side="left")) + 1
        limits, exits = limits[:enough], exits[:enough]
    return limits, exits


def _maps(pdf: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    pdf = pdf.sort_values("block")
    return [(np.asarray(a, float), np.asarray(b, float)) for a, b in zip(pdf["limits"], pdf["exits"])]


def _make_maps(interval: float):
    """Step 1: the function of every block."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "step"], kind="stable")
        limits, exits = _block_map(pdf["ts"].to_numpy(), pdf["last_ok"].to_numpy(), interval)
        return pd.DataFrame({"run_id": pdf["run_id"].iloc[:1].to_numpy(), "block": pdf["block"].iloc[:1].to_numpy(), "limits": [limits], "exits": [exits], "first": pdf["ts"].iloc[:1].to_numpy()})

    return make


def _merge_maps(pdf: pd.DataFrame) -> pd.DataFrame:
    """Step 2, upwards: the function of a parent block."""
    pdf = pdf.sort_values("block")
    first = pdf["first"].iloc[:1].to_numpy()
    limits, exits = _joined_maps(_maps(pdf), float(first[0]))
    return pd.DataFrame({"run_id": pdf["run_id"].iloc[:1].to_numpy(), "block": pdf["parent"].iloc[:1].to_numpy(), "limits": [limits], "exits": [exits], "first": first})


def _hand_down(pdf: pd.DataFrame) -> pd.DataFrame:
    """Step 2, downwards: the incoming cut of every child, given that of the parent."""
    pdf = pdf.sort_values("block")
    cuts, cut = [], pdf["incoming"].iloc[:1].to_numpy()
    for limits, exits in _maps(pdf):
        cuts.append(float(cut[0]))
        cut = _apply(limits, exits, cut)
    return pd.DataFrame({"run_id": pdf["run_id"].to_numpy(), "block": pdf["block"].to_numpy(), "incoming": cuts})


def _incoming_cuts(maps: DataFrame, starts: DataFrame, run_type: str) -> DataFrame:
    """``run_id, block, incoming``: the last cut before every block.

    Blocks are joined ``FAN`` at a time until each run is one, and the cuts are then
    handed down the same way, so no task sees more than ``FAN`` blocks of a run.
    """
    # A run may start after its first steps.
    start = starts.groupBy("run_id").agg(F.max("start_ts").alias("_start"))
    levels = [durable(maps.join(start, "run_id", "left").withColumn("first", F.greatest("first", "_start")).drop("_start"))]
    top = levels[0].agg(F.max("block")).first()[0] or 0
    schema = f"run_id {run_type}, block bigint, {_MAP}"
    while top > 0:
        parents = levels[-1].withColumn("parent", F.floor(F.col("block") / FAN))
        levels.append(durable(parents.groupBy("run_id", "parent").applyInPandas(_merge_maps, schema)))
        top //= FAN
    incoming = starts.select("run_id", F.lit(0).cast("bigint").alias("block"), F.col("start_ts").alias("incoming"))
    for level in reversed(levels[:-1]):
        parent = incoming.withColumnRenamed("block", "parent")
        children = level.withColumn("parent", F.floor(F.col("block") / FAN)).join(parent, ["run_id", "parent"])
        incoming = children.groupBy("run_id", "parent").applyInPandas(_hand_down, f"run_id {run_type}, block bigint, incoming double")
    return incoming


def _replay(interval: float, logging_steps: int):
    """Step 3: the reported steps of a block, given its incoming cut."""

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "step"], kind="stable").reset_index(drop=True)
        t, ok = pdf["ts"].to_numpy(), pdf["last_ok"].to_numpy()
        since = np.empty(len(t))
        cut, done = pdf["incoming"].iloc[0], 0
        while done < len(t):
            nxt = int(_first_reached(t, ok, np.array([cut]), interval)[0])
            upto = max(nxt, done) + 1
            since[done:upto] = cut
            if nxt >= len(t):
                break
            done, cut = upto, t[nxt]
        pdf["last_sync"] = since
        pdf["by_time"] = t - since >= interval
        pdf["by_step"] = pdf["step"] % logging_steps == 0
        fired = pdf[(pdf["by_time"] | pdf["by_step"]) & (ok >= since)].copy()
        fired["before"] = fired["step"].shift(1).astype("Int64")
        return fired[["run_id", "block", "step", "ts", "epoch", "last_sync", "by_time", "by_step", "before"]]

    return replay


def sync_windows(
    steps: DataFrame, readings: DataFrame, starts: DataFrame, config: SyncConfig = SyncConfig()
) -> DataFrame:
    """Reported steps with the window they cover.

    ``steps`` is ``run_id, step, ts, epoch`` with distinct step numbers per run
    that grow with time,
    ``readings`` ``run_id, ts`` and optionally ``error``, ``starts``
    ``run_id, start_ts``.  Gives ``last_sync`` (start of the window), ``last_step``
    (previously reported step), ``by_time`` and ``by_step``.
    """
    usable = readings.where(F.col("error").isNull()) if "error" in readings.columns else readings
    seen = usable.select("run_id", "ts").distinct().withColumn("last_ok", F.col("ts"))
    run_type, step_type = steps.schema["run_id"].dataType.simpleString(), steps.schema["step"].dataType.simpleString()
    timed = durable(
        attach_latest(
            steps.select("run_id", "step", "ts", "epoch"), seen, ["run_id"], "ts", "last_ok", config.block_s
        ).withColumn("last_ok", F.coalesce("last_ok", F.lit(_NEVER)))
    )
    blocked = timed.withColumn("block", F.floor(F.col("step") / config.block_rows))
    maps = blocked.groupBy("run_id", "block").applyInPandas(
        _make_maps(config.interval_s), f"run_id {run_type}, block bigint, {_MAP}"
    )
    incoming = _incoming_cuts(maps, starts, run_type)
    fired = durable(
        blocked.join(incoming, ["run_id", "block"])
        .groupBy("run_id", "block")
        .applyInPandas(
            _replay(config.interval_s, config.logging_steps),
            f"run_id {run_type}, block bigint, step {step_type}, ts double, epoch double, last_sync double, "
            "by_time boolean, by_step boolean, before bigint",
        )
    )
    last = fired.groupBy("run_id", "block").agg(F.max("step").alias("_last"))
    earlier = Window.partitionBy("run_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("run_id", "block", F.max("_last").over(earlier).alias("_carried"))
    return fired.join(carried, ["run_id", "block"]).select(
        "run_id",
        "step",
        "ts",
        "epoch",
        "last_sync",
        F.coalesce(F.col("before").cast(step_type), F.col("_carried"), F.lit(0)).alias("last_step"),
        "by_time",
        "by_step",
    )


# How partial figures add up to those of a stretch or window.  Names are kept out of these
# sums and only collected once a stretch has one row per name.
_MERGE = {
    "snapshots": F.sum,
    "usable_snapshots": F.sum,
    "n": F.sum,
    "power_sum": F.sum,
    "power_max": F.max,
    "power_min": F.min,
    "temperature_sum": F.sum,
    "temperature_max": F.max,
    "utilization_sum": F.sum,
    "memory_sum": F.sum,
}


def snapshot_partials(flagged: DataFrame) -> DataFrame:
    """Pooled partial figures per run, time and device name.

    ``flagged`` is ``unify_readings(..., errors="flag")``: failed readings have no
    name and no figures, but their time counts as a snapshot.  A row counts as often as
    its ``copies`` say.
    """
    n = copies(flagged)
    return flagged.groupBy("run_id", "ts", "name").agg(
        F.sum(F.when(F.col("power").isNotNull(), n).otherwise(0)).alias("n"),
        F.sum(F.col("power") * n).alias("power_sum"),
        F.max("power").alias("power_max"),
        F.min("power").alias("power_min"),
        F.sum(F.col("temperature") * n).alias("temperature_sum"),
        F.max("temperature").alias("temperature_max"),
        F.sum(F.col("utilization") * n).alias("utilization_sum"),
        F.sum(F.col("memory_used") * n).alias("memory_sum"),
    )


def stretch_partials(flagged: DataFrame, points: DataFrame, block_s: float) -> DataFrame:
    """Partial figures between reported times: ``whole``, and ``at_end`` exactly at the later one.

    ``points`` is ``run_id, ts, point`` with ``point = ts``.
    """
    placed = attach_next(
        snapshot_partials(flagged), points, ["run_id"], "ts", "point", block_s,
        times=flagged, first_of_time=("n", "first"),
    ).where(F.col("point").isNotNull())
    first = F.col("first").cast("int")
    counted = placed.withColumns(
        {
            "snapshots": first,
            "usable_snapshots": F.when(F.col("n") > 0, first).otherwise(0),
            "at_point": F.col("ts") == F.col("point"),
        }
    )
    per_name = counted.groupBy("run_id", "point", "at_point", "name").agg(
        *[merge(name).alias(name) for name, merge in _MERGE.items()]
    )

    def pooled(part: Column | None) -> Column:
        def of(name: str) -> Column:
            return F.col(name) if part is None else F.when(part, F.col(name))

        return F.struct(
            *[merge(of(name)).alias(name) for name, merge in _MERGE.items()], F.collect_set(of("name")).alias("names")
        )

    return per_name.groupBy("run_id", "point").agg(
        pooled(None).alias("whole"), pooled(F.col("at_point")).alias("at_end")
    )


def window_metrics(fired: DataFrame, flagged: DataFrame, config: SyncConfig = SyncConfig()) -> DataFrame:
    """Pooled figures of every reported window, closed at both ends.

    Each snapshot goes to the first reported time at or after it, and the
    stretches between reported times are summed.  A window is the running total
    of its stretches plus the snapshots exactly at its opening cut, which belong
    to both neighbours.
    """
    points = fired.select("run_id", "ts").distinct().withColumn("point", F.col("ts"))
    # Small, one row per reported time, and read twice below.
    stretch = durable(stretch_partials(flagged, points, config.block_s))

    # Running totals within an epoch, one row per reported time of that epoch: inside a time
    # block, plus what the epoch's earlier blocks hold.  An epoch may be a whole run.
    epoch = ["run_id", "last_sync"]
    rows = (
        fired.where(F.col("ts") > F.col("last_sync"))
        .select(*epoch, "ts")
        .distinct()
        .join(stretch.select("run_id", F.col("point").alias("ts"), "whole"), ["run_id", "ts"], "left")
        .select(*epoch, "ts", time_block(F.col("ts"), config.block_s).alias("block"), "whole.*")
    )
    by_block = rows.groupBy(*epoch, "block").agg(*[merge(name).alias(name) for name, merge in _MERGE.items()])
    earlier = Window.partitionBy(*epoch).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_block.select(*epoch, "block", F.struct(*[f(name).over(earlier).alias(name) for name, f in _MERGE.items()]).alias("carried"))
    upto = Window.partitionBy(*epoch, "block").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.struct(*[f(name).over(upto).alias(name) for name, f in _MERGE.items()])
    epochs = rows.select(*epoch, "block", "ts", own.alias("own")).join(carried, [*epoch, "block"]).drop("block")
    # A name belongs to every window of its epoch from its first appearance on.
    first_seen = rows.select(*epoch, "ts", F.explode("names").alias("name")).groupBy(*epoch, "name").agg(F.min("ts").alias("since"))
    appeared = first_seen.groupBy(*epoch).agg(F.collect_list(F.struct("since", "name")).alias("appeared"))
    opening = stretch.select("run_id", F.col("point").alias("last_sync"), F.col("at_end").alias("opening"))
    joined = fired.join(epochs, [*epoch, "ts"], "left").join(opening, epoch, "left").join(appeared, epoch, "left")

    def total(name: str) -> Column:
        parts = [F.col(f"{part}.{name}") for part in ("own", "carried", "opening")]
        if _MERGE[name] is F.max:
            return F.greatest(*parts)
        if _MERGE[name] is F.min:
            return F.least(*parts)
        return sum((F.coalesce(part, F.lit(0)) for part in parts[1:]), F.coalesce(parts[0], F.lit(0)))

    nothing = F.array().cast("array<string>")
    seen = F.transform(F.filter("appeared", lambda x: x["since"] <= F.col("ts")), lambda x: x["name"])
    names = F.array_union(F.coalesce(seen, nothing), F.coalesce("opening.names", nothing))
    summed = joined.select(
        *fired.columns, *[total(name).alias(name) for name in _MERGE], F.array_sort(names).alias("names")
    )
    duration = F.col("ts") - F.col("last_sync")
    return summed.select(
        "run_id",
        F.col("ts").alias("timestamp"),
        "step",
        "epoch",
        (F.col("power_sum") / F.col("n")).alias("power_avg_w"),
        F.col("power_max").alias("power_max_w"),
        F.col("power_min").alias("power_min_w"),
        (F.col("power_sum") / F.col("n") * en.hours(duration)).alias("energy_consumed_wh"),
        (F.col("temperature_sum") / F.col("n")).alias("temperature_avg_c"),
        F.col("temperature_max").alias("temperature_max_c"),
        (F.col("utilization_sum") / F.col("n")).alias("utilization_avg_percent"),
        (F.col("memory_sum") / F.col("n")).alias("memory_used_avg_mb"),
        F.array_join("names", ", ").alias("gpu_name"),
        duration.alias("duration_s"),
        F.col("snapshots").alias("samples_count"),
        (F.col("power_sum") / F.col("usable_snapshots") * en.hours(duration)).alias("energy_all_gpus_wh"),
        "last_sync",
        "last_step",
        "by_time",
        "by_step",
    )


def interval_metrics(windows: DataFrame) -> DataFrame:
    """Windows closed by time, with Wh per step."""
    steps = F.greatest(F.lit(1), F.col("step") - F.col("last_step"))
    return windows.where("by_time").withColumn("efficiency_wh_per_step", F.col("energy_consumed_wh") / steps)


def step_metrics(windows: DataFrame) -> DataFrame:
    """Windows reported by step count, with Wh per step and efficiency."""
    steps = F.greatest(F.lit(1), F.col("step") - F.col("last_step"))
    return (
        windows.where("by_step")
        .withColumn("energy_per_step_wh", F.col("energy_consumed_wh") / steps)
        .withColumn(
            "energy_efficiency",
            en.energy_efficiency(
                F.col("energy_consumed_wh"), F.col("step"), F.col("last_step"), F.col("utilization_avg_percent")
            ),
        )
    )


def history_counts(fired: DataFrame) -> DataFrame:
    """Per run the number of intervals and of logged steps."""
    return fired.groupBy("run_id").agg(
        F.count_if("by_time").alias("total_intervals"), F.count_if("by_step").alias("total_logged_steps")
    )
