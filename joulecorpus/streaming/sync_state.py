"""Step- and time-synchronised windows on a live stream.

The stream carries two kinds of rows per run: readings, and step ends.  They come from
different writers, so rows wait in the state until ``lateness_s`` seconds of event time
have passed, and are then consumed in the order of time.  State per run is the last
cut, the last reported step, pooled figures since the cut, and the waiting rows.
Readings are combined per time inside each input task first, so only one row per
snapshot and task reaches the state operator.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from joulecorpus.config import SyncConfig

# Pooled figures: sums first, then maxima, then the minimum.
_SUMS = ["snapshots", "usable", "n", "power_sum", "temperature_sum", "utilization_sum", "memory_sum"]
_MAXIMA = ["power_max", "temperature_max"]
_MINIMA = ["power_min"]
_FIGURES = _SUMS + _MAXIMA + _MINIMA
_NOTHING = np.array([0.0] * len(_SUMS) + [-np.inf] * len(_MAXIMA) + [np.inf] * len(_MINIMA))

EVENT_SCHEMA = (
    "run_id bigint, ts double, step bigint, epoch double, power double, temperature double, "
    "utilization double, memory_used double, name string"
)
_COMBINED = (
    "run_id bigint, ts double, step bigint, epoch double, "
    + ", ".join(f"{name} double" for name in _FIGURES)
    + ", names array<string>"
)
_STATE = (
    "last_sync double, last_step bigint, seen double, newest double, late bigint, "
    "pooled array<double>, pooled_names array<string>, at_newest array<double>, at_newest_names array<string>, "
    "latest double, waiting binary, waiting_names array<array<string>>"
)
WINDOW_SCHEMA = (
    "run_id bigint, timestamp double, step bigint, epoch double, power_avg_w double, power_max_w double, "
    "power_min_w double, energy_consumed_wh double, temperature_avg_c double, temperature_max_c double, "
    "utilization_avg_percent double, memory_used_avg_mb double, gpu_name string, duration_s double, "
    "samples_count bigint, last_sync double, last_step bigint, by_time boolean, by_step boolean, late_dropped bigint"
)

REPORT_SCHEMA = WINDOW_SCHEMA + ", kind string"


def _pool(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sums, maxima = len(_SUMS), len(_SUMS) + len(_MAXIMA)
    return np.concatenate(
        [a[:sums] + b[:sums], np.maximum(a[sums:maxima], b[sums:maxima]), np.minimum(a[maxima:], b[maxima:])]
    )


def _pool_rows(rows: np.ndarray) -> np.ndarray:
    if not len(rows):
        return _NOTHING.copy()
    sums, maxima = len(_SUMS), len(_SUMS) + len(_MAXIMA)
    return np.concatenate(
        [rows[:, :sums].sum(axis=0), rows[:, sums:maxima].max(axis=0), rows[:, maxima:].min(axis=0)]
    )


def _by_time(readings: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Partial figures per time; works on raw partials and on merged ones."""
    rules = {n: "sum" for n in _SUMS} | {n: "max" for n in _MAXIMA} | {n: "min" for n in _MINIMA}
    rules["names"] = lambda lists: sorted({name for names in lists for name in names})
    merged = readings.groupby(keys, sort=True, as_index=False).agg(rules)
    merged["snapshots"] = 1.0
    merged["usable"] = (merged["n"] > 0).astype(float)
    return merged


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        steps = pdf[pdf["step"].notna() & pdf["run_id"].notna()][["run_id", "ts", "step", "epoch"]]
        raw = pdf[pdf["step"].isna() & pdf["run_id"].notna()]
        beats = pdf.loc[pdf["run_id"].isna(), "ts"]
        used = raw["power"].notna()
        partial = pd.DataFrame(
            {
                "run_id": raw["run_id"],
                "ts": raw["ts"],
                "n": used.astype(float),
                "power_sum": raw["power"].fillna(0.0),
                "temperature_sum": raw["temperature"].where(used, 0.0),
                "utilization_sum": raw["utilization"].where(used, 0.0),
                "memory_sum": raw["memory_used"].where(used, 0.0),
                "power_max": raw["power"].fillna(-np.inf),
                "temperature_max": raw["temperature"].where(used, -np.inf),
                "power_min": raw["power"].fillna(np.inf),
                "names": [[name] if ok else [] for name, ok in zip(raw["name"], used)],
                "snapshots": 1.0,
                "usable": 0.0,
            }
        )
        columns = ["run_id", "ts", "step", "epoch", *_FIGURES, "names"]
        if len(partial):
            yield _by_time(partial, ["run_id", "ts"]).assign(step=None, epoch=None)[columns]
        if len(steps):
            blank = {name: None for name in [*_FIGURES, "names"]}
            yield steps.assign(**blank)[columns]
        if len(beats):
            yield pd.DataFrame({"ts": [beats.max()]}).assign(**{name: None for name in columns if name != "ts"})[columns]


# A row with this step number says that its run has ended.
RUN_ENDS = -1
_WAITING = ["ts", "step", "epoch", *_FIGURES]


def _packed(wait: pd.DataFrame) -> tuple[bytes, list[list[str]]]:
    """Waiting rows as bytes, 8 for each figure, and their distinct lists of names; the last figure is the list's number."""
    numbers: dict[tuple, int] = {}
    lists = (tuple(some) if isinstance(some, (list, np.ndarray)) else () for some in wait["names"])
    codes = np.fromiter((numbers.setdefault(some, len(numbers)) for some in lists), float, len(wait))
    return np.column_stack([wait[_WAITING].to_numpy(dtype=float), codes]).tobytes(), [list(some) for some in numbers]


def _unpacked(waiting: bytes, lists: list) -> pd.DataFrame:
    held = np.frombuffer(waiting, float).reshape(-1, len(_WAITING) + 1)
    rows = pd.DataFrame(held[:, :-1], columns=_WAITING)
    shared = [list(some) for some in lists]
    return rows.assign(names=[shared[k] for k in held[:, -1].astype(int).tolist()])


def _advance(config: SyncConfig, silence_s: float | None = None):
    """The state function; with ``silence_s`` its rows are ``REPORT_SCHEMA`` and a silent run is consumed to its end."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] is None or key[0] != key[0]:  # beats only move the clock
            return
        arrived = [batch[[*_WAITING, "names"]] for batch in batches]  # one run within one bounded micro-batch
        if state.exists:
            last_sync, last_step, seen, newest, late, pooled, names, fresh, fresh_names, latest, waiting, labels = state.get
            pooled, fresh = np.array(pooled), np.array(fresh)
            names, fresh_names = set(names), set(fresh_names)
            if len(waiting):
                arrived.append(_unpacked(waiting, labels))
        else:
            last_sync, last_step, seen, newest, late, latest = None, 0, -np.inf, -np.inf, 0, -np.inf
            pooled, names, fresh, fresh_names = _NOTHING.copy(), set(), _NOTHING.copy(), set()
        silent = state.hasTimedOut
        if not arrived:  # silent, and nothing waits
            return
        events = pd.concat(arrived, ignore_index=True)
        events[_WAITING] = events[_WAITING].astype(float)
        last_sync = float(events["ts"].min()) if last_sync is None else last_sync
        latest = float(max(latest, events["ts"].max()))
        ended = silent or bool((events["step"] == RUN_ENDS).any())
        on_time = events["ts"] >= seen
        late += int((~on_time).sum())
        dropped = events[~on_time]
        events = events[on_time & (events["step"] != RUN_ENDS)]
        ready = events["ts"] <= (np.inf if ended else latest - config.lateness_s)
        wait, events = events[~ready], events[ready]
        seen = float(max(seen, events["ts"].max())) if len(events) else seen
        steps = events[events["step"].notna()].sort_values(["ts", "step"])
        readings = events[events["step"].isna()]
        readings = _by_time(readings, ["ts"]) if len(readings) else readings
        t = readings["ts"].to_numpy(dtype=float)
        rows = readings[_FIGURES].to_numpy(dtype=float)
        labels = list(readings["names"])
        if len(t) and t[0] == newest:  # the newest snapshot continues: count it once
            rows[0, 0], rows[0, 1] = 0.0, max(0.0, rows[0, 1] - fresh[1])

        def take(start: int, stop: int) -> None:
            """Add readings start..stop to the window and refresh the newest snapshot."""
            nonlocal pooled, newest, fresh, fresh_names
            if stop <= start:
                return
            pooled = _pool(pooled, _pool_rows(rows[start:stop]))
            names.update(name for label in labels[start:stop] for name in label)
            same = t[stop - 1] == newest
            fresh = _pool(fresh, rows[stop - 1]) if same else rows[stop - 1].copy()
            fresh_names = set(labels[stop - 1]) | (fresh_names if same else set())
            newest = t[stop - 1]

        fired, done = [], 0
        for step in steps.itertuples(index=False):
            upto = int(np.searchsorted(t, step.ts, side="right"))
            take(done, upto)
            done = max(done, upto)
            number = int(step.step)
            if number == 0:  # the run begins
                last_sync = step.ts
                continue
            by_time = step.ts - last_sync >= config.interval_s
            by_step = number % config.logging_steps == 0
            if (by_time or by_step) and pooled[2] > 0:
                f = dict(zip(_FIGURES, pooled))
                duration = step.ts - last_sync
                average = f["power_sum"] / f["n"]
                fired.append(
                    (
                        key[0], step.ts, number, step.epoch, average, f["power_max"], f["power_min"],
                        average * duration / 3600.0, f["temperature_sum"] / f["n"], f["temperature_max"],
                        f["utilization_sum"] / f["n"], f["memory_sum"] / f["n"], ", ".join(sorted(names)),
                        duration, int(f["snapshots"]), last_sync, last_step, by_time, by_step, late,
                    )
                )
                last_step = number
                if by_time:
                    last_sync = step.ts
                    opens = newest == step.ts  # a snapshot at the cut belongs to both windows
                    pooled = fresh.copy() if opens else _NOTHING.copy()
                    names = set(fresh_names) if opens else set()
        take(done, len(t))
        state.update(
            (
                float(last_sync), last_step, seen, float(newest), late,
                pooled.tolist(), sorted(names), fresh.tolist(), sorted(fresh_names),
                latest, *_packed(wait),
            )
        )
        names_out = [part.split()[0] for part in (WINDOW_SCHEMA if silence_s is None else REPORT_SCHEMA).split(", ")]
        if fired:
            windows = pd.DataFrame(fired, columns=[part.split()[0] for part in WINDOW_SCHEMA.split(", ")])
            yield windows.assign(kind="window")[names_out]
        if silence_s is not None:
            if len(wait):
                state.setTimeoutTimestamp(max(int((latest + silence_s) * 1000), state.getCurrentWatermarkMs() + 1))
            if len(dropped):
                told = pd.DataFrame({"timestamp": dropped["ts"], "step": dropped["step"].astype("Int64")})
                told = told.assign(run_id=key[0], samples_count=dropped["n"].fillna(0).astype("int64"), late_dropped=late, kind="late")
                yield told.assign(**{name: None for name in names_out if name not in told})[names_out]

    return advance


def stream_sync(events: DataFrame, config: SyncConfig = SyncConfig()) -> DataFrame:
    """Reported windows of a stream of readings and step ends (``EVENT_SCHEMA``).

    A row with ``step`` is a step end (step 0: the run begins, -1: the run has ended), one
    without ``power`` and ``step`` a failed reading.  Rows may arrive in any order within
    ``config.lateness_s`` seconds; a run is consumed up to its latest time less that, and
    to its end once it has ended.  A row older than what its run has consumed came later
    than allowed; it cannot count any more and is tallied in ``late_dropped``.
    """
    combined = events.select(*[part.split()[0] for part in EVENT_SCHEMA.split(", ")]).mapInPandas(_combine, _COMBINED)
    return combined.groupBy("run_id").applyInPandasWithState(
        _advance(config), WINDOW_SCHEMA, _STATE, "append", GroupStateTimeout.NoTimeout
    )


def stream_reports(
    events: DataFrame, config: SyncConfig = SyncConfig(), silence_s: float = 600.0, oldest_s: float = 30 * 86_400.0
) -> DataFrame:
    """``stream_sync`` that needs no end of a run: its windows, and the rows that came too late (``REPORT_SCHEMA``).

    A run is consumed to its end once the stream's time, the latest time of all its rows, is
    ``silence_s`` past the run's own latest time: a timer of event time fires for it, so a run
    that has crashed still gives its last windows.  It may go on afterwards.  Rows without a run
    are beats of the collector; they only move the stream's time, which else stands still when
    all runs are silent.

    ``kind`` is ``window``, or ``late`` for a row older than what its run has consumed: its
    time, its step if it is a step end, and in ``samples_count`` the readings of that time.  It is
    reported at once, whether or not a window follows.  ``oldest_s`` bounds how far a run may lag behind the
    stream's time; rows beyond it are dropped by the watermark, and Spark counts them in the
    query's progress (``numRowsDroppedByWatermark``).
    """
    rows = events.select(*[part.split()[0] for part in EVENT_SCHEMA.split(", ")]).where(F.col("ts").isNotNull())
    combined = rows.mapInPandas(_combine, _COMBINED)
    # The watermark is moved ahead by its own delay: it equals the stream's time.
    clock = F.timestamp_micros(((F.col("ts") + oldest_s) * 1_000_000).cast("bigint"))
    timed = combined.withColumn("clock", clock).withWatermark("clock", f"{int(oldest_s * 1000)} milliseconds")
    return timed.groupBy("run_id").applyInPandasWithState(
        _advance(config, silence_s), REPORT_SCHEMA, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def training_events(
    flagged: DataFrame, steps: DataFrame, starts: DataFrame, ends: DataFrame | None = None
) -> DataFrame:
    """Run begins, readings, step ends and, from ``ends(run_id, end_ts)``, run ends in the stream's common shape."""
    columns = [part.split() for part in EVENT_SCHEMA.split(", ")]

    def marks(df: DataFrame, time: str, step: int) -> DataFrame:
        return df.select("run_id", F.col(time).alias("ts"), F.lit(step).cast("bigint").alias("step"), F.lit(0.0).alias("epoch"))

    stops = steps.select("run_id", "ts", "step", "epoch").unionByName(marks(starts, "start_ts", 0))
    if ends is not None:
        stops = stops.unionByName(marks(ends, "end_ts", RUN_ENDS))
    both = flagged.unionByName(stops, allowMissingColumns=True)
    return both.select(*[F.col(name).cast(kind) for name, kind in columns])
