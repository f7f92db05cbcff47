"""Markers as a second stream beside the readings: which stretch a reading belongs to, while runs go on.

Readings and markers of one run and time block wait in the state until the slower of the two
streams has passed the block.  The block is then settled: every reading takes the latest marker
of its block at or before it, and what leaves is one partial figure per marker, GPU and name.
Readings before the block's first marker leave without one; the marker that reaches into their block is looked up
among the settled markers when the table is read, so no task and no state holds a whole run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from joulecorpus.operators import telemetry
from joulecorpus.operators.ordered import attach_latest, time_block

_VALUES = ("power", "temperature", "utilization", "memory_used")
_ARRIVED = ["is_marker", "ts", "step", "gpu_id", "name", *_VALUES]
_STATE = "is_marker array<boolean>, ts array<double>, step array<bigint>, gpu_id array<bigint>, name array<string>, " + ", ".join(
    f"{name} array<double>" for name in _VALUES
)
_FIGURES = [f"{name}_{figure} double" for name in _VALUES for figure in ("sum", "max")] + ["power_min double"]
REPORT_SCHEMA = (
    "run_id bigint, block bigint, kind string, marker_ts double, marker_step bigint, "
    "gpu_id bigint, name string, n bigint, last_ts double, " + ", ".join(_FIGURES)
)
_REPORT = [part.split()[0] for part in REPORT_SCHEMA.split(", ")]


def settled(rows: pd.DataFrame) -> pd.DataFrame:
    """The markers of one run and block, and partial figures of the readings by marker, GPU and name."""
    marks = rows[rows["is_marker"]].sort_values(["ts", "step"], na_position="first")
    readings = rows[~rows["is_marker"]].copy()
    out = marks[["ts", "step"]].drop_duplicates().rename(columns={"ts": "marker_ts", "step": "marker_step"}).assign(kind="marker")
    if len(readings):
        at = np.searchsorted(marks["ts"].to_numpy(float), readings["ts"].to_numpy(float), side="right") - 1
        chosen = marks.iloc[np.maximum(at, 0)] if len(marks) else None
        for name in ("ts", "step"):
            value = chosen[name].reset_index(drop=True) if len(marks) else pd.Series([None] * len(readings))
            readings[f"marker_{name}"] = value.where(at >= 0, None).to_numpy()
        readings["marker_ts"] = readings["marker_ts"].astype(float)
        readings["marker_step"] = readings["marker_step"].astype("Int64")
        groups = readings.groupby(["marker_ts", "marker_step", "gpu_id", "name"], dropna=False)
        parts = groups.size().rename("n").to_frame()
        parts["last_ts"] = groups["ts"].max()
        for name in _VALUES:
            parts[f"{name}_sum"] = groups[name].sum(min_count=1)
            parts[f"{name}_max"] = groups[name].max()
        parts["power_min"] = groups["power"].min()
        out = pd.concat([out.astype(object), parts.reset_index().assign(kind="part").astype(object)], ignore_index=True)
    return out


def _advance(block_s: float):
    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] is None or key[0] != key[0] or key[1] is None or key[1] != key[1]:  # beats only move the clock
            return
        block = int(key[1])
        held = pd.DataFrame(dict(zip(_ARRIVED, state.get))) if state.exists else pd.DataFrame(columns=_ARRIVED)
        arrived = [batch[_ARRIVED] for batch in batches]
        arrived = pd.concat(arrived, ignore_index=True) if arrived else held.iloc[:0]
        closes = int((block + 1) * block_s * 1000)

        def report(rows: pd.DataFrame) -> pd.DataFrame:
            whole = rows.assign(run_id=key[0], block=block)
            return whole.reindex(columns=_REPORT)

        if state.hasTimedOut or closes <= state.getCurrentWatermarkMs():
            if len(held):
                yield report(settled(held.astype({"is_marker": bool})))
            if len(arrived):  # the block has been passed
                kinds = np.where(arrived["is_marker"].astype(bool), "late_marker", "late_reading")
                numbers = {"marker_step": arrived["step"].astype("Int64"), "gpu_id": arrived["gpu_id"].astype("Int64")}
                yield report(pd.DataFrame({"kind": kinds, **numbers, "name": arrived["name"], "last_ts": arrived["ts"], "n": 1}))
            if state.exists:
                state.remove()
            return
        rows = pd.concat([held.astype(object), arrived.astype(object)], ignore_index=True)
        plain = rows.where(rows.notna(), None)
        columns = [plain[name].tolist() for name in _ARRIVED]
        for place, name in enumerate(_ARRIVED):
            if name in ("step", "gpu_id"):
                columns[place] = [None if v is None else int(v) for v in columns[place]]
        state.update(tuple(columns))
        state.setTimeoutTimestamp(closes)

    return advance


def stream_marker_parts(
    readings: DataFrame, markers: DataFrame, lateness_s: float = 60.0, block_s: float = 60.0, oldest_s: float = 30 * 86_400.0
) -> DataFrame:
    """Settled markers and partial figures (``REPORT_SCHEMA``) of a stream of unified readings and one of markers.

    ``readings`` are those of ``telemetry.unify_readings``, ``markers`` has ``run_id, ts, step``.  Each stream may be
    out of order by ``lateness_s``, and they wait for each other: a block is settled once both are past its
    end by that much.  Rows without a run only move their stream's clock; rows without a time are none.

    ``kind`` is ``marker``, ``part``, or ``late_marker`` / ``late_reading`` for a row whose block
    has been settled, which counts nowhere else.  Rows ``oldest_s`` behind are dropped by the watermark, and
    counted in the query's progress.
    """

    def timed(rows: DataFrame, is_marker: bool) -> DataFrame:
        known = rows.where(F.col("ts").isNotNull()).withColumn("is_marker", F.lit(is_marker))
        absent = {"step": "bigint"} if not is_marker else {"gpu_id": "bigint", "name": "string"} | dict.fromkeys(_VALUES, "double")
        shaped = known.withColumns({name: F.lit(None).cast(kind) for name, kind in absent.items()})
        clock = F.timestamp_micros(((F.col("ts") + oldest_s - lateness_s) * 1_000_000).cast("bigint"))
        kinds = {"step": "bigint", "gpu_id": "bigint"} | dict.fromkeys(_VALUES, "double")
        columns = [F.col(name).cast(kinds[name]).alias(name) if name in kinds else F.col(name) for name in _ARRIVED]
        placed = shaped.select("run_id", time_block(F.col("ts"), block_s).alias("block"), *columns, clock.alias("clock"))
        return placed.withWatermark("clock", f"{int(oldest_s * 1000)} milliseconds")

    both = timed(readings, False).unionByName(timed(markers, True))
    return both.groupBy("run_id", "block").applyInPandasWithState(
        _advance(block_s), REPORT_SCHEMA, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def marker_energy_so_far(parts: DataFrame, baselines: DataFrame, ends: DataFrame, block_s: float = 60.0) -> DataFrame:
    """``telemetry.marker_energy`` over what a stream has settled; ``ends`` says up to when each run has come."""
    marker = F.struct(F.col("marker_ts").alias("ts"), F.col("marker_step").alias("step"))
    marks = parts.where("kind = 'marker'").select("run_id", F.col("marker_ts").alias("ts"), marker.alias("marker"))
    own = F.when(F.col("marker_ts").isNotNull(), marker).alias("own")
    figures = parts.where("kind = 'part'").select("*", (F.col("block") * F.lit(float(block_s))).alias("ts"), own)
    tagged = attach_latest(figures, marks, ["run_id"], "ts", "marker", block_s)
    return telemetry.stretch_energy(tagged.withColumn("marker", F.coalesce("own", "marker")), marks, baselines, ends, block_s)
