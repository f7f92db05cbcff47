"""One slim table of readings that every energy figure is computed from, kept up to date by parts.

A row is one distinct reading in its unified shape and how often it occurs (``copies``).  Figures
over such rows weigh them by their copies, so rows of several parts of a run simply add up.  The table is
written once from one scan of the raw readings.  ``refresh`` maintains it beside a raw table that
is partitioned, for instance by hour of arrival: it lists the files, and reads only the parts whose
files have changed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joulecorpus.operators import telemetry
from joulecorpus.session import join_small, path_exists, remove_path

KEYS = ("run_id", "ts", "gpu_id", "name", "method", "failed")
VALUES = ("power_w", "power", "temperature", "utilization", "memory_used")
#: Changed parts up to this number are named in the scan's filter; more are met by a join.
NAMED_PARTS = 1_000
#: The folder of rows without a part.
NO_PART = "__HIVE_DEFAULT_PARTITION__"
_STATE = "part string, files bigint, bytes bigint, latest double"


def reading_partials(readings: DataFrame, *keep: str) -> DataFrame:
    """Distinct unified readings with their ``copies``; a failed reading keeps its time only.

    ``keep`` are further columns to group by.  Rows without a run or a time are kept as they are.
    """
    failed = F.col("error").isNotNull() if "error" in readings.columns else F.lit(False)
    absent = {"method": "string", "power_w": "double"}
    missing = {name: F.lit(None).cast(kind) for name, kind in absent.items() if name not in readings.columns}
    flagged = readings.withColumns(missing | {"failed": failed})
    unified = telemetry.unify_readings(flagged, [*absent, "failed", *keep], errors="flag")
    return unified.groupBy(*KEYS, *VALUES, *keep).agg(F.count(F.lit(1)).alias("copies"))


def merged(partials: DataFrame) -> DataFrame:
    """One row for each distinct reading, whatever parts it comes from."""
    return partials.groupBy(*KEYS, *VALUES).agg(F.sum("copies").alias("copies"))


def expanded(partials: DataFrame) -> DataFrame:
    """One row for each reading again."""
    return partials.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_copy", "copies")


@dataclass(frozen=True)
class Refreshed:
    """Parts that ``refresh`` computed again, and parts that it removed."""

    read: tuple
    removed: tuple


def file_state(spark: SparkSession, source: str, part: str) -> DataFrame:
    """``part, files, bytes, latest`` of a partitioned table, from its file listing alone."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(source)
    return listed.groupBy(F.col(part).cast("string").alias("part")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").cast("double").alias("latest")
    )


def refresh(
    spark: SparkSession,
    source: str,
    table: str,
    part: str = "hour",
    build: Callable[[DataFrame, str], DataFrame] = reading_partials,
) -> Refreshed:
    """Bring the partials below ``table`` up to date with the raw Parquet table ``source``, partitioned by ``part``.

    ``build(raw, part)`` computes them, grouped by ``part`` among others.  Only parts whose files have changed since the last call are read; those that are gone lose their partials.
    The changed parts' old partials go first and the file state is noted last, so whatever a failed call left
    is made good by the next; readers wait until it has returned.
    """
    base = table.rstrip("/")
    now = {r.part: (r.files, r.bytes, r.latest) for r in file_state(spark, source, part).collect()}  # one row a part
    known = {r.part: (r.files, r.bytes, r.latest) for r in _noted(spark, base).collect()}
    changed = sorted((p for p, state in now.items() if known.get(p) != state), key=str)
    gone = sorted((p for p in known if p not in now), key=str)
    for name in (*changed, *gone):
        remove_path(spark, f"{base}/partials/{part}={NO_PART if name is None else name}")
    if changed:
        raw = spark.read.parquet(source)
        kind = raw.schema[part].dataType
        if len(changed) <= NAMED_PARTS:
            named = [F.col(part).eqNullSafe(F.lit(name).cast(kind)) for name in changed if name is None]
            raw = raw.where(reduce(or_, named, F.col(part).isin(*[F.lit(name).cast(kind) for name in changed if name is not None])))
        elif known:
            names = spark.createDataFrame([(name,) for name in changed], "part string").select(F.col("part").cast(kind).alias(part))
            raw = join_small(raw, names, [part], "left_semi")
        build(raw, part).write.mode("append").partitionBy(part).parquet(f"{base}/partials")
    if changed or gone:
        state = spark.createDataFrame([(name, *values) for name, values in now.items()], _STATE)
        state.coalesce(1).write.mode("overwrite").parquet(f"{base}/seen")
    return Refreshed(tuple(changed), tuple(gone))


def maintained(spark: SparkSession, table: str) -> DataFrame:
    """The partials that ``refresh`` keeps below ``table``, merged over its parts."""
    return merged(kept_parts(spark, table))


def kept_parts(spark: SparkSession, table: str) -> DataFrame:
    """The rows that ``refresh`` keeps below ``table``, for each part."""
    return spark.read.parquet(f"{table.rstrip('/')}/partials")


def _noted(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(_STATE).parquet(f"{base}/seen") if path_exists(spark, f"{base}/seen") else spark.createDataFrame([], _STATE)
