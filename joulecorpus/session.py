"""Shared-folder checkpoints, scratch tables and size-checked joins."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side of a join is broadcast only after its rows were counted against this.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and scratch tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    run without that setting; it then gets a folder of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured is None:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="joulecorpus-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, label: str) -> str:
    """Write ``df`` as a Parquet scratch table; returns its path."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


def as_table(df: DataFrame, label: str) -> DataFrame:
    """``df`` materialised as a scratch table: columnar, prunable, cut off its lineage."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, label))


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join a per-run / per-stratum table onto row-level data; null keys match null keys.

    The small side is written as a table and measured.  Within ``max_rows`` and
    ``max_bytes`` it is broadcast, so the big side is not shuffled and a hot key costs
    nothing; beyond that the join is an ordinary shuffle join, whose hot partitions
    adaptive execution splits.
    """
    fixed = as_table(small, "small")
    rows = fixed.limit(max_rows + 1).count()
    within = rows <= max_rows and table_bytes(fixed) <= max_bytes
    keys = {name: f"_small_{name}" for name in on}
    side = fixed.withColumnsRenamed(keys)
    same = [big[name].eqNullSafe(side[key]) for name, key in keys.items()]
    return big.join(F.broadcast(side) if within else side, same, how).drop(*keys.values())


def table_bytes(df: DataFrame) -> int:
    """Bytes of the files below ``df``, as the planner knows them."""
    return int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def path_exists(spark: SparkSession, path: str) -> bool:
    files, place = _file_system(spark, path)
    return files.exists(place)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders below ``path``."""
    files, place = _file_system(spark, path)
    return [x.getPath().getName() for x in files.listStatus(place)] if files.exists(place) else []


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of a table, if it is there."""
    files, place = _file_system(spark, path)
    files.delete(place, True)
