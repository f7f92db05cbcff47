"""Streaming sources of telemetry and a helper that drains a stream into a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joulecorpus.session import path_exists, scratch_path

SNAPSHOT_SCHEMA = (
    "run_id bigint, timestamp double, method string, gpus array<struct<"
    "gpu_id: bigint, ts: double, name: string, power_w: double, power_draw_w: double, temperature_c: double, "
    "utilization_percent: double, memory_used_mb: double, error: string>>"
)


# Files of one micro-batch if the caller sets no bound.
FILES_PER_TRIGGER = 200


def snapshot_stream(
    spark: SparkSession, path: str, schema: str = SNAPSHOT_SCHEMA, source: str = "parquet", **options
) -> DataFrame:
    """Snapshots as a stream of files; empty snapshots are dropped.

    ``maxFilesPerTrigger`` / ``maxBytesPerTrigger`` bound a micro-batch; without either it
    takes ``FILES_PER_TRIGGER`` files.
    """
    bound = {} if "maxBytesPerTrigger" in options else {"maxFilesPerTrigger": FILES_PER_TRIGGER}
    stream = spark.readStream.schema(schema).options(**(bound | options)).format(source).load(path)
    return stream.where(F.size("gpus") > 0)


def snapshots_from_json(messages: DataFrame, value: str = "value", schema: str = SNAPSHOT_SCHEMA) -> DataFrame:
    """Snapshots from JSON messages, e.g. a Kafka stream, without empty ones.

    Unreadable messages are no snapshots; ``rejected_messages`` has them.
    """
    read = messages.select(_read(value, schema).alias("_s")).select("_s.*")
    return read.where(F.size("gpus") > 0)


def rejected_messages(messages: DataFrame, value: str = "value", schema: str = SNAPSHOT_SCHEMA) -> DataFrame:
    """The messages that are no snapshot, unchanged: no JSON object, or one without readings as a list."""
    return messages.where(_read(value, schema)["gpus"].isNull())


def _read(value: str, schema: str) -> Column:
    return F.from_json(F.col(value).cast("string"), schema)


def drain_append(stream: DataFrame, label: str, checkpoint: str | None = None, table: str | None = None) -> str:
    """Run an append stream over everything available; returns the table's path.

    If nothing has arrived yet the table is there without rows; it is then read by the stream's schema.
    """
    spark = stream.sparkSession
    table = table or scratch_path(spark, label)
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint or scratch_path(spark, f"{label}-progress"))
        .trigger(availableNow=True)
        .start(table)
    )
    query.awaitTermination()
    if not path_exists(spark, table):
        spark.createDataFrame([], stream.schema).write.parquet(table)
    return table


def drain_update(
    stream: DataFrame, keys: list[str], label: str, checkpoint: str | None = None, table: str | None = None
) -> DataFrame:
    """Run an update stream over everything available; returns the latest row per key.

    Every micro-batch overwrites its own folder, so a replayed batch leaves one copy.  A
    kept checkpoint needs its table too: a later call adds only what has changed since.
    """
    if (checkpoint is None) != (table is None):
        raise ValueError("checkpoint and table go together")
    spark = stream.sparkSession
    table = table or scratch_path(spark, label)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint or scratch_path(spark, f"{label}-progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rest = [name for name in stream.columns if name not in keys]
    if not path_exists(spark, table):  # nothing has arrived yet
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.parquet(table)
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_latest"))
    return latest.select(*keys, "_latest.*")
