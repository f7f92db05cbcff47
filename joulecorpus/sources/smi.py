"""Telemetry text lines: ``index, name, power, temperature, utilisation, memory used, memory total``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joulecorpus.functions.casting import to_number
from joulecorpus.sources.growing import growing_lines

# Field names by position, and the texts that stand for "not available".
FIELDS = ("power_w", "temperature_c", "utilization_percent", "memory_used_mb", "memory_total_mb")
NOT_AVAILABLE = ("[N/A]", "[Not Supported]")


def read_smi_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Raw device lines of text files, as a table or as a stream of new files; blank lines are none."""
    reader = spark.readStream if streaming else spark.read
    return reader.text(path).withColumnRenamed("value", "line").where(F.trim("line") != "")


def growing_smi_lines(spark: SparkSession, folder: str, pattern: str = "*", **options) -> DataFrame:
    """Raw device lines of log files that go on growing, as a stream; blank lines are none."""
    return growing_lines(spark, folder, pattern, **options).where(F.trim("line") != "")


def parse_smi_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add the parsed fields and ``parsed``; a line that is no reading has ``parsed = false``.

    Fewer than seven fields, or a number that is neither a number nor marked as
    not available, rejects the line.  Unavailable numbers are null.
    """
    parts = F.transform(F.split(F.col(line), ","), lambda part: F.trim(part))
    split = lines.withColumn("_p", parts)

    def field(at: int):
        return F.get("_p", F.lit(at))

    numbers = {}
    fine = (F.size("_p") >= 7) & to_number(field(0), "bigint").isNotNull()
    for at, name in enumerate(FIELDS, start=2):
        number = to_number(field(at))
        numbers[name] = number
        fine = fine & (number.isNotNull() | field(at).isin(*NOT_AVAILABLE))
    fine = F.coalesce(fine, F.lit(False))
    return split.withColumns(
        {
            "parsed": fine,
            "gpu_id": F.when(fine, to_number(field(0), "bigint")).cast("int"),
            "name": F.when(fine, field(1)),
            **{name: F.when(fine, c) for name, c in numbers.items()},
        }
    ).drop("_p")


def parse_smi_csv(lines: DataFrame, line: str = "line") -> DataFrame:
    """The readings; malformed lines are dropped."""
    return parse_smi_lines(lines, line).where("parsed").drop("parsed", line)


def reject_counts(lines: DataFrame, *keys: str, line: str = "line") -> DataFrame:
    """Lines, readings and rejects, per key."""
    return (
        parse_smi_lines(lines, line)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.count_if("parsed").alias("readings"),
            F.count_if(~F.col("parsed")).alias("rejected"),
        )
    )
