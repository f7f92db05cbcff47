"""Corpus and telemetry views over the given tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joulecorpus.operators.ordered import number_within
from joulecorpus.sources.byte_ranges import located

# The event table spans a month per run: blocks of six hours, windows of a day.
DAY_S = 86_400.0
BLOCK_S = 21_600.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text / summary pairs, with nulls and encoding debris."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("P"), F.col("doc_id").cast("string")).alias("Processo"),
        F.when(F.col("doc_id") % 17 != 0, F.replace(text, F.lit("\n"), F.lit("_x000D_\n"))).alias("Texto"),
        F.when(F.col("doc_id") % 23 != 0, F.split_part(text, F.lit("\n"), F.lit(1))).alias("Resumo"),
    )


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows; turns count up by one."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("Texto"))
    answered = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("Resumo")
    )
    return asked.join(answered, ["conv_id", "turn"])


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as readings of three runs with four GPUs each."""
    load = F.col("load")
    gpu = F.col("user_id") % 4
    kind = F.col("event_type")
    events = table(spark, sf_dir, "events").withColumn(
        "load", F.get_json_object("props", "$.k").cast("int").cast("double")
    )
    return events.select(
        "event_id",
        (F.col("user_id") % 3).alias("run_id"),
        gpu.alias("gpu_id"),
        F.concat(F.lit("GPU"), gpu.cast("string")).alias("name"),
        # Event times carry no zone and count as UTC, whatever the session's zone is.
        (F.unix_micros(F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())) / F.lit(1e6)).alias("ts"),
        F.when(F.col("user_id") % 2 == 0, "nvidia_smi").otherwise("pynvml").alias("method"),
        F.when(~kind.isin("error", "view"), F.col("value")).alias("power_w"),
        F.when(kind == "view", F.col("value")).alias("power_draw_w"),
        F.when(kind == "error", "device error").alias("error"),
        load.alias("utilization_percent"),
        (40.0 + load / 4).alias("temperature_c"),
        (1000.0 + 10 * load).alias("memory_used_mb"),
        (kind == "purchase").alias("is_step"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered runs, one of which never delivered a reading."""
    return table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("run_id")).distinct()


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as the numbered step ends of their run."""
    ended = telemetry(spark, sf_dir).where("is_step").select("run_id", "ts", "event_id")
    numbered = number_within(ended, ["run_id"], "ts", ["ts", "event_id"], BLOCK_S, "step")
    return numbered.select(
        "run_id", "ts", "event_id", F.col("step").cast("bigint").alias("step"),
        (F.col("step").cast("double") / 100).alias("epoch"),
    )


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    noted = steps(spark, sf_dir).where("step % 50 = 0")
    return noted.select("run_id", "ts", F.lit("training_step").alias("type"), "step", "epoch")


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workload periods of about a hundred steps."""
    named = steps(spark, sf_dir).withColumn(
        "workload", F.concat(F.lit("w"), F.floor(F.col("step") / 100).cast("string"))
    )
    return named.groupBy("run_id", "workload").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))


def long_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run the time from each period's start to the end of all, and to a point in between."""
    marks = periods(spark, sf_dir)
    ends = marks.groupBy("run_id").agg(F.max("end_ts").alias("last_ts"))
    middle = (F.col("start_ts") + F.col("last_ts")) / 2
    stops = F.array(
        F.struct(F.concat("workload", F.lit("-all")).alias("workload"), "start_ts", F.col("last_ts").alias("end_ts")),
        F.struct(F.concat("workload", F.lit("-half")).alias("workload"), "start_ts", middle.alias("end_ts")),
    )
    return marks.join(ends, "run_id").select("run_id", F.inline(stops))


def smi_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as comma-separated device lines, some malformed, some unavailable."""
    whole = [F.floor(n).cast("int").cast("string") for n in ("temperature_c", "utilization_percent")]
    line = F.concat_ws(
        ", ",
        F.col("gpu_id").cast("string"),
        "name",
        F.when(F.col("error").isNotNull(), "[N/A]").otherwise(F.coalesce("power_w", "power_draw_w").cast("string")),
        *whole,
        F.lit("4096"),
        F.lit("8192"),
    )
    broken = F.col("event_id") % 101 == 0
    return telemetry(spark, sf_dir).select(
        "event_id", "run_id", "ts", F.when(broken, "invalid data format").otherwise(line).alias("line")
    )


def grow_logs(lines: DataFrame, folder: str, share: float, rows_per_log: int = 2000) -> None:
    """Log files of consecutive ``event_id``, each up to a share of its bytes, which may cut a line.

    Every call writes the files from their beginning, so that they grow from call to call and a
    task that runs twice changes nothing.
    """

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        content = "".join(f"{line}\n" for line in pdf.sort_values("event_id")["line"]).encode()
        system, root = located(folder)
        system.create_dir(root)
        with system.open_output_stream(f"{root}/collector-{int(pdf['log'].iloc[0])}.log") as out:
            out.write(content[: int(len(content) * share)])
        return pd.DataFrame({"bytes": [len(content)]})

    logs = lines.withColumn("log", F.floor(F.col("event_id") / rows_per_log))
    logs.groupBy("log").applyInPandas(write, "bytes bigint").write.format("noop").mode("overwrite").save()


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings nested into one snapshot per run and minute."""
    reading = F.struct(
        "gpu_id", "ts", "name", "power_w", "power_draw_w", "temperature_c", "utilization_percent",
        "memory_used_mb", "error", "event_id",
    )
    nested = telemetry(spark, sf_dir).groupBy("run_id", (F.floor(F.col("ts") / 60) * 60.0).alias("timestamp"))
    return nested.agg(F.max("method").alias("method"), F.array_sort(F.collect_list(reading)).alias("gpus"))


def device_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings in raw device units."""
    return telemetry(spark, sf_dir).select(
        "event_id",
        "run_id",
        (F.coalesce("power_w", "power_draw_w") * 1000.0).alias("power_mw"),
        (F.col("memory_used_mb") * 1_048_576.0 + 1000.0).alias("memory_used_bytes"),
        F.lit(8192.0 * 1_048_576.0).alias("memory_total_bytes"),
    )


def _workbook(names: list[str], rows: Iterator[tuple]) -> bytes:
    """A minimal workbook with inline strings."""

    def cells(values) -> str:
        return "".join(
            "<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
            for v in values
        )

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rels = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    body = "".join(f"<row>{cells(row)}</row>" for row in (tuple(names), *rows))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{main}" xmlns:r="{rels}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        )
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def workbooks(rows: DataFrame, names: list[str], rows_per_book: int = 250) -> DataFrame:
    """Rows as binary workbooks of a fixed number of consecutive documents."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = pdf.sort_values("doc_id")[names].itertuples(index=False, name=None)
        return pd.DataFrame({"content": [_workbook(names, cells)]})

    numbered = rows.withColumn("book", F.floor(F.col("doc_id") / rows_per_book))
    return numbered.groupBy("book").applyInPandas(build, "content binary")
