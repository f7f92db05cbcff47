"""Writers: partitioned output directories written by the executors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joulecorpus.config import CorpusConfig
from joulecorpus.operators.tokens import add_token_counts, format_examples
from joulecorpus.session import as_table, child_names, path_exists, remove_path

# Tasks that share the rows of one run when they are written.
RUN_WRITERS = 8
# The folder of rows without a run.
NO_RUN = "__HIVE_DEFAULT_PARTITION__"


def _by_split(df: DataFrame) -> DataFrameWriter:
    """A dataset folder is replaced as a whole when the job is run again."""
    out = df.write.mode("overwrite")
    return out.partitionBy("split") if "split" in df.columns else out


def _examples(df: DataFrame, template: str, config: CorpusConfig) -> DataFrame:
    """Examples with the configured id column, else the generated one; ``split`` rides along."""
    id_column = config.id_column if config.id_column in df.columns else "id"
    keep = [name for name in ("split",) if name in df.columns]
    text, summary = f"{config.text_column}_clean", f"{config.summary_column}_clean"
    return format_examples(df, template, text, summary, id_column, keep)


def write_jsonl(df: DataFrame, path: str, config: CorpusConfig = CorpusConfig()) -> str:
    """One JSON object per line: templated ``text``, or raw ``text, summary, id``."""
    _by_split(_examples(df, config.instruction_template, config)).json(path)
    return path


def write_json(df: DataFrame, path: str, config: CorpusConfig = CorpusConfig()) -> str:
    """Row-wise JSON of ``text, summary, id``."""
    _by_split(_examples(df, "", config)).json(path)
    return path


def write_csv(df: DataFrame, path: str, config: CorpusConfig = CorpusConfig(), single_file: bool = False) -> str:
    """All columns with a header; ``single_file`` gathers one file and is meant for small tables."""
    out = df.coalesce(1) if single_file else df
    _by_split(out).option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return path


def write_parquet(df: DataFrame, path: str, config: CorpusConfig = CorpusConfig()) -> str:
    """All columns, partitioned by split."""
    _by_split(df).parquet(path)
    return path


WRITERS: dict[str, Callable[..., str]] = {
    "jsonl": write_jsonl,
    "json": write_json,
    "csv": write_csv,
    "parquet": write_parquet,
}


def save(
    df: DataFrame, output_dir: str, formats: Sequence[str] | None = None, config: CorpusConfig = CorpusConfig()
) -> dict[str, str]:
    """Write one or several formats; an unknown name raises before anything is written.

    Several formats are written from one evaluation of ``df``: the Parquet dataset if it is one of them, else a
    scratch table.  ``df`` may read the datasets that it replaces.
    """
    formats = [config.output_format] if formats is None else list(formats)
    unknown = [name for name in formats if name not in WRITERS]
    if unknown:
        raise ValueError(f"unsupported formats: {unknown}")
    paths = {name: f"{output_dir.rstrip('/')}/dataset_{name}" for name in formats}
    done: dict[str, str] = {}
    if len(paths) > 1 and "parquet" in paths and not _reads(df, paths["parquet"]):
        done["parquet"] = WRITERS["parquet"](df, paths["parquet"], config)
        df = df.sparkSession.read.schema(df.schema).parquet(done["parquet"]).select(*df.columns)
    elif len(paths) > 1:
        df = as_table(df, "dataset")
    return {name: done.get(name) or WRITERS[name](df, path, config) for name, path in paths.items()}


def _reads(df: DataFrame, path: str) -> bool:
    """Whether ``df`` reads files below ``path``."""
    folder = urlparse(path).path.rstrip("/") + "/"
    return any(unquote(urlparse(name).path).startswith(folder) for name in df.inputFiles())


def token_csv_path(source: str | None) -> str:
    """``{stem}_tokens.csv`` next to the source."""
    if not source:
        return "dataset_tokens.csv"
    head, _, name = source.rpartition("/")
    stem = name.rsplit(".", 1)[0] if "." in name else name
    return f"{head}/{stem}_tokens.csv" if head else f"{stem}_tokens.csv"


def write_token_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return path


def count_tokens_report(
    df: DataFrame, source: str | None, columns: Sequence[str] = ("Texto", "Resumo"), counter=None
) -> tuple[DataFrame, str]:
    """Token columns for the text pair, exported next to the source."""
    counted = add_token_counts(df, columns, counter)
    return counted, write_token_csv(counted, token_csv_path(source))


def by_run(df: DataFrame) -> DataFrameWriter:
    """Replaces the folders of the runs that ``df`` holds and leaves other runs alone.

    Writing the same runs again leaves one copy.  Rows are gathered by run first, salted so
    that a large run is written by several tasks, each of which writes few files.
    """
    salted = df.repartition("run_id", F.pmod(F.xxhash64(*df.columns), F.lit(RUN_WRITERS))) if _plain(df) else df.repartition("run_id")
    return salted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id")


def clear_runs(spark: SparkSession, path: str, runs: DataFrame) -> None:
    """Drop the folders of ``runs(run_id)`` from a table that ``by_run`` writes; other runs stay.

    A run that is written again with no rows would keep its old ones otherwise.  Only ids that have a folder
    and were asked for reach the driver.
    """
    if not path_exists(spark, path):
        return
    asked = runs.select(F.col("run_id").cast("string").alias("run_id")).distinct()
    folders = [name for name in child_names(spark, path) if name.startswith("run_id=")]
    there = spark.createDataFrame([(name, unquote(name.removeprefix("run_id="))) for name in folders], "folder string, run string")
    named = there.withColumn("run", F.nullif("run", F.lit(NO_RUN)))
    for row in named.join(asked, named["run"].eqNullSafe(asked["run_id"]), "left_semi").select("folder").collect():
        remove_path(spark, f"{path.rstrip('/')}/{row.folder}")


def _plain(df: DataFrame) -> bool:
    return not any(isinstance(f.dataType, T.MapType) for f in df.schema.fields)


def write_energy_history(
    windows_by_step: DataFrame, windows_by_time: DataFrame, counts: DataFrame, output_dir: str
) -> dict[str, str]:
    """Step history, interval history and their counts, partitioned by run; runs accumulate."""
    base = output_dir.rstrip("/")
    paths = {
        "step_history": f"{base}/energy_step_history",
        "interval_history": f"{base}/energy_interval_history",
        "summary": f"{base}/energy_monitoring_summary",
    }
    by_run(windows_by_step).json(paths["step_history"])
    by_run(windows_by_time).json(paths["interval_history"])
    # Fixed value: the remark every summary carries.
    remark = F.lit("Monitoramento sincronizado com alta precisão").alias("monitoring_summary")
    by_run(counts.select("run_id", "total_logged_steps", "total_intervals", remark)).json(paths["summary"])
    return paths


def write_energy_data(summary: DataFrame, gpus: DataFrame, samples: DataFrame, output_dir: str) -> dict[str, str]:
    """The full measurement of every run: summary, per-GPU statistics, sample arrays."""
    base = output_dir.rstrip("/")
    tables = {"run_summary": summary, "gpu_statistics": gpus, "gpu_samples": samples}
    for name, table in tables.items():
        by_run(table).json(f"{base}/energy_data/{name}")
    return {name: f"{base}/energy_data/{name}" for name in tables}


def write_report(report: DataFrame, path: str) -> str:
    by_run(report).json(path)
    return path
