"""Corpus and training-set readers; every format is read by the executors."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joulecorpus.config import CorpusConfig
from joulecorpus.functions import text as tx
from joulecorpus.operators.corpus import require_columns
from joulecorpus.sources import byte_ranges, excel

# The cell texts a data-frame CSV reader takes as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

TRAINING_SCHEMA = "text string, summary string, id string"


def read_csv(
    spark: SparkSession,
    path: str,
    encoding: str = "utf-8",
    multi_line: bool = True,
    schema: T.StructType | str | None = None,
    **options: Any,
) -> DataFrame:
    """CSV with a header row and quoted fields; missing-value tokens become null.

    Line breaks inside quotes belong to their field, for which a file is read as a
    whole.  ``multi_line=False`` splits files, and is only right where no field holds one.
    """
    reader = (
        spark.read.option("header", True)
        .option("encoding", encoding)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .options(**options)
    )
    df = (reader.schema(schema) if schema else reader).csv(path)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({n: present(F.col(n)) for n in texts})


def read_csv_split(
    spark: SparkSession,
    path: str,
    encoding: str = "utf-8",
    schema: T.StructType | str | None = None,
    range_bytes: int = byte_ranges.RANGE_BYTES,
    **options: Any,
) -> DataFrame:
    """``read_csv`` with large files read by many tasks, line breaks in quotes included.

    Files are cut by ``byte_ranges`` and each record is parsed by Spark.  Records end with LF or
    CRLF, every file begins with the header, and a field that holds a quote must be quoted.
    Uncompressed files in an encoding whose quotes and line feeds are those of ASCII.
    """
    fields = read_csv(spark, path, encoding, schema=schema, **options).schema
    records = byte_ranges.split_records(spark, path, "csv", range_bytes, encoding)
    rows = records.where(~F.col("header") & (F.col("value") != ""))
    how = {"escape": '"', "multiLine": "true"} | {name: str(value) for name, value in options.items()}
    names = [f"`{f.name.replace('`', '``')}`" for f in fields]
    ddl = ", ".join(f"{name} {f.dataType.simpleString()}" for name, f in zip(names, fields))
    cells = rows.select(F.from_csv("value", ddl, how).alias("_r"))
    texts = [isinstance(f.dataType, T.StringType) for f in fields]
    return cells.select(
        *((present(F.col(f"_r.{n}")) if text else F.col(f"_r.{n}")).alias(f.name) for n, f, text in zip(names, fields, texts))
    )


def present(cell: Column) -> Column:
    """The cell's text, null for a missing-value token."""
    return F.when(~cell.isin(*NA_TOKENS), cell)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON documents: an array gives one row per object, an object gives one row."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_json_split(
    spark: SparkSession, path: str, schema: T.StructType | str, range_bytes: int = byte_ranges.RANGE_BYTES
) -> DataFrame:
    """``read_json`` with large documents read by many tasks: cut between the objects of the top array.

    A document that is one object gives one row.  Elements that are no objects, documents that
    end early, and objects that do not fit the schema are errors.
    """
    records = byte_ranges.split_records(spark, path, "json", range_bytes)
    return records.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_r")).select("_r.*")


def read_text_blocks(
    spark: SparkSession,
    path: str,
    text_column: str = "text",
    summary_column: str | None = None,
    separator: str = "\n\n",
) -> DataFrame:
    """Text cut at a separator (splittable), blocks stripped, blank ones dropped.

    CRLF and CR count as line feeds.  Without a separator, or when a summary column is
    named, every file is one row.
    """
    if not separator or summary_column is not None:
        return spark.read.text(path, wholetext=True).select(folded(F.col("value")).alias(text_column))
    # Cut at the separator by the scan, and again where it appears once line ends are folded.
    parts = spark.read.option("lineSep", separator).text(path)
    literal = re.escape(separator)
    blocks = parts.select(F.explode(F.split(folded(F.col("value")), literal)).alias("value"))
    return blocks.select(tx.trimmed(F.col("value")).alias(text_column)).where(F.col(text_column) != "")


def folded(text: Column) -> Column:
    """Every line end as a line feed."""
    return F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str = TRAINING_SCHEMA) -> DataFrame:
    """Training examples, one JSON object per line."""
    return spark.read.schema(schema).json(path)


def read_split_dir(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    """A saved dataset directory: one split if it is partitioned by split, else all rows."""
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split).drop("split") if "split" in df.columns else df


def take_first(df: DataFrame, order_by: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return df.orderBy(*order_by).limit(n)


def read_excel(
    spark: SparkSession, path: str, sheet_name: int | str = 0, columns: Sequence[str] | None = None
) -> DataFrame:
    """Workbooks below a path as string columns; missing-value tokens become null."""
    return workbook_table(excel.workbook_files(spark, path), sheet_name, columns)


def workbook_table(books: DataFrame, sheet_name: int | str = 0, columns: Sequence[str] | None = None) -> DataFrame:
    """The same for workbooks in the binary column ``content``."""
    df = excel.read_workbooks(books, sheet_name, columns)
    return df.select(*(present(F.col(f"`{n}`")).alias(n) for n in df.columns))


READERS: dict[str, Callable[..., DataFrame]] = {
    ".xlsx": read_excel,
    ".csv": read_csv,
    ".json": read_json,
    ".txt": read_text_blocks,
    ".text": read_text_blocks,
}


def extension(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def load_data(
    spark: SparkSession, path: str, config: CorpusConfig = CorpusConfig(), **reader_options: Any
) -> DataFrame:
    """Read by extension, optionally repartition; problems are raised before any job.

    With ``validate_data_quality`` missing columns are an error here, not later.
    """
    kind = extension(path)
    if kind not in READERS:
        raise ValueError(f"unsupported format: {kind or path}")
    try:
        df = READERS[kind](spark, path, **reader_options)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from error
        raise
    if config.validate_data_quality:
        require_columns(df, [config.text_column, config.summary_column])
    return df.repartition(config.n_partitions) if config.n_partitions else df


def load_training_source(
    spark: SparkSession, path: str, order_by: Sequence[str] = (), n: int | None = None
) -> tuple[DataFrame, str]:
    """A ``.jsonl`` file, a saved directory, or the first ``n`` rows of a named dataset, with its kind.

    A name without a folder is a table of the session's catalogue.
    """
    if n is not None:
        named = spark.table(path) if "/" not in path else read_split_dir(spark, path)
        return take_first(named, list(order_by), n), "named"
    if extension(path) == ".jsonl":
        return read_jsonl(spark, path), "jsonl"
    if extension(path) in ("", ".parquet"):
        return read_split_dir(spark, path), "split_dir"
    raise ValueError(f"unsupported training source: {path}")

