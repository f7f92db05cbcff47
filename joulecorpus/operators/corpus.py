"""Corpus validation, cleaning, filtering, ids and length statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joulecorpus.config import CorpusConfig
from joulecorpus.functions import text as tx
from joulecorpus.operators.ordered import number_rows
from joulecorpus.session import table_bytes


def missing_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [name for name in wanted if name not in df.columns]


def require_columns(df: DataFrame, wanted: Sequence[str]) -> None:
    absent = missing_columns(df, wanted)
    if absent:
        raise ValueError(f"missing columns: {absent}")


def clean_columns(df: DataFrame, columns: Sequence[str], config: CorpusConfig = CorpusConfig()) -> DataFrame:
    """Add ``{column}_clean`` next to every listed column, in one projection.

    A column that holds no text cleans to the empty string.
    """
    return df.withColumns(
        {
            f"{name}_clean": tx.clean_text(
                F.col(name) if isinstance(df.schema[name].dataType, T.StringType) else F.lit(""),
                artifacts=config.remove_encoding_artifacts,
                unicode_form=config.normalize_unicode,
                whitespace=config.remove_extra_whitespace,
                lower=config.lowercase,
                punctuation=config.remove_punctuation,
            )
            for name in columns
        }
    )


def drop_null_pairs(df: DataFrame, config: CorpusConfig = CorpusConfig()) -> DataFrame:
    """Rows with both texts; plain null tests, so that they reach the scan."""
    return df.where(F.col(config.text_column).isNotNull() & F.col(config.summary_column).isNotNull())


def length_ok(config: CorpusConfig = CorpusConfig()) -> Column:
    """Both cleaned columns within their inclusive limits, in code points."""
    return F.length(f"{config.text_column}_clean").between(
        config.min_text_length, config.max_text_length
    ) & F.length(f"{config.summary_column}_clean").between(
        config.min_summary_length, config.max_summary_length
    )


def length_filter(df: DataFrame, config: CorpusConfig = CorpusConfig()) -> DataFrame:
    return df.where(length_ok(config))


def filter_audit(df: DataFrame, config: CorpusConfig = CorpusConfig()) -> DataFrame:
    """Rows in, removed as null, removed by length, rows out: one pass, one row."""
    pair = [config.text_column, config.summary_column]
    whole = F.col(pair[0]).isNotNull() & F.col(pair[1]).isNotNull()
    flags = clean_columns(df.select(*pair), pair, config).select(
        whole.alias("whole"), (whole & length_ok(config)).alias("kept")
    )
    return flags.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(~F.col("whole")).alias("removed_null"),
        F.count_if(F.col("whole") & ~F.col("kept")).alias("removed_length"),
        F.count_if("kept").alias("rows_out"),
    )


def add_ids(df: DataFrame, order_by: Sequence[str] = (), id_column: str = "id") -> DataFrame:
    """Add a globally unique, gap-free id from 0 when the column is missing.

    Without ``order_by`` rows are numbered by a hash of their content.
    """
    return df if id_column in df.columns else number_rows(df, order_by, id_column)


def preprocess(df: DataFrame, config: CorpusConfig = CorpusConfig()) -> DataFrame:
    """Null drop, cleaning and length filter as one lazy plan."""
    pair = [config.text_column, config.summary_column]
    require_columns(df, pair)
    return length_filter(clean_columns(drop_null_pairs(df, config), pair, config), config)


def validate(df: DataFrame, config: CorpusConfig = CorpusConfig()) -> DataFrame:
    """One row: valid flag, issues, row/column counts, null and blank counts."""
    absent = missing_columns(df, config.required_columns)
    issues = [f"missing columns: {absent}"] if absent else []

    def tally(name: str, missing: str, empty: str) -> list[Column]:
        if name not in df.columns:
            return [F.lit(0).cast("bigint").alias(missing), F.lit(0).cast("bigint").alias(empty)]
        blank = tx.trimmed(F.col(name).cast("string")) == ""
        return [F.count_if(F.col(name).isNull()).alias(missing), F.count_if(blank).alias(empty)]

    counted = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *tally(config.text_column, "missing_text", "empty_text"),
        *tally(config.summary_column, "missing_summary", "empty_summary"),
    )
    return counted.select(
        F.lit(not absent).alias("valid"),
        F.array(*[F.lit(issue) for issue in issues]).cast("array<string>").alias("issues"),
        F.lit(len(df.columns)).alias("total_columns"),
        *counted.columns,
    )


def measured_lengths(df: DataFrame, text: str, summary: str, *keep: str) -> DataFrame:
    """Only the two lengths, so that no text travels through the aggregation."""
    return df.select(*keep, F.length(text).alias("text"), F.length(summary).alias("summary"))


def describe_lengths() -> list[Column]:
    """Mean, exact median, minimum and maximum of both lengths.

    The median keeps one counter per distinct length, and the length limits bound
    the distinct lengths.
    """
    return [
        f(name).alias(f"{name}_{label}_length")
        for name in ("text", "summary")
        for label, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))
    ]


def sample_length_stats(
    df: DataFrame, order_by: Sequence[str], config: CorpusConfig = CorpusConfig()
) -> DataFrame:
    """Raw length statistics of the first ``sample_for_validation`` rows in order."""
    head = measured_lengths(df, config.text_column, config.summary_column, *order_by)
    return head.orderBy(*order_by).limit(config.sample_for_validation).agg(*describe_lengths())


def length_histogram(df: DataFrame, text: str, summary: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per length of both columns: ``by, which, length, n``.

    Counted on the map side; the length limits bound the distinct lengths.
    """
    lengths = measured_lengths(df, text, summary, *by)
    pair = F.array(*[F.struct(F.lit(name).alias("which"), F.col(name).alias("length")) for name in ("text", "summary")])
    return lengths.select(*by, F.inline(pair)).groupBy(*by, "which", "length").agg(F.count(F.lit(1)).alias("n"))


def length_stats(df: DataFrame, config: CorpusConfig = CorpusConfig(), by: Sequence[str] = ()) -> DataFrame:
    """Row count and length statistics over the cleaned columns; one row, or one per group.

    Rows are counted per length first, so that the exact median sees a small table.
    """
    counted = length_histogram(df, f"{config.text_column}_clean", f"{config.summary_column}_clean", by)
    out = [F.sum(F.when(F.col("which") == "text", F.col("n"))).alias("total_samples")]
    for name in ("text", "summary"):
        own = F.col("which") == name
        length, n = F.when(own, F.col("length")), F.when(own & F.col("length").isNotNull(), F.col("n"))
        out += [
            (F.sum(length * n) / F.sum(n)).alias(f"{name}_mean_length"),
            F.percentile(length, 0.5, F.coalesce(n, F.lit(0))).alias(f"{name}_median_length"),
            F.min(length).alias(f"{name}_min_length"),
            F.max(length).alias(f"{name}_max_length"),
        ]
    found = counted.groupBy(*by).agg(*out)
    return found.withColumn("total_samples", F.coalesce("total_samples", F.lit(0).cast("bigint")))


def text_column_profile(df: DataFrame, min_avg_length: float = 50, text_threshold: float = 0.8) -> DataFrame:
    """One row per string column: non-null ratio, mean length, and the verdict."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        empty = "column string, non_null_ratio double, avg_length double, is_text boolean"
        return df.sparkSession.createDataFrame([], empty)
    measured = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("column"),
                    (F.count(name) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("non_null_ratio"),
                    F.avg(F.length(F.coalesce(F.col(name), F.lit("")))).alias("avg_length"),
                )
                for name in names
            ]
        ).alias("found")
    )
    return measured.select(F.inline("found")).withColumn(
        "is_text",
        F.coalesce(
            (F.col("non_null_ratio") >= text_threshold) & (F.col("avg_length") >= min_avg_length), F.lit(False)
        ),
    )


def detect_text_columns(df: DataFrame, min_avg_length: float = 50, text_threshold: float = 0.8) -> list[str]:
    """Names of the long-text columns, in table order."""
    profile = text_column_profile(df, min_avg_length, text_threshold)
    found = {row["column"] for row in profile.where("is_text").select("column").collect()}
    return [name for name in df.columns if name in found]


# Bytes of input for one partition when none is asked for.
PARTITION_BYTES = 128 << 20


def repartition(df: DataFrame, n_partitions: int | None = None, bytes_per_partition: int = PARTITION_BYTES) -> DataFrame:
    """Explicit partition count, or one partition per ``bytes_per_partition`` of the planner's estimate.

    Nothing is counted; where the planner knows no size, the default parallelism is used.
    """
    if n_partitions is None:
        known = table_bytes(df)
        n_partitions = -(-known // bytes_per_partition) if known < 1 << 55 else df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, n_partitions))


def keep_columns(df: DataFrame, columns: Sequence[str], additional: Sequence[str] = ()) -> DataFrame:
    """Drop the originals, keep the listed columns plus requested pass-through ones."""
    wanted = [*columns, *[name for name in additional if name not in columns]]
    require_columns(df, wanted)
    return df.select(*wanted)


def validate_output(
    df: DataFrame,
    columns: Sequence[str] = ("text", "summary", "title"),
    id_column: str = "id",
    split_column: str = "split",
) -> DataFrame:
    """Per split: rows, blank fields, and ids that also occur in another split.

    Missing or non-string columns raise before any job runs.
    """
    require_columns(df, [*columns, id_column, split_column])
    wrong = [n for n in columns if not isinstance(df.schema[n].dataType, T.StringType)]
    if wrong:
        raise ValueError(f"columns must be strings: {wrong}")
    blank = [
        F.count_if(F.coalesce(tx.trimmed(F.col(name)), F.lit("")) == "").alias(f"empty_{name}") for name in columns
    ]
    quality = df.groupBy(split_column).agg(F.count(F.lit(1)).alias("rows"), *blank)
    # Copies of an id collapse in the first, map-side aggregation.
    spread = df.groupBy(id_column, split_column).agg(F.count(F.lit(1)).alias("_n"))
    shared = (
        spread.groupBy(id_column)
        .agg(F.collect_set(split_column).alias("_splits"))
        .select(F.explode("_splits").alias(split_column), (F.size("_splits") > 1).alias("_shared"))
    )
    leaks = shared.groupBy(split_column).agg(
        F.count(F.lit(1)).alias("distinct_ids"), F.count_if("_shared").alias("ids_in_other_splits")
    )
    return quality.join(leaks, split_column)
