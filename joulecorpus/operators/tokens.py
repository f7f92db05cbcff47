"""Token columns, token statistics and tokenised training examples."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joulecorpus.functions import text as tx
from joulecorpus.functions import tokens as tk
from joulecorpus.operators.corpus import detect_text_columns, require_columns

Encoder = Callable[[Column], Column]


def token_column(name: str) -> str:
    return f"tokens_{name.lower()}"


def add_token_counts(
    df: DataFrame, columns: Sequence[str] | None = None, counter: Encoder | None = None, **thresholds: float
) -> DataFrame:
    """Add ``tokens_{column}``; without a list the long-text columns are detected by ``thresholds``."""
    columns = detect_text_columns(df, **thresholds) if columns is None else list(columns)
    require_columns(df, columns)
    return df.withColumns({token_column(n): tk.token_count(F.col(n), counter) for n in columns})


def token_stats(
    df: DataFrame, columns: Sequence[str] | None = None, counter: Encoder | None = None, **thresholds: float
) -> DataFrame:
    """One row per column: min, max, mean, total tokens and rows with content."""
    columns = detect_text_columns(df, **thresholds) if columns is None else list(columns)
    counted = add_token_counts(df, columns, counter)
    measured = counted.agg(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("column"),
                    F.min(token_column(name)).alias("min_tokens"),
                    F.max(token_column(name)).alias("max_tokens"),
                    F.avg(token_column(name)).alias("mean_tokens"),
                    F.sum(token_column(name)).alias("total_tokens"),
                    F.count(name).alias("rows_with_content"),
                )
                for name in columns
            ]
        ).alias("found")
    )
    return measured.select(F.inline("found"))


def tokenize_pad(
    df: DataFrame,
    text: Column,
    keep: Sequence[str] = (),
    encoder: Encoder | None = None,
    length: int = tk.BLOCK,
    pad_id: int = tk.PAD_ID,
) -> DataFrame:
    """``input_ids`` and ``attention_mask`` of fixed length; originals are dropped."""
    ids = encoder(text) if encoder else tk.hash_ids(text, length)
    return df.select(*keep, ids.alias("_ids")).select(
        *keep,
        tk.padded(F.col("_ids"), length, pad_id).alias("input_ids"),
        tk.attention_mask(F.col("_ids"), length).alias("attention_mask"),
    )


def add_labels(df: DataFrame) -> DataFrame:
    return df.withColumn("labels", F.col("input_ids"))


def preview(df: DataFrame, order_by: Sequence[str], text: str = "text", rows: int = 3, width: int = 150) -> DataFrame:
    """The first rows in order, labelled and cut to ``width`` characters."""
    head = df.select(*order_by, text).orderBy(*order_by).limit(rows)
    numbered = head.agg(
        F.array_sort(F.collect_list(F.struct(*order_by, F.col(text).alias("_text")))).alias("_head")
    ).select(F.posexplode("_head").alias("_at", "_row"))
    return numbered.select(
        F.concat(F.lit("Exemplo "), F.col("_at") + 1).alias("exemplo"),
        F.concat(F.substring("_row._text", 1, width), F.lit("...")).alias("conteúdo"),
    )


def assemble_training_set(
    df: DataFrame,
    source: str,
    text: str = "text",
    keep: Sequence[str] = (),
    encoder: Encoder | None = None,
    length: int = tk.BLOCK,
) -> DataFrame:
    """Prompt, tokenise, pad, label; ``source`` records where the rows came from."""
    tokenised = tokenize_pad(df, tx.prompt_text(F.col(text)), keep, encoder, length)
    return add_labels(tokenised).withColumn("dataset_source", F.lit(source))


def format_examples(
    df: DataFrame, template: str, text: str, summary: str, id_column: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Templated ``{text}`` rows, or raw ``{text, summary, id}`` rows without a template."""
    if template:
        filled = tx.fill_template(template, text=F.col(text), summary=F.col(summary))
        return df.select(filled.alias("text"), *keep)
    return df.select(
        F.col(text).alias("text"), F.col(summary).alias("summary"), F.col(id_column).cast("string").alias("id"), *keep
    )
