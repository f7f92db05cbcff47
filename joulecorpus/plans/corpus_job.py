"""The corpus job: load, validate, clean, filter, id, split, save, describe."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from joulecorpus.config import CorpusConfig
from joulecorpus.operators import corpus, split
from joulecorpus.session import as_table
from joulecorpus.sinks.writers import save
from joulecorpus.sources.readers import load_data


def prepared(df: DataFrame, config: CorpusConfig = CorpusConfig(), order_by: Sequence[str] = ()) -> DataFrame:
    """Cleaned, filtered, identified and split rows.

    Without an id column and an order, ids follow a hash of the row.
    The cleaned rows are written once as a columnar scratch table: the split's
    counting pass then reads only the id column, and the statistics only the
    cleaned texts.
    """
    rows = as_table(corpus.preprocess(df, config), "prepared")
    id_column = config.id_column
    if id_column not in df.columns:
        id_column = "id"
        rows = corpus.add_ids(rows, order_by)
    return split.split_exact(rows, config, id_column, config.stratify_by)


def corpus_statistics(prepared_rows: DataFrame, config: CorpusConfig = CorpusConfig()) -> DataFrame:
    """Row counts and length statistics per split."""
    return corpus.length_stats(prepared_rows, config, ["split"])


def prepare_corpus(
    spark: SparkSession,
    path: str,
    config: CorpusConfig = CorpusConfig(),
    formats: Sequence[str] | None = None,
    order_by: Sequence[str] = (),
    **reader_options: Any,
) -> dict[str, Any]:
    """The whole job with a success / error envelope.

    ``saved_files`` maps format to path; ``statistics`` (with the number of
    ``partitions``) and, if asked for, ``validation`` (with the lengths of the first rows as
    ``sample``) are single rows as dicts.
    """
    try:
        raw = load_data(spark, path, config, **reader_options)
        checked = corpus.validate(raw, config).first().asDict() if config.validate_data_quality else None
        if checked:
            first = [config.id_column] if config.id_column in raw.columns else [config.text_column]
            checked["sample"] = corpus.sample_length_stats(raw, list(order_by) or first, config).first().asDict()
        rows = prepared(raw, config, order_by)
        stats = corpus.length_stats(rows, config).first().asDict() | {"partitions": rows.rdd.getNumPartitions()}
        if not stats["total_samples"]:
            raise ValueError("no valid rows left")
        saved = save(rows, config.output_dir, formats, config)
    except Exception as error:  # noqa: BLE001 - the envelope reports every failure
        return {"success": False, "error": str(error), "message": "corpus preparation failed"}
    return {
        "success": True,
        "saved_files": saved,
        "statistics": stats,
        "validation": checked,
        "message": "corpus prepared",
    }


def prepare_jsonl(
    spark: SparkSession, path: str, splits: Sequence[str] = ("train", "validation", "test"), **settings: Any
) -> dict[str, Any]:
    """The job with JSONL output; ``saved_files`` maps each wanted split to its folder."""
    result = prepare_corpus(spark, path, CorpusConfig(output_format="jsonl", **settings))
    if result["success"]:
        base = result["saved_files"]["jsonl"]
        result["saved_files"] = {name: f"{base}/split={name}" for name in splits}
    return result
