"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from joulecorpus.config import CorpusConfig
from joulecorpus.operators import corpus, ordered, split, telemetry, tokens
from joulecorpus.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> list[str]:
    return re.findall(r"(?<!Broadcast)Exchange (\w+)", text)


@pytest.fixture
def documents(spark):
    return fx.table(spark, SF, "documents").selectExpr("doc_id", "lang", "text AS Texto", "text AS Resumo", "source AS Processo")


def test_cleaning_stays_in_the_jvm_and_shuffles_nothing(documents):
    text = plan(corpus.preprocess(documents))
    assert "Python" not in text and exchanges(text) == []
    assert "PushedFilters: [IsNotNull(text)]" in text


def test_tokens_stay_in_the_jvm(documents):
    text = plan(tokens.tokenize_pad(documents, F.col("Texto")))
    assert "Python" not in text and exchanges(text) == []
    assert "ReadSchema: struct<text:string>" in text


def test_exact_split_does_not_shuffle_the_corpus(documents):
    text = plan(split.split_exact(documents, CorpusConfig(), "doc_id"))
    assert exchanges(text) == [] and "Join" not in text


def test_split_by_stratum_only_broadcasts_the_cut_keys(documents):
    text = plan(split.split_exact(documents, CorpusConfig(), "doc_id", ["lang"]))
    assert exchanges(text) == [] and "BroadcastHashJoin" in text


def test_length_statistics_read_lengths_only(spark, documents):
    text = plan(corpus.length_stats(corpus.clean_columns(documents, ["Texto", "Resumo"])))
    # Counted per length by hash before the first shuffle; one reducer sees that table alone.
    assert exchanges(text) == ["SinglePartition", "hashpartitioning"]  # as the plan prints them, last first
    assert "ReadSchema: struct<text:string>" in text
    assert text.rindex("partial_count") > text.rindex("Exchange hashpartitioning(which")


def test_statistics_aggregate_by_hash_before_they_shuffle(spark):
    readings = fx.telemetry(spark, SF)
    unified = telemetry.unify_readings(readings)
    text = plan(telemetry._partials(unified, "run_id", "gpu_id"))
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text
    assert text.index("HashAggregate") < text.index("Exchange hashpartitioning") < text.index("partial_sum")
    facts = plan(telemetry.run_facts(telemetry.tag_phase(readings, 5.0)))
    assert "SortAggregate" not in facts and "SortMergeJoin" not in facts


def test_ordered_joins_never_partition_rows_by_the_bare_run(spark):
    readings = fx.telemetry(spark, SF).select("run_id", "ts", "event_id")
    marks = readings.where("event_id % 50 = 0").withColumn("m", F.col("event_id"))
    text = plan(ordered.attach_latest(readings, marks, ["run_id"], "ts", "m", 3600.0))
    for window, keys in re.findall(r"Window \[(.*?)\], \[([^\]]*)\], \[", text):
        if "_block" not in keys:  # only the table with one row per block may do that
            assert "_mark" in window and "_row" not in window
    assert "Cartesian" not in text and "NestedLoop" not in text
