"""Registered queries of the training-data operators, with the parameters of production."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joulecorpus.llm.frames import table
from joulecorpus.llm import lexical_search, mixing, pii, quality, sentencepiece_codec
from joulecorpus.llm.line_dedup import line_dedup
from joulecorpus.llm.nearest import nearest
from joulecorpus.llm.sharding import pack_shards
from joulecorpus.llm.simhash_dedup import simhash_components
from joulecorpus.llm.span_dedup import span_dedup
from joulecorpus.llm.substring_dedup import substring_dedup
from joulecorpus.llm.syncmers import compared_with_next
from joulecorpus.llm.token_alignment import alignment

Query = Callable[[SparkSession, str], DataFrame]


#: The vocabulary files' folder is a parameter of the cluster.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"
BYTE_PAIRS = f"{TOKENIZERS}/byte_bpe_50k.json"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digest(pii.find_pii(docs, pii.fit(docs)))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.curriculum(table(spark, sf_dir, "documents"))
    return mixing.by_position(mixed).select("doc_id", "size", "source_size", "target", "taken")


def op4_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = span_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_shards(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"), PIECES)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.assess(docs, model).select("doc_id", *quality.RULES, "base_failed", "kept", "score")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_with_next(table(spark, sf_dir, "documents"), whole=True)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"), BYTE_PAIRS, PIECES)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_pii": op1_pii,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_mixing": op3_mixing,
    "op4_span_dedup": op4_span_dedup,
    "op5_sharding": op5_sharding,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_quality": op7_quality,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_nearest": op9_nearest,
    "op10_line_dedup": op10_line_dedup,
    "op11_fingerprints": op11_fingerprints,
    "op12_alignment": op12_alignment,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES: dict[str, str] = {"op3_mixing": mixing.ORACLE, "op13_lexical_search": lexical_search.ORACLE}
