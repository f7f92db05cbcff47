"""Sketched lengths against exact ranks; only changed parts are read again."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from joulecorpus.operators import length_sketch
from joulecorpus.session import scratch_path

QUANTILES = [0.0, 0.01, 0.1, 0.5, 0.9, 0.99, 1.0]


def test_ranks_and_second_run(spark):
    source, table = scratch_path(spark, "texts"), scratch_path(spark, "sketches")
    size = F.pmod(F.xxhash64("id"), F.lit(3_000))
    text = F.when(F.col("id") % 11 != 0, F.repeat(F.lit("é"), F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(size).cast("int")))
    rows = spark.range(60_000).select("id", text.alias("text"), F.lit(None).cast("string").alias("none"), (F.col("id") % 6).alias("part"))
    rows.where("part < 4").write.partitionBy("part").parquet(source)
    columns = ["text", "none"]
    first = length_sketch.refresh_lengths(spark, source, table, columns, "part")
    assert first.read == ("0", "1", "2", "3")
    rows.where("part >= 4").write.mode("append").partitionBy("part").parquet(source)
    assert length_sketch.refresh_lengths(spark, source, table, columns, "part").read == ("4", "5")
    assert length_sketch.refresh_lengths(spark, source, table, columns, "part").read == ()
    found = length_sketch.lengths_so_far(spark, table, QUANTILES).collect()
    exact = np.array([r[0] for r in rows.where("text is not null").select(F.length("text")).collect()])
    assert {r.which for r in found} == {"text"} and len(found) == len(QUANTILES)
    for r in found:
        assert (r.n, r.shortest, r.longest) == (len(exact), exact.min(), exact.max()) and abs(r["mean"] - exact.mean()) < 1e-9
        below, upto = (exact < r.length).mean(), (exact <= r.length).mean()
        assert below - length_sketch.RANK_ERROR <= r.quantile <= upto + length_sketch.RANK_ERROR


def test_without_rows(spark):
    empty = spark.createDataFrame([], "part int, text string")
    assert length_sketch.merged_lengths(length_sketch.length_sketches(empty, ["text"], "part"), [0.5]).collect() == []
