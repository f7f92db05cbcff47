"""Length quantiles of very large tables from sketches that are kept for each part and merged.

A part's sketch is computed once; ``partials.refresh`` reads only parts whose files have changed, and a
question merges one small row for each part, so nothing is sorted or read again.  Counts, means and extremes are
exact; a quantile's rank is off by at most ``RANK_ERROR`` of the rows (the sketch of ``K`` states
0.3 % with a confidence of 99 %, merged or not).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joulecorpus.operators import partials

K = 1_000
RANK_ERROR = 0.005


def length_sketches(df: DataFrame, columns: Sequence[str], *by: str) -> DataFrame:
    """Per group and column ``which, n, total, shortest, longest, sketch`` of the lengths of present texts.

    Sketches are built on the map side and merged by the shuffle.  A column without texts has ``n`` 0 and no sketch.
    """
    lengths = F.array(*[F.struct(F.lit(name).alias("which"), F.length(name).cast("bigint").alias("length")) for name in columns])
    return df.select(*by, F.inline(lengths)).groupBy(*by, "which").agg(
        F.count("length").alias("n"),
        F.sum("length").alias("total"),
        F.min("length").alias("shortest"),
        F.max("length").alias("longest"),
        F.kll_sketch_agg_bigint("length", K).alias("sketch"),
    )


def merged_lengths(sketches: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """Per column and quantile: exact count, mean and extremes, and the sketched ``length``."""
    some = sketches.where("n > 0").groupBy("which").agg(
        F.sum("n").alias("n"),
        (F.sum("total") / F.sum("n")).alias("mean"),
        F.min("shortest").alias("shortest"),
        F.max("longest").alias("longest"),
        F.kll_merge_agg_bigint("sketch", K).alias("sketch"),
    )
    found = {float(q): F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(q))) for q in quantiles}
    asked = [F.struct(F.lit(q).alias("quantile"), length.alias("length")) for q, length in found.items()]
    return some.select("which", "n", "mean", "shortest", "longest", F.inline(F.array(*asked)))


def refresh_lengths(spark: SparkSession, source: str, table: str, columns: Sequence[str], part: str) -> partials.Refreshed:
    """Bring the sketches below ``table`` up to date with a Parquet table partitioned by ``part``."""
    return partials.refresh(spark, source, table, part, lambda raw, by: length_sketches(raw, columns, by))


def lengths_so_far(spark: SparkSession, table: str, quantiles: Sequence[float]) -> DataFrame:
    """``merged_lengths`` over all parts that ``refresh_lengths`` has seen."""
    return merged_lengths(partials.kept_parts(spark, table), quantiles)
