"""Small DataFrame helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of the texts that go to a Python worker at a time; both sides hold a batch several times.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    asked = int(spark.conf.get(name).rstrip("b"))
    if not 0 < asked <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """The planner's estimate of the data below ``df``, 0 if it has none.

    Sizes partitions, never decides results.
    """
    estimate = int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    return estimate if estimate < 1 << 55 else 0


def version_of(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """Tells texts of one id apart: 0 unless some id has several texts, so that it costs nothing to carry."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h")).where("doc_id is not null")
    shared = hashed.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a < b")
    return F.lit(0).cast("bigint") if shared.isEmpty() else F.shiftrightunsigned(F.xxhash64(text), 1)


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, version, text``: null texts are empty."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        version_of(docs, id_col, text_col).alias("version"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def row_keys(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes that identical rows share, and only they."""
    values = [F.to_json(F.struct(F.col(c))) if kind.startswith(("map", "variant")) else F.col(c) for c, kind in docs.dtypes]
    nulls = F.concat(*(F.col(c).isNull().cast("string") for c in docs.columns))
    return F.xxhash64(*values, nulls), F.xxhash64(F.lit(1), nulls, *reversed(values))


def bounded_sample(df: DataFrame, key: Column, size: int) -> DataFrame:
    """At most ``size`` rows, the same for any partitioning: the smallest of each bucket of ``key``.

    ``key`` is a hash.  Aggregated before the shuffle, so a task sends ``size`` rows at most,
    and none to the driver.
    """
    rows = df.select(F.pmod(key, F.lit(size)).alias("bucket"), F.struct(key.alias("sample_key"), *df.columns).alias("row"))
    return rows.groupBy("bucket").agg(F.min("row").alias("row")).select("row.*")
