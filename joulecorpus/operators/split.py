"""Train / validation / test splits.

A split needs two cut points in a seeded order, not a row number per row.  The
exact split therefore counts rows per hash bucket, finds the buckets that hold
the cut points, ranks only those, and finally compares every row with the cut
keys: one counting pass over the id column, and no shuffle of the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joulecorpus.config import CorpusConfig
from joulecorpus.operators.ordered import number_rows
from joulecorpus.session import durable, join_small

# Hex digits of the hash that name a bucket: at most 16**4 counters per stratum.
BUCKET_DIGITS = 4

# Stands for a missing id in the hash; no id can be this text.
NO_ID = "\u0000"

# The one group of a table without strata.
ALL = "_all"


def split_hash_key(id_column: str, seed: int) -> Column:
    """Null ids share one key of their own."""
    return F.md5(F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit(NO_ID)), F.lit(f":{seed}")))


def _sizes(total: Column, config: CorpusConfig) -> tuple[Column, Column]:
    n_test = F.ceil(F.lit(config.test_size) * total)
    n_validation = F.ceil(F.lit(config.val_size) * (total - n_test))
    return n_test, n_validation


def split_sizes(df: DataFrame, config: CorpusConfig = CorpusConfig(), strata: Sequence[str] = ()) -> DataFrame:
    """Exact split sizes, per stratum if strata are given."""
    counted = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n_total"))
    n_test, n_validation = _sizes(F.col("n_total"), config)
    return (
        counted.withColumn("n_test", n_test)
        .withColumn("n_validation", n_validation)
        .withColumn("n_train", F.col("n_total") - F.col("n_test") - F.col("n_validation"))
    )


def _locate(keyed: DataFrame, goals: DataFrame, group: Sequence[str]) -> DataFrame:
    """Where the ``_goal``-th row of each (group, ``_cut``) lies in the order of ``_h, _id``.

    Returns group, ``_cut, _h, _id``, the rows of that key, and how many of them come up
    to the goal.  Rows are counted per hash bucket; only the bucket that holds a goal is
    ranked, after equal keys have collapsed.
    """
    bucketed = keyed.withColumn("_bucket", F.substring("_h", 1, BUCKET_DIGITS))
    # Bounded: at most 16**BUCKET_DIGITS rows per group, counted on the map side.
    counts = bucketed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    in_order = Window.partitionBy(*group, F.lit(0)).orderBy("_bucket")
    counts = counts.withColumn("_before", F.sum("_n").over(in_order) - F.col("_n"))
    targets = join_small(counts, goals, list(group)).withColumn("_rank", F.col("_goal") - F.col("_before"))
    names = list(dict.fromkeys([*group, "_cut"]))
    targets = targets.where("_rank > 0 and _rank <= _n").select(*names, "_bucket", "_rank")
    inside = join_small(bucketed, targets, [*group, "_bucket"])
    inside = inside.groupBy(*names, "_rank", "_h", "_id").agg(F.count(F.lit(1)).alias("_copies"))
    walk = Window.partitionBy(*names, "_rank").orderBy("_h", "_id")
    return (
        inside.withColumn("_upto", F.sum("_copies").over(walk))
        .withColumn("_take", F.col("_rank") - (F.col("_upto") - F.col("_copies")))
        .where("_take > 0 and _take <= _copies")
        .select(*names, F.struct("_h", "_id").alias("_key"), "_take", "_copies")
    )


def _side_by_side(found: DataFrame, group: Sequence[str]) -> DataFrame:
    """One row per group: key, take and copies of both cuts; a missing cut is null."""
    return found.groupBy(*group).agg(
        *[
            F.max(F.when(F.col("_cut") == cut, F.col(name))).alias(f"_{cut}{name}")
            for cut in ("test", "validation")
            for name in ("_key", "_take", "_copies")
        ]
    )


def _attach(df: DataFrame, side: DataFrame, strata: Sequence[str]) -> DataFrame:
    """The columns of ``side`` on every row: by stratum, or as constants if there is one group."""
    if strata:
        return join_small(df, side, list(strata), "left")
    side = side.drop(ALL)
    row = side.first()
    constants = {}
    for field in side.schema.fields:
        value = row[field.name] if row else None
        if value is None or not isinstance(field.dataType, T.StructType):
            constants[field.name] = F.lit(value).cast(field.dataType)
        else:
            constants[field.name] = F.struct(*(F.lit(value[f.name]).cast(f.dataType).alias(f.name) for f in field.dataType.fields))
    return df.withColumns(constants)


def split_exact(
    df: DataFrame, config: CorpusConfig = CorpusConfig(), id_column: str = "id", strata: Sequence[str] = ()
) -> DataFrame:
    """Add ``split``: seeded, disjoint, exhaustive, with the exact sizes.

    Rows are ordered by ``md5(id:seed)``, id and a hash of the whole row; the first
    ``n_test`` are test, the next ``n_validation`` validation, the rest train.  Null ids and
    null strata are values like any other.
    """
    group = list(strata) or [ALL]
    names = list(strata) or [F.lit(0).alias(ALL)]
    key = F.struct(split_hash_key(id_column, config.random_state).alias("_h"), F.col(id_column).alias("_id"))
    keyed = df.select(*names, key["_h"].alias("_h"), key["_id"].alias("_id"))
    goals = [F.struct(F.lit("test").alias("_cut"), F.col("n_test").alias("_goal"))]
    goals.append(F.struct(F.lit("validation").alias("_cut"), (F.col("n_test") + F.col("n_validation")).alias("_goal")))
    wanted = split_sizes(keyed, config, group).select(*group, F.inline(F.array(*goals)))
    found = durable(_locate(keyed, wanted, group))
    placed = _attach(df, _side_by_side(found, group), strata)
    test, validation = F.col("_test_key"), F.col("_validation_key")
    side = F.when(key <= test, "test").when(key <= validation, "validation").otherwise("train")
    divided = found.where("_take < _copies")
    if divided.isEmpty():
        return placed.withColumn("split", side).select(*df.columns, "split")

    # A cut falls among rows of one id: those are ordered by a hash of the row, texts staying put.
    hashed = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    content = F.struct(F.md5(F.xxhash64(*hashed).cast("string")).alias("_h"), F.xxhash64(*hashed).alias("_id"))
    on_cut = {cut: key == F.col(f"_{cut}_key") for cut in ("test", "validation")}
    tied = placed.select(
        *names,
        F.explode(F.array(*[F.when(on, cut) for cut, on in on_cut.items()])).alias("_cut"),
        content["_h"].alias("_h"),
        content["_id"].alias("_id"),
    ).where("_cut is not null")
    inner = durable(_locate(tied, divided.select(*group, "_cut", F.col("_take").alias("_goal")), [*group, "_cut"]))
    second = _side_by_side(inner, group).withColumnsRenamed(
        {f"_{cut}{name}": f"_{cut}_row{name}" for cut in on_cut for name in ("_key", "_take", "_copies")}
    )
    both = _attach(placed, second, strata)
    before = {cut: key < F.col(f"_{cut}_key") for cut in on_cut}
    exact = {cut: on_cut[cut] & (content == F.col(f"_{cut}_row_key")) for cut in on_cut}
    for cut, on in on_cut.items():
        row = F.col(f"_{cut}_row_key")
        before[cut] |= on & (row.isNull() | (content < row) | ((content == row) & (F.col(f"_{cut}_row_take") == F.col(f"_{cut}_row_copies"))))
    side = F.when(before["test"], "test").when(before["validation"], "validation").otherwise("train")
    if inner.where("_take < _copies").isEmpty():
        return both.withColumn("split", side).select(*df.columns, "split")

    # The cut falls among exact copies of one row: only these are numbered.
    parted = {cut: F.coalesce(exact[cut] & (F.col(f"_{cut}_row_take") < F.col(f"_{cut}_row_copies")), F.lit(False)) for cut in on_cut}
    plain = both.where(~(parted["test"] | parted["validation"])).withColumn("split", side)
    copies = both.where(parted["test"] | parted["validation"]).withColumn("_copy_hash", content["_id"])
    takes = ["_test_row_take", "_validation_row_take"]
    flags = {f"_{cut}_parted": parted[cut] for cut in on_cut} | {f"_{cut}_before": F.coalesce(before[cut], F.lit(False)) for cut in on_cut}
    copies = copies.withColumns(flags).select(*df.columns, "_copy_hash", *takes, *flags)
    numbered = number_rows(copies, [*strata, "_copy_hash"], "_copy")
    first = numbered.groupBy(*strata, "_copy_hash").agg(F.min("_copy").alias("_first"))
    numbered = join_small(numbered, first, [*strata, "_copy_hash"]).withColumn("_copy", F.col("_copy") - F.col("_first"))
    within = {cut: F.col(f"_{cut}_before") | (F.col(f"_{cut}_parted") & (F.col("_copy") < F.col(f"_{cut}_row_take"))) for cut in on_cut}
    numbered = numbered.withColumn("split", F.when(within["test"], "test").when(within["validation"], "validation").otherwise("train"))
    return plain.select(*df.columns, "split").unionByName(numbered.select(*df.columns, "split"))


def split_hash(df: DataFrame, config: CorpusConfig = CorpusConfig(), id_column: str = "id") -> DataFrame:
    """Approximate sizes, no pass over the data, and stable when rows are appended."""
    digits = F.substring(split_hash_key(id_column, config.random_state), 1, 8)
    share = F.conv(digits, 16, 10).cast("double") / F.lit(float(2**32))
    upto = config.test_size + (1.0 - config.test_size) * config.val_size
    side = F.when(share < config.test_size, "test").when(share < upto, "validation").otherwise("train")
    return df.withColumn("split", side)
