"""Ordered operators that never hold a whole key in one task.

A hot run may own a third of all rows, so nothing here opens a window over a
bare key.  Rows are cut into blocks (time blocks of one key, or the range
partitions of a global sort); a small per-block table carries what a block needs
to know about its predecessors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joulecorpus.session import as_table, join_small

_BLOCK = "_block"


def time_block(time: Column, width_s: float) -> Column:
    return F.floor(time / F.lit(float(width_s)))


def number_rows(df: DataFrame, order_by: Sequence[str] = (), name: str = "row_number", start: int = 0) -> DataFrame:
    """Global row number in the given order, or in that of a hash of the row if none is given.

    One range shuffle sorts the rows into a written table, one file per
    partition.  A row's number is then its position in its file, which the reader
    knows, plus the rows of the files before it.

    Ties are ordered by a hash of the whole row, so a repeated task sends a row to
    the same place; only exact copies fall back on their position in the input,
    which spreads them over partitions.  That position is stable when ``df`` scans a
    stored table.
    """
    hashed = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    ties = ["_content", "_place"]
    ordered = (
        df.withColumns({"_content": F.xxhash64(*hashed), "_place": F.monotonically_increasing_id()})
        .repartitionByRange(*order_by, *ties)
        .sortWithinPartitions(*order_by, *ties)
        .drop(*ties)
    )
    # A writer may roll a partition into several files, which it numbers in order.
    number = [F.regexp_extract("_metadata.file_name", p, 1).cast("bigint") for p in (r"^part-(\d+)", r"-c(\d+)\.")]
    file = F.struct(*(n.alias(f"n{k}") for k, n in enumerate(number)))
    placed = as_table(ordered, "ordered").select("*", file.alias("_file"), F.col("_metadata.row_index").alias("_pos"))
    # One row per file of the sorted table: bounded by the shuffle partitions and the roll size.
    counts = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        join_small(placed, offsets, ["_file"])
        .withColumn(name, F.col("_offset") + F.col("_pos") + F.lit(start))
        .drop("_file", "_pos", "_offset")
    )


def number_within(
    df: DataFrame, keys: Sequence[str], time: str, order_by: Sequence[str], block_s: float, name: str
) -> DataFrame:
    """1-based position inside each key, by time block plus a per-block offset."""
    blocked = df.withColumn(_BLOCK, time_block(F.col(time), block_s))
    sizes = blocked.groupBy(*keys, _BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, _BLOCK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(*order_by)
    return (
        blocked.withColumn("_at", F.row_number().over(inside))
        .join(offsets, [*keys, _BLOCK])
        .withColumn(name, F.col("_offset") + F.col("_at"))
        .drop(_BLOCK, "_offset", "_at")
    )


def _as_of(
    rows: DataFrame,
    marks: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str,
    block_s: float,
    times: DataFrame | None,
    first_of_time: tuple[str, str] | None,
    forward: bool,
) -> DataFrame:
    block = time_block(F.col(time), block_s).alias(_BLOCK)
    left = rows.select(*keys, block, F.col(time).alias("_t"), F.lit(1).alias("_kind"), F.struct(*rows.columns).alias("_row"))
    right = marks.select(*keys, block, F.col(time).alias("_t"), F.lit(0).alias("_kind"), F.col(value).alias("_mark"))
    # Per block: its own outermost mark, then the nearest one beyond the block.
    pick = F.min if forward else F.max
    occupied = (rows if times is None else times).select(*keys, block)
    per_block = (
        occupied.unionByName(
            right.select(*keys, _BLOCK, F.struct("_t", "_mark").alias("_mark")), allowMissingColumns=True
        )
        .groupBy(*keys, _BLOCK)
        .agg(pick("_mark").getField("_mark").alias("_mark"))
    )
    order = F.col(_BLOCK).desc() if forward else F.col(_BLOCK).asc()
    beyond = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(
        *keys,
        _BLOCK,
        F.lit(float("inf") if forward else float("-inf")).alias("_t"),
        F.lit(-1).alias("_kind"),
        F.last("_mark", ignorenulls=True).over(beyond).alias("_mark"),
    ).where(F.col("_mark").isNotNull())
    together = left.unionByName(right, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)

    by_time = (
        [F.col("_t").desc(), F.col("_kind"), F.col("_mark").desc()]
        if forward
        else [F.col("_t"), F.col("_kind"), F.col("_mark")]
    )
    if first_of_time:
        by_time.append(F.col(f"_row.{first_of_time[0]}").desc())
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(*by_time)
    found = {"_mark": F.last("_mark", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))}
    extra = []
    if first_of_time:
        found["_same"] = F.coalesce((F.lag("_t").over(inside) == F.col("_t")) & (F.lag("_kind").over(inside) == 1), F.lit(False))
        extra = [(~F.col("_same")).alias(first_of_time[1])]
    return (
        together.withColumns(found)
        .where(F.col("_kind") == 1)
        .select("_row.*", F.col("_mark").alias(value), *extra)
    )


def attach_latest(
    rows: DataFrame,
    marks: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str,
    block_s: float,
    times: DataFrame | None = None,
) -> DataFrame:
    """Add to every row the ``value`` of the latest mark at or before its time.

    ``times`` may name a cheaper frame with the keys and times of the rows, when
    the rows are themselves the result of an aggregation.
    """
    return _as_of(rows, marks, keys, time, value, block_s, times, None, forward=False)


def attach_next(
    rows: DataFrame,
    marks: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str,
    block_s: float,
    times: DataFrame | None = None,
    first_of_time: tuple[str, str] | None = None,
) -> DataFrame:
    """Add to every row the ``value`` of the first mark at or after its time.

    ``first_of_time=(column, flag)`` also adds ``flag``, true for one row of each
    time: one with the highest ``column``.
    """
    return _as_of(rows, marks, keys, time, value, block_s, times, first_of_time, forward=True)
