"""Operator 3: mix sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1.  Source ``s`` with target ``T`` is read at the rate
``T * (1 + slope * (2t - 1))``; slopes alternate, so some sources fade in and others fade
out, and every rate integrates to its target.  The integral, the cumulative demand, is
inverted in closed form: the words of a source, laid end to end and repeated until the
target is met, get their training positions, and documents are range-sorted by position.

Only built-in functions are used.  Running sums are two-level: sums per (source, slice of
hashed ids), running totals over that small table, and a window inside each slice.  No
window spans a source, so a source with a third of all rows is cut like any other.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joulecorpus.session import as_table

WORD = r"[^\x20\x09-\x0D]+"
#: No document is taken more often than this.
REPEATS = 3
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: Strength of fading in and out, below 1 so that every rate is positive.
SLOPE = 0.5
#: Rows of a slice on average; sizes the work, never the result.
SLICE_ROWS = 20_000


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target, slope``, one row per source of ``sizes(source, size)``.

    Sources in code-point order, null last, weigh 1, 2, 3 and so on in turn and share the sum
    of all sizes; a target ends at ``REPEATS`` times the source's size, and the excess goes
    to the others by weight.  That is a water level: sources whose limit per weight is
    lowest are filled first, and one level serves the rest.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source: the unpartitioned windows below see that small table alone.
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = reduce(
        lambda rest, x: F.when(F.col("rank") % len(WEIGHTS) == (x[0] + 1) % len(WEIGHTS), x[1]).otherwise(rest),
        enumerate(WEIGHTS),
        F.lit(None),
    )
    limit = F.col("source_size") * REPEATS
    filled = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    upto, everything = filled.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(upto), F.lit(0))) / F.sum("weight").over(
        filled.rowsBetween(0, Window.unboundedFollowing)
    )
    levels = ranked.withColumn("weight", weight.cast("bigint")).withColumn("limit", limit).withColumn("level", level)
    # The first source whose limit is not reached sets the level; if all are reached there is none.
    first = F.min(F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.struct(F.col("limit") / F.col("weight"), "rank", "level")))
    common = first.over(everything)["level"]
    share = F.col("weight") * common
    target = F.when(common.isNull() | (F.col("limit") <= share), F.col("limit").cast("double")).otherwise(share)
    slope = F.when(F.col("rank") % 2 == 0, SLOPE).otherwise(-SLOPE)
    return levels.select("source", "source_size", F.round(target, 6).alias("target"), slope.alias("slope"))


def invert_demand(share: Column, slope: Column) -> Column:
    """The time at which a source has read ``share`` of its target: t with t + slope * (t*t - t) = share."""
    linear = 1 - slope
    return 2 * share / (linear + F.sqrt(linear * linear + 4 * slope * share))


def placed(docs: DataFrame, whole: bool, text_col: str, id_col: str, source_col: str) -> DataFrame:
    """``docs`` with ``__mix``: a struct of size, source_size, target, slope and the copies taken.

    A copy is (begin, take): where its words begin in the source's demand, and how many are taken.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")
    # Sources compare by a key that is never null.
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    id_ = F.col(id_col).cast("bigint")
    facts = {"__key": key, "__ordered": F.md5(id_.cast("string")), "__id": id_, "__size": size}
    slim = as_table(docs.select(*(c.alias(n) for n, c in facts.items())), "sizes")
    # A slice is a range of the hash, cut at so many hexadecimal digits.
    digits = max(2, math.ceil(math.log(max(slim.count(), 1) / SLICE_ROWS, 16)))
    cut = F.coalesce(F.substring("__ordered", 1, digits), F.lit("~"))
    slim = slim.withColumn("__slice", cut)
    named = F.when(F.col("__key") != "", F.substring("__key", 2, 1 << 30))
    level = targets(slim.select(named.alias("source"), F.col("__size").alias("size")))
    level = level.withColumn("__key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source").withColumnsRenamed({n: f"__{n}" for n in ("source_size", "target", "slope")})
    before = Window.partitionBy("__key").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slim.groupBy("__key", "__slice").agg(F.sum("__size").alias("n"))
    slices = slices.select("__key", "__slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__slice_at"))
    table = as_table(slices.join(level, "__key"), "targets")
    rows = docs.withColumns(facts).withColumn("__slice", cut)
    inside = Window.partitionBy("__key", "__slice").orderBy(F.col("__ordered").asc_nulls_last(), "__id", "__size")
    within = F.sum("__size").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    joined = rows.withColumn("__at", F.coalesce(within, F.lit(0))).join(table, ["__key", "__slice"])
    words = F.round("__target").cast("bigint")

    def copy(k: Column) -> Column:
        begin = F.col("__slice_at") + F.col("__at") + k * F.col("__source_size")
        if whole:
            take = F.when(begin + F.col("__size") / 2 <= words, F.col("__size")).otherwise(F.lit(0).cast("bigint"))
        else:
            take = F.greatest(F.least(F.col("__size"), words - begin), F.lit(0).cast("bigint"))
        return F.struct(begin.alias("begin"), take.alias("take"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(REPEATS - 1)), copy), lambda x: x["take"] > 0)
    mix = F.struct(*(F.col(f"__{n}").alias(n) for n in ("size", "source_size", "target", "slope")), copies.alias("copies"))
    return joined.select(*docs.columns, mix.alias("__mix"))


def positions() -> Column:
    """Training positions of the copies in ``__mix``."""
    share = lambda x: F.least(x["begin"] / F.col("__mix.target"), F.lit(1.0))
    return F.transform("__mix.copies", lambda x: invert_demand(share(x), F.col("__mix.slope")))


def curriculum(docs: DataFrame, whole: bool = False, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source, source_size, target, taken, positions`` for every row.

    ``size`` counts words, ``taken`` the words that the mix takes with repeats, and
    ``positions`` has the training position of each copy.  Within a source documents follow
    the hash of their id.  The last document of a source is taken up to the word that meets the
    target; with ``whole`` each copy is taken whole if its middle word is needed.  A null
    text has no words, and like an empty one it is taken 0 times.  A null source is a source
    of its own, null ids come last, and repeated rows count each.  Other columns are ignored.
    """
    slim = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text")
    )
    taken = F.aggregate("__mix.copies", F.lit(0).cast("bigint"), lambda total, x: total + x["take"])
    return placed(slim, whole, "text", "doc_id", "source").select(
        "doc_id", "__mix.size", "source", "__mix.source_size", "__mix.target", taken.alias("taken"), positions().alias("positions")
    )


def by_position(mixed: DataFrame) -> DataFrame:
    """Range-sorted by the position of the first copy; what is not taken follows, by id."""
    return mixed.sort(F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0)), "doc_id")


def mixed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The mix as it is read: ``docs`` with one row for each copy taken whole, range-sorted by position."""
    rows = placed(docs, True, text_col, id_col, source_col).withColumn("__position", F.explode(positions()))
    return rows.sort("__position", F.col(id_col)).select(*docs.columns)


ORACLE = f"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size FROM documents),
totals AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
         row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rank FROM sizes GROUP BY source),
ranked AS (
  SELECT *, 1 + (rank - 1) % 3 AS weight, 3 * source_size AS most, 3 * source_size / (1 + (rank - 1) % 3) AS per_weight FROM totals),
levels AS (
  SELECT a.rank, a.per_weight,
         ((SELECT sum(source_size) FROM ranked) - coalesce(sum(b.most) FILTER (WHERE (b.per_weight, b.rank) < (a.per_weight, a.rank)), 0))
         / sum(b.weight) FILTER (WHERE (b.per_weight, b.rank) >= (a.per_weight, a.rank)) AS level
  FROM ranked a CROSS JOIN ranked b GROUP BY a.rank, a.per_weight),
common AS (SELECT (SELECT level FROM levels WHERE level <= per_weight ORDER BY per_weight, rank LIMIT 1) AS level),
targets AS (
  SELECT source, source_size, round(CASE WHEN level IS NULL OR most <= weight * level THEN most ELSE weight * level END, 6) AS target
  FROM ranked, common),
placed AS (
  SELECT doc_id, size, t.source_size::BIGINT AS source_size, target, round(target)::BIGINT AS words,
         sum(size) OVER (PARTITION BY s.source ORDER BY md5(doc_id::VARCHAR) NULLS LAST, doc_id, size
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS begun
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (greatest(least(size, words - begun), 0) + greatest(least(size, words - begun - source_size), 0)
        + greatest(least(size, words - begun - 2 * source_size), 0))::BIGINT AS taken
FROM placed
"""
