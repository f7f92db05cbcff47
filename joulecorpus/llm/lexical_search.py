"""Operator 13: ranked lexical search by bag deduplication.

* **Bags.** A document is restricted to the terms of the items; what is left is its bag, the
  (term, occurrences) pairs in ascending order of terms, and the number of all its terms.
* **Statistics.** Documents, terms and the documents of each item term are counted over all bags.
* **Classes.** A score depends on the bag and on the document's length class ``m`` alone.  Documents
  are grouped by a hash of the bag, by ``m``, and by the bag itself, which verifies the hash; copies
  are merged before the shuffle.  Each class is scored once, against all items.
* **Best classes.** A task keeps the best ``k`` classes of each item, in the order of score and
  smallest id; a class behind ``k`` others has no document among the best ``k``.
* **Expansion.** Only documents of these classes are looked at again: the ``k`` smallest ids of each
  class, then the best ``k`` documents of each item.

Items are taken in blocks of a bounded number of terms; every block is searched in all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joulecorpus.llm import arrays as A
from joulecorpus.session import as_table, join_small

#: Bytes of a term: ASCII digits and letters, and all that is not ASCII.
TERM = np.zeros(256, bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    TERM[_low : _high + 1] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41 : 0x5A + 1] += 32
#: The same as a pattern, for the items.
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Occurrences of terms, repeats included, in the items of one block.
BLOCK = 1 << 20
#: Cells of the score table (classes x items) that a task fills at a time.
CELLS = 1 << 20

BAG = "doc_id bigint, n bigint, bag binary"
HIT = "item bigint, score bigint, hash bigint, m bigint, bag binary, least bigint"


def terms(column: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
    """``first, last, terms, row``: the terms of rows of bounded size, A-Z lower-cased, and the row of each."""
    data, offsets = A.text_buffers(column)
    for first, last in A.row_ranges(offsets):
        part = data[offsets[first] : offsets[last]]
        inside = TERM[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[offsets[first : last + 1] - offsets[first]] = True
        before = np.r_[False, inside[:-1]] if len(part) else inside
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        body = LOWER[part[inside]]
        places = np.r_[np.cumsum(np.r_[0, inside])[starts], len(body)].astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(body)])
        row = np.searchsorted(offsets[first : last + 1] - offsets[first], starts, "right") - 1
        yield first, last, found, row


def bags(column: pa.Array, vocabulary: pa.Array) -> Iterator[tuple[int, int, np.ndarray, pa.Array]]:
    """``first, last, n, bag``: all terms of each row counted, and those of the vocabulary as (term, count) pairs."""
    for first, last, found, row in terms(column):
        rows, width = last - first, max(len(vocabulary), 1)
        known = pc.index_in(found, value_set=vocabulary)
        at = np.flatnonzero(np.asarray(known.is_valid()))
        key = row[at] * width + known.fill_null(0).to_numpy()[at]
        key, count = np.unique(key, return_counts=True)
        pairs = np.stack([key % width, count], axis=1).astype("<i4")
        edges = np.searchsorted(key, np.arange(rows + 1) * width).astype(np.int32) * np.int32(8)
        bag = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(pairs))])
        yield first, last, np.bincount(row, minlength=rows), bag


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, term, times`` for every item and term of it."""
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).alias("term"))
    return found.groupBy("id", "term").agg(F.count("*").alias("times"))


def impacts(weight: np.ndarray, term: np.ndarray, count: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one occurrence of a term in an item adds to the score."""
    return weight[term] * ((1_000_000_000 * count) // (1000 * count + 12 * m))


def score_classes(pairs: np.ndarray, edges: np.ndarray, m: np.ndarray, weight: np.ndarray, postings: tuple) -> np.ndarray:
    """Scores of classes (rows) for items (columns): each pair meets the items of its term."""
    first, item, times, items = postings
    owner = np.repeat(np.arange(len(m)), np.diff(edges))
    gain = impacts(weight, pairs[:, 0], pairs[:, 1], m[owner])
    size = (first[1:] - first[:-1])[pairs[:, 0]]
    at = np.repeat(first[pairs[:, 0]], size) + A.steps(size)
    cell = np.repeat(owner * items, size) + item[at]
    score = np.zeros(len(m) * items, np.int64)
    np.add.at(score, cell, np.repeat(gain, size) * times[at])
    return score.reshape(len(m), items)


def best_rows(item: np.ndarray, score: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """Rows among the first ``k`` of their item, by falling score and rising ``least``."""
    order = np.lexsort((least, -score, item))
    start = np.flatnonzero(A.fresh(item[order])) if len(order) else np.empty(0, np.int64)
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    return order[place < k]


def search_block(texts: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """``id, rank, doc_id, score`` for the items of ``own(id, term, times)``, whose size is bounded."""
    spark = texts.sparkSession
    table = own.toArrow()
    ids = pc.unique(table["id"].combine_chunks())
    ids = ids.take(pc.sort_indices(ids))
    words = pc.unique(table["term"].combine_chunks())
    words = words.take(pc.sort_indices(words)).cast(pa.binary())
    size = len(words)
    known = spark.sparkContext.broadcast(words.to_pylist())

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(known.value, pa.binary())
        for batch in batches:
            for first, last, n, bag in bags(batch.column("text"), vocabulary):
                columns = [batch.column("doc_id").slice(first, last - first), pa.array(n), bag]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in BAG.split(", ")]).filter(pa.array(n > 0))

    found = as_table(texts.mapInArrow(restrict, BAG), "bags")
    total = found.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    docs, length = total.docs, total.terms

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            data, _ = A.text_buffers(batch.column("bag"))
            df += np.bincount(data.view("<i4")[::2], minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], names=["term", "df"])

    df = np.zeros(size, np.int64)
    counted = found.select("bag").mapInArrow(holders, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df[counted["term"].to_numpy()] = counted["df"].to_numpy()
    weight = np.floor(1000 * np.log((2 * docs + 2) / (2 * df + 1))).astype(np.int64)
    # Postings: for each term the items that hold it, and how often.
    term = pc.index_in(table["term"].combine_chunks().cast(pa.binary()), value_set=words).to_numpy()
    order = np.argsort(term, kind="stable")
    item = pc.index_in(table["id"].combine_chunks(), value_set=ids).to_numpy().astype(np.int64)[order]
    first = np.searchsorted(term[order], np.arange(size + 1))
    shared = spark.sparkContext.broadcast((weight, (first, item, table["times"].to_numpy()[order], len(ids))))

    m = F.expr(f"75 + (25 * n * {docs}L) div {max(length, 1)}L")
    classes = (
        found.where((F.col("doc_id").isNotNull()) & (F.length("bag") > 0))
        .select(F.xxhash64("bag").alias("hash"), m.alias("m"), "bag", "doc_id")
        .groupBy("hash", "m", "bag")
        .agg(F.min("doc_id").alias("least"))
    )

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, postings = shared.value
        items = postings[3]
        held: pa.Table | None = None
        for batch in batches:
            step = max(1, CELLS // items)
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                data, edges = A.text_buffers(part.column("bag"))
                pairs = data.view("<i4").reshape(-1, 2).astype(np.int64)
                least = part.column("least").to_numpy()
                score = score_classes(pairs, edges // 8, part.column("m").to_numpy(), weight, postings)
                row, column = np.nonzero(score)
                value = score[row, column]
                top = best_rows(column, value, least[row], k)
                row, column, value = row[top], column[top], value[top]
                rest = [part.column(c).take(pa.array(row)) for c in ("hash", "m", "bag", "least")]
                new = pa.Table.from_arrays([pa.array(column), pa.array(value), *rest], names=[c.split()[0] for c in HIT.split(", ")])
                held = new if held is None else pa.concat_tables([held, new])
                if held.num_rows > 4 * k * items:
                    held = held.take(pa.array(best_rows(*(held[c].to_numpy() for c in ("item", "score", "least")), k)))
        if held is not None:
            held = held.take(pa.array(best_rows(*(held[c].to_numpy() for c in ("item", "score", "least")), k)))
            yield from held.combine_chunks().to_batches(max_chunksize=10_000)

    by_item = Window.partitionBy("item").orderBy(F.desc("score"), "least")
    hits = classes.mapInArrow(rank, HIT).withColumn("place", F.row_number().over(by_item)).where(F.col("place") <= k).drop("place", "least")
    hits = as_table(hits, "hits")
    # The members of the classes found: joined by the bag itself, the smallest ids of each class.
    keyed = found.where(F.col("doc_id").isNotNull()).select(F.xxhash64("bag").alias("hash"), m.alias("m"), "bag", "doc_id")
    members = join_small(keyed, hits.select("hash", "m").distinct(), ["hash", "m"], "left_semi")
    by_class = Window.partitionBy("hash", "m", "bag").orderBy("doc_id")
    members = members.withColumn("place", F.row_number().over(by_class)).where(F.col("place") <= k).drop("place")
    by_rank = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = members.join(hits, ["hash", "m", "bag"]).withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)
    names = spark.createDataFrame(pa.table({"item": pa.array(range(len(ids)), pa.int64()), "id": ids}))
    return join_small(ranked, names, ["item"]).select("id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def lexical_search(
    docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """``<item_col>, rank, doc_id, score``: the ``k`` documents with the highest score above 0 for each item.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII; A-Z are lower-cased.
    Equal scores come by ascending id.  A null text has no terms.  A document without an id counts
    in the statistics, but is not ranked; rows that repeat an id are documents of their own.  Items
    without an id are left out, rows that repeat an item's id are one item, and one without
    terms has no rows.  Other columns are ignored; an empty table on either side gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = as_table(item_terms(items, item_col, query_col), "items")
    parts = [search_block(texts, part, k) for part in item_blocks(own, block)]
    if not parts:
        schema = f"id {dict(items.dtypes)[item_col]}, rank int, doc_id bigint, score bigint"
        parts = [docs.sparkSession.createDataFrame([], schema)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("id", item_col)


def item_blocks(own: DataFrame, block: int) -> list[DataFrame]:
    """``own`` by items in blocks of about ``block`` rows, found by a hash of the item."""
    rows = own.count()
    number = -(-rows // block)
    if number <= 1:
        return [own] if rows else []
    part: Column = F.pmod(F.xxhash64("id"), F.lit(number))
    return [own.where(part == F.lit(i)) for i in range(number) if not own.where(part == F.lit(i)).isEmpty()]


ORACLE = """
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM documents
), lengths AS (SELECT doc_id, count(*)::BIGINT AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY doc_id, term),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
query AS (
    SELECT item_id, term, count(*)::BIGINT AS times
    FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark)
    GROUP BY item_id, term
), scored AS (
    SELECT item_id, doc_id,
           sum(times * floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1)))::BIGINT
               * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms))))::BIGINT AS score
    FROM query JOIN tf USING (term) JOIN df USING (term) JOIN lengths USING (doc_id), total
    GROUP BY item_id, doc_id
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
    FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
