"""Operator 8: near duplicates by SimHash, found through pivot distance tables.

* **Fingerprints.** 64 bits; a bit is set if it is set in over half of the XXH64 values of a
  document's shingles.
* **Classes.** Documents with one fingerprint are one class from the start, so copies are
  never paired; what follows works on distinct fingerprints.
* **Blocks.** Fingerprints that differ in at most ``distance`` bits agree on some choice of
  ``BLOCKS - distance`` of ``BLOCKS`` blocks.  One shuffle brings those that agree together.
* **Pivot tables.** For each fingerprint the Hamming distances to ``PIVOTS`` reference
  fingerprints are computed once.  Within a block the rows are sorted by their distance
  to the first pivot, and a pair is discarded as soon as one coordinate differs by more than
  ``distance``: by the triangle inequality its Hamming distance is larger.  Survivors are
  verified bit by bit.  A link between rows already connected in the block is not sent on.
* **Components** of the links by hooking and contraction, on distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joulecorpus.llm import arrays as A
from joulecorpus.llm.components import components
from joulecorpus.llm.frames import row_keys
from joulecorpus.llm.span_dedup import word_rows
from joulecorpus.session import as_table

BLOCKS = 5
PIVOTS = 16
#: Rows whose pairs are searched at a time; a block is never cut.
SEARCHED = 100_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

LINK = "u bigint, v bigint"


def pivots() -> np.ndarray:
    return np.random.default_rng(64).integers(0, 2**64, PIVOTS, dtype=A.U)


def fingerprints(column: pa.Array, size: int) -> np.ndarray:
    """SimHash of every text over its ``size``-word shingles, repeats included."""
    out = np.zeros(len(column), A.U)
    for first, last, data, starts, ends, edges in word_rows(column):
        if not len(starts):
            continue
        # Words joined by one space; a shingle is a slice of that.
        width = ends - starts + 1
        body = LOWER[data[np.minimum(np.repeat(starts, width) + A.steps(width), len(data) - 1)]]
        after = np.cumsum(width)
        body[after - 1] = 0x20
        before, after = after - width, after - 1
        words = np.diff(edges)
        use = np.flatnonzero(words)
        count = np.maximum(words[use] - size + 1, 1)
        begin = np.repeat(edges[:-1][use], count) + A.steps(count)
        end = begin + np.repeat(np.minimum(words[use], size), count) - 1
        text = body.tobytes()
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(text[a:b], 42) for a, b in zip(before[begin].tolist(), after[end].tolist(), strict=True)), A.U, len(begin)
        )
        owner = np.repeat(np.arange(len(use)), count)
        ones = np.zeros((len(use), 64), np.int64)
        for a in range(0, len(hashes), 1 << 16):
            bits = np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            rows = owner[a : a + (1 << 16)]
            start = np.flatnonzero(A.fresh(rows))
            ones[rows[start]] += np.add.reduceat(bits, start, axis=0, dtype=np.int64)
        high = 2 * ones > count[:, None]
        out[first + use] = np.packbits(high, axis=1, bitorder="little").view(A.U).ravel()
    return out


def block_keys(distance: int) -> list[int]:
    """Masks of the blocks that a pair within ``distance`` shares at least one of."""
    blocks = max(BLOCKS, distance + 1)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(some) for some in combinations(masks, blocks - distance)]


def links(block: np.ndarray, fingerprint: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of one block, enough of them to connect all that are linked."""
    table = np.bitwise_count(fingerprint[:, None] ^ pivots())
    order = np.lexsort((table[:, 0], block))
    block, fingerprint, table = block[order], fingerprint[order], table[order].astype(np.int16)
    label = np.arange(len(block))
    found_u, found_v = [], []
    near = np.arange(len(block) - 1)
    step = 1
    while len(near):
        near = near[near + step < len(block)]
        far = near + step
        # Rows are sorted by block and first coordinate, so a row that fails here is done.
        near = near[(block[near] == block[far]) & (table[far, 0] - table[near, 0] <= distance)]
        far = near + step
        pair = np.flatnonzero(label[near] != label[far])
        for k in range(1, PIVOTS):
            pair = pair[np.abs(table[near[pair], k] - table[far[pair], k]) <= distance]
        pair = pair[np.bitwise_count(fingerprint[near[pair]] ^ fingerprint[far[pair]]) <= distance]
        u, v = near[pair], far[pair]
        found_u.append(fingerprint[u])
        found_v.append(fingerprint[v])
        least = np.minimum(label[u], label[v])
        np.minimum.at(label, u, least)
        np.minimum.at(label, v, least)
        step += 1
    empty = np.empty(0, A.U)
    return np.concatenate([empty, *found_u]), np.concatenate([empty, *found_v])


def simhash_links(distinct: DataFrame, distance: int) -> DataFrame:
    """``u, v``: links that connect all fingerprints (column ``fp``) within ``distance`` bits."""
    masks = block_keys(distance)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(A.U)
            for k, mask in enumerate(masks):
                block = A.mix(fp & A.U(mask)) + A.U(k)  # a rare clash only adds pairs to verify
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.view(np.int64)), pa.array(fp.view(np.int64))], names=["block", "fp"]
                )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> pa.RecordBatch:
            block, fp = (rows[x].to_numpy() for x in ("block", "fp"))
            start = A.fresh(block)
            shared = ~(start & np.r_[start[1:], True])
            u, v = links(block[shared], fp[shared].view(A.U), distance)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) < SEARCHED:
                continue
            rows = pa.Table.from_batches(held)
            block = rows["block"].to_numpy()
            cut = int(np.searchsorted(block, block[-1]))  # the last block may go on
            if cut:
                yield done(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
        if held and sum(x.num_rows for x in held):
            yield done(pa.Table.from_batches(held))

    dealt = distinct.select("fp").mapInArrow(deal, "block bigint, fp bigint")
    return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(search, LINK)


def named_classes(printed: DataFrame, name: Column, distance: int) -> DataFrame:
    """``fp, name``: the smallest ``name`` among all rows of ``printed`` that links lead to from ``fp``."""
    classes = as_table(printed.groupBy("fp").agg(F.min(name).alias("name")), "classes")
    joined = components(simhash_links(classes, distance)).withColumnRenamed("node", "fp")
    grouped = classes.join(joined, "fp", "left").select("fp", "name", F.coalesce("component", "fp").alias("component"))
    names = grouped.groupBy("component").agg(F.min("name").alias("name"))
    return as_table(grouped.drop("name").join(names, "component").select("fp", "name"), "components")


def fingerprinted(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """The other columns of ``docs`` and ``fp``."""
    rest = [f for f in docs.schema.fields if f.name != text_col]

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints(batch.column(text_col), shingle)
            columns = [*(batch.column(f.name) for f in rest), pa.array(fp.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in rest), "fp"])

    return docs.mapInArrow(prints, T.StructType([*rest]).add("fp", T.LongType()))


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2
) -> DataFrame:
    """``doc_id, fp, component_id`` for every row.

    Words are split at ASCII white space after A-Z are lower-cased.  A text of fewer words
    is one shingle; one without words, or null, has fingerprint 0 and is linked like any
    other.  ``component_id`` is the smallest id whose fingerprint can be reached by links
    of at most ``distance`` differing bits.  Rows without an id take part, but give no name;
    repeated rows share a fingerprint.  Other columns are ignored; an empty table is empty.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    printed = as_table(fingerprinted(texts, "text", shingle), "fingerprints")
    names = named_classes(printed, F.col("doc_id"), distance)
    return printed.join(names, "fp", "left").select("doc_id", "fp", F.col("name").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """The row of the smallest id of each component, with all columns; of identical rows one stays.

    A row without an id stays only if its component has no row with one.
    """
    one, two = row_keys(docs)
    keyed = docs.withColumns({"__row_one": one, "__row_two": two})
    slim = keyed.select("__row_one", "__row_two", F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    printed = as_table(fingerprinted(slim, "__text", shingle), "fingerprints")
    # Null ids sort first, so a flag goes before them.
    name = F.struct(F.col("__id").isNull().alias("none"), "__id", "__row_one", "__row_two")
    chosen = named_classes(printed, name, distance).select("name.__row_one", "name.__row_two").distinct()
    keys = ["__row_one", "__row_two"]
    return keyed.join(chosen, keys, "left_semi").dropDuplicates(keys).drop(*keys)
