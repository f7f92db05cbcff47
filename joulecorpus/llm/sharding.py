"""Operator 5: pack indivisible groups into shards, best fit decreasing.

Groups are the documents of one text.  Sorted by size, each enters the open shard with the
least remaining capacity that still holds it, found in a balanced tree.  That loop is
sequential, so what it sees is bounded by ``shards * GRAIN`` rows, whatever the input:
a group below ``capacity / GRAIN`` joins a bundle by the hash of its text, and there are at most
as many larger groups as units of that size in the whole input.  Groups stay whole unless
one exceeds a shard; such a group is cut by the hash of the document's id.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from joulecorpus.session import as_table

#: Units of a shard that the packing tells apart.
GRAIN = 256
#: Pieces of a shard's size into which a group beyond a shard is cut.
CUTS = 8
#: Rows that one window numbers, on average.
SLICE_ROWS = 2_000

#: Bytes of a document besides its text.
OVERHEAD = 8


class Tree:
    """An AVL tree of (remaining capacity, shard)."""

    def __init__(self) -> None:
        self.root: list | None = None

    @staticmethod
    def _height(node: list | None) -> int:
        return node[3] if node else 0

    def _balanced(self, node: list) -> list:
        for side, other in ((1, 2), (2, 1)):
            if self._height(node[side]) > self._height(node[other]) + 1:
                child = node[side]
                if self._height(child[other]) > self._height(child[side]):
                    node[side] = self._turned(child, other, side)
                return self._turned(node, side, other)
        node[3] = 1 + max(self._height(node[1]), self._height(node[2]))
        return node

    def _turned(self, node: list, side: int, other: int) -> list:
        child = node[side]
        node[side], child[other] = child[other], node
        for x in (node, child):
            x[3] = 1 + max(self._height(x[1]), self._height(x[2]))
        return child

    def add(self, key: tuple[int, int]) -> None:
        def put(node: list | None) -> list:
            if node is None:
                return [key, None, None, 1]
            side = 1 if key < node[0] else 2
            node[side] = put(node[side])
            return self._balanced(node)

        self.root = put(self.root)

    def drop(self, key: tuple[int, int]) -> None:
        def cut(node: list, key: tuple[int, int]) -> list | None:
            if key == node[0]:
                if not node[1] or not node[2]:
                    return node[1] or node[2]
                least = node[2]
                while least[1]:
                    least = least[1]
                node[0] = least[0]
                node[2] = cut(node[2], least[0])
            else:
                side = 1 if key < node[0] else 2
                node[side] = cut(node[side], key)
            return self._balanced(node)

        self.root = cut(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The smallest key with at least ``size`` remaining."""
        node, best = self.root, None
        while node:
            if node[0][0] >= size:
                node, best = node[1], node[0]
            else:
                node = node[2]
        return best

    def emptiest(self) -> tuple[int, int]:
        node = self.root
        while node[2]:
            node = node[2]
        return node[0]


def best_fit_decreasing(sizes: Iterable[tuple[int, str]], capacity: int, shards: int | None = None) -> dict[str, int]:
    """Shard of every (size, name).

    A new shard is opened only if no open one fits.  With ``shards`` all of them are open, and
    what fits nowhere enters the one with the most room.  Ties go to the smaller name and the
    lower shard number.
    """
    tree, out, opened = Tree(), {}, 0
    for opened in range(1, (shards or 0) + 1):  # noqa: B007
        tree.add((capacity, opened - 1))
    for size, name in sorted(sizes, key=lambda x: (-x[0], x[1])):
        found = tree.tightest(size)
        if found is not None:
            tree.drop(found)
        elif shards is None:
            found, opened = (max(capacity, size), opened), opened + 1
        else:
            found = tree.emptiest()
            tree.drop(found)
        out[name] = found[1]
        tree.add((found[0] - size, found[1]))
    return out


def even_capacity(sizes: Iterable[int], shards: int) -> int:
    """The capacity at which all shards are full, beside those that one item fills alone."""
    rest, ordered = sum(sizes := list(sizes)), sorted(sizes, reverse=True)
    for alone in range(shards):
        capacity = max(1, -(-rest // (shards - alone)))
        if alone >= len(ordered) or ordered[alone] <= capacity:
            return capacity
        rest -= ordered[alone]
    return max(1, rest)


def pack_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    The law is ``bytes``: shard sizes are near equal.  A null text has no bytes and
    shares the group of empty texts.  Slots count from 0 without gaps in each shard.  Rows
    without an id and repeated rows are packed like others; other columns are ignored.  An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("group"),
    )
    rows = as_table(read, "sizes")
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    capacity = max(1, -(-total // shards))
    unit = max(1, capacity // GRAIN)
    groups = rows.groupBy("group").agg(F.sum("size").alias("total"))
    pieces = F.when(F.col("total") > capacity, F.ceil(F.col("total") * CUTS / capacity)).otherwise(1).cast("bigint")
    # At most total / unit rows, which is shards * GRAIN and a few: broadcast whatever the input.
    large = as_table(groups.where(F.col("total") >= unit).select("group", pieces.alias("pieces")), "large")
    piece = F.pmod(F.xxhash64("doc_id"), F.col("pieces"))
    bundle = F.pmod(F.xxhash64("group"), F.lit(shards * GRAIN))
    item = F.when(F.col("pieces").isNull(), F.concat(F.lit("b"), bundle)).otherwise(
        F.concat(F.lit("g"), F.hex("group"), F.lit("-"), piece)
    )
    named = rows.join(F.broadcast(large), "group", "left").withColumn("item", item).drop("pieces")
    # Sums of bundles and large groups: bounded like ``large``.
    sums = [(r["total"], r["item"]) for r in named.groupBy("item").agg(F.sum("size").alias("total")).collect()]
    placed = best_fit_decreasing(sums, even_capacity([size for size, _ in sums], shards), shards)
    shard = spark.createDataFrame(list(placed.items()), "item string, shard int")
    sharded = named.join(F.broadcast(shard), "item")
    slices = max(1, count // (shards * SLICE_ROWS))
    sharded = sharded.withColumn("slice", F.pmod(F.xxhash64("doc_id", "group"), F.lit(slices)))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    begins = sharded.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    begins = begins.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("shard", "slice").orderBy("doc_id", "group")
    numbered = sharded.withColumn("number", F.row_number().over(inside) - 1).join(begins, ["shard", "slice"])
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("begin") + F.col("number")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
