"""Operator 9: approximate nearest neighbours by balanced posting lists.

* **Lists.** A bounded sample is halved again and again along the axis between two far
  centres, each time at the median, so that all lists get equally many; their means are
  the centroids.  Every vector is indexed under the nearest centroid, and, near a
  boundary, under up to ``REPLICAS`` whose distance is within ``BOUNDARY`` of the nearest.
* **Centroid graph.** Each centroid knows its nearest others and a few far ones.  A vector
  is led through the graph from its entry points, always over the nearest centroid not yet
  visited.
* **Pruning.** A query reads the ``LEAST_LISTS`` nearest lists and all whose distance is within
  ``PROBED`` of the nearest.
* **Scan.** A list is cut into parts of about ``PART_ROWS`` by the hash of the id, so a vector
  that makes up a third of the table is spread over many tasks.  Each part returns its best
  for each query in one row, and these are merged by query.

The measure is the inner product in double precision on the given vectors.  The lists use
the Euclidean distance after adding one coordinate that gives all vectors the same length,
which orders by inner product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joulecorpus.llm.frames import bounded_sample
from joulecorpus.session import as_table

#: Vectors that the lists are fitted on, at most, and lists at most.
SAMPLE = 20_000
MOST_LISTS = 1 << 14
#: Vectors of a list, before replicas, on average.
LIST_ROWS = 200
REPLICAS = 4
BOUNDARY = 1.15
LEAST_LISTS = 16
PROBED = 1.1
#: Rows that one task scans for one list.
PART_ROWS = 512
#: Neighbours in the centroid graph.
DEGREE = 16
#: Rows led through the graph, or queries scanned, at a time.
BLOCK = 256

LISTED = "list int, id bigint, embedding array<double>"
BEST = "query_id bigint, ids array<bigint>, scores array<double>"
NEAREST = "query_id bigint, rank int, vec_id bigint, score double"


def halved(vectors: np.ndarray, levels: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Row numbers of ``2 ** levels`` equally large, compact parts."""

    def split(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        if depth == 0 or len(rows) < 2:
            return [rows]
        own = vectors[rows]
        one = own[rng.integers(len(own))]
        one = own[((own - one) ** 2).sum(1).argmax()]
        two = own[((own - one) ** 2).sum(1).argmax()]
        for _ in range(4):
            order = np.argsort(own @ (two - one), kind="stable")
            half = len(order) // 2
            one, two = own[order[:half]].mean(0), own[order[half:]].mean(0)
        return split(rows[order[:half]], depth - 1) + split(rows[order[half:]], depth - 1)

    return split(np.arange(len(vectors)), levels)


@dataclass
class Graph:
    """Centroids, their neighbours, and the length that all vectors are brought to."""

    centroids: np.ndarray
    neighbours: np.ndarray
    entries: np.ndarray
    length: float

    @staticmethod
    def fit(sample: np.ndarray, rows: int, longest: float, seed: int = 9) -> Graph:
        rng = np.random.default_rng(seed)
        lists = min(MOST_LISTS, max(1, rows // LIST_ROWS), max(1, len(sample) // 4))
        wide = np.concatenate([sample, np.sqrt(np.maximum(longest**2 - (sample**2).sum(1), 0))[:, None]], axis=1)
        parts = halved(wide, int(np.ceil(np.log2(lists))), rng)
        centroids = np.unique(np.stack([wide[p].mean(0) for p in parts]), axis=0)
        n = len(centroids)
        square = (centroids**2).sum(1)
        near = np.empty((n, min(DEGREE, n)), np.int64)
        for a in range(0, n, 1024):  # at most 1024 x MOST_LISTS distances at a time
            block = square[a : a + 1024, None] + square - 2 * centroids[a : a + 1024] @ centroids.T
            near[a : a + 1024] = np.argsort(block, axis=1, kind="stable")[:, : min(DEGREE, n)]
        # Steps of every power of two keep the graph connected.
        hops = [(np.arange(n) + (1 << k)) % n for k in range(max(1, n.bit_length()))]
        entries = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(np.int64))
        return Graph(centroids, np.concatenate([near, np.stack(hops, axis=1)], axis=1), entries, longest)

    def lists(self, vectors: np.ndarray, ratio: float, least: int, most: int, query: bool) -> tuple[np.ndarray, np.ndarray]:
        """Row and list of every list within ``ratio`` of each row's nearest, nearest first, between ``least`` and ``most``."""
        last = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(self.length**2 - (vectors**2).sum(1), 0))
        wide = np.concatenate([vectors, last[:, None]], axis=1)
        rows, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a in range(0, len(wide), BLOCK):
            distance = self._searched(wide[a : a + BLOCK], ratio, least, most)
            order = np.argsort(distance, axis=1, kind="stable")[:, :most]
            near = np.take_along_axis(distance, order, 1)
            use = (near <= ratio * near[:, :1]) | (np.arange(order.shape[1]) < least)
            use &= np.isfinite(near)
            row, k = np.nonzero(use)
            rows.append(a + row)
            found.append(order[row, k])
        return np.concatenate(rows), np.concatenate(found)

    def _searched(self, wide: np.ndarray, ratio: float, least: int, most: int) -> np.ndarray:
        """Distances to the centroids that the search visits; infinite for the others."""
        rows, n = np.arange(len(wide)), len(self.centroids)
        distance = np.full((len(wide), n), np.inf)
        opened = np.zeros((len(wide), n), bool)
        for k in self.entries:
            distance[:, k] = np.sqrt(((wide - self.centroids[k]) ** 2).sum(1))
        width = min(n, max(least, 8))
        while len(rows):
            ahead = np.where(opened[rows], np.inf, distance[rows])
            nearest = ahead.argmin(1)
            at = ahead[np.arange(len(rows)), nearest]
            seen = distance[rows]
            enough = np.partition(seen, width - 1, axis=1)[:, width - 1]
            limit = np.maximum(enough, ratio * seen.min(1)) if most > width else enough
            going = np.isfinite(at) & (at <= limit)
            rows, nearest = rows[going], nearest[going]
            if not len(rows):
                break
            opened[rows, nearest] = True
            around = self.neighbours[nearest]
            new = np.sqrt(((wide[rows, None] - self.centroids[around]) ** 2).sum(2))
            distance[rows[:, None], around] = new
        return distance


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def best(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, points: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the ``k`` largest inner products, ties to the smaller id, its own id left out."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    repeated = bool((ids[1:] == ids[:-1]).any())
    for a in range(0, len(queries), BLOCK):
        # Summed in one fixed order, so that equal vectors get equal scores.
        score = np.einsum("qd,pd->qp", points[a : a + BLOCK], vectors)
        for query, own in zip(queries[a : a + BLOCK].tolist(), score, strict=True):
            use = np.flatnonzero(ids != query)
            if repeated:
                use = use[np.lexsort((-own[use], ids[use]))]
                use = use[np.r_[True, ids[use][1:] != ids[use][:-1]][: len(use)]]
            if len(use) > k:
                least = np.partition(own[use], len(use) - k)[len(use) - k]
                use = use[own[use] >= least]
            use = use[np.lexsort((ids[use], -own[use]))][:k]
            yield query, ids[use], own[use]


def usable(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str) -> DataFrame:
    """``id, embedding, asked``: rows with an id and a vector without nulls, not zero, all finite, of the usual length."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.when(fine, v).alias("embedding"), is_query.alias("asked"))
    rows = rows.where("id is not null and embedding is not null")
    usual = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (usual["n"] if usual else 0))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for every query row, nearest first.

    Vectors that are null, zero, of another length than most, or that hold null or non-finite
    components take no part, nor do rows without an id.  Rows that repeat an id are one
    vector with several places, of which the best counts.  Other columns are ignored.  An
    empty table, or one without queries, gives an empty result.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, is_query, id_col, vector_col)
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    facts = rows.agg(F.count("*").alias("n"), F.max(square).alias("longest")).first()
    if not facts["n"]:
        return spark.createDataFrame([], NEAREST)
    sample = sorted(bounded_sample(rows.select("id", "embedding"), F.xxhash64("id"), SAMPLE).collect())
    graph = Graph.fit(np.array([r["embedding"] for r in sample]), facts["n"], float(np.sqrt(facts["longest"])))
    shared = spark.sparkContext.broadcast(astuple(graph))  # MOST_LISTS centroids at most

    def lister(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            graph = Graph(*shared.value)
            for batch in batches:
                if not batch.num_rows:
                    continue
                points = _matrix(batch.column("embedding"))
                if query:
                    row, found = graph.lists(points, PROBED, LEAST_LISTS, len(graph.centroids), True)
                else:
                    row, found = graph.lists(points, BOUNDARY, 1, REPLICAS, False)
                for a in range(0, len(row), 10_000):
                    some = pa.array(row[a : a + 10_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found[a : a + 10_000], pa.int32()), batch.column("id").take(some), batch.column("embedding").take(some)],
                        names=["list", "id", "embedding"],
                    )

        return run

    postings = as_table(rows.mapInArrow(lister(False), LISTED), "postings")
    # One row for each list, MOST_LISTS at most.
    parts = postings.groupBy("list").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    parts = as_table(parts, "parts")
    cut = postings.join(F.broadcast(parts), "list")
    cut = cut.select("list", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), "id", "embedding")
    probes = rows.where("asked").mapInArrow(lister(True), LISTED).join(F.broadcast(parts), "list")
    probes = probes.select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "embedding")

    def scan(_: tuple, table: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if table.num_rows and queries.num_rows:
            ids, points = (t["id"].to_numpy() for t in (table, queries))
            own, asked = (_matrix(t["embedding"].combine_chunks()) for t in (table, queries))
            found = list(best(ids, own, points, asked, k))
        return pa.table(
            {
                "query_id": pa.array([q for q, _, _ in found], pa.int64()),
                "ids": pa.array([i for _, i, _ in found], pa.list_(pa.int64())),
                "scores": pa.array([s for _, _, s in found], pa.list_(pa.float64())),
            }
        )

    keys = ["list", "part"]
    found = cut.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInArrow(scan, BEST)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held else pa.Table.from_batches([batch])
            if held.num_rows < 5_000:
                continue
            query = held["query_id"].to_numpy()
            cut = int(np.searchsorted(query, query[-1]))  # the last query may go on
            if cut:
                yield merged(held.slice(0, cut), k)
                held = held.slice(cut)
        if held and held.num_rows:
            yield merged(held, k)

    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, NEAREST)


def merged(rows: pa.Table, k: int) -> pa.RecordBatch:
    """The ``k`` best of all parts for each query, each id once."""
    rows = rows.combine_chunks()
    ids, scores = (pa.concat_arrays(rows[c].chunks) for c in ("ids", "scores"))
    query = np.repeat(rows["query_id"].to_numpy(), np.diff(ids.offsets.to_numpy()))
    found, score = ids.flatten().to_numpy(), scores.flatten().to_numpy()
    order = np.lexsort((-score, found, query))
    query, found, score = query[order], found[order], score[order]
    once = np.r_[True, (query[1:] != query[:-1]) | (found[1:] != found[:-1])] if len(query) else np.empty(0, bool)
    query, found, score = query[once], found[once], score[once]
    order = np.lexsort((found, -score, query))
    query, found, score = query[order], found[order], score[order]
    start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.empty(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
    use = rank < k
    return pa.RecordBatch.from_arrays(
        [pa.array(query[use]), pa.array(rank[use] + 1, pa.int32()), pa.array(found[use]), pa.array(score[use])],
        names=["query_id", "rank", "vec_id", "score"],
    )
