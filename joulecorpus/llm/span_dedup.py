"""Operator 4: remove long word sequences seen earlier, by de Bruijn compaction.

* **Edges.** Every window of ``window`` consecutive words is an edge of the de Bruijn graph
  of the corpus; its place ``(doc_id, start)`` is a source coordinate.
* **Compaction inside documents.** The key of an edge is the smallest hash among the
  ``GRAM``-word sequences it holds, so equal edges have equal keys.  Consecutive edges
  with one key are one path; a document is a chain of paths, about one for nine words.
* **Compaction across documents.** Paths are dealt out by key.  Equal paths are one
  nonbranching path of the graph: its earliest coordinate stays, all other occurrences
  are repeats as a whole.  Repeats within a batch are settled before the shuffle.
* **Branches.** Only a key with several different paths can hide further repeats.  Their
  first occurrences are joined with the texts, taken apart into single edges, and these
  joined by edge; later coordinates are repeats.
* **Spans.** Every repeat is held against its source coordinate, the earliest one of its
  path or edge, and is removed only if it lies later.  Repeats are joined with their
  documents; overlapping and adjacent ones make the removed spans.

Paths and edges are equal if two independent 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from joulecorpus.llm import arrays as A
from joulecorpus.llm.frames import identified
from joulecorpus.session import as_table

#: Words of the key; an edge must hold at least one such sequence.
GRAM = 5

PATH = "key bigint, path bigint, doc_id bigint, version bigint, at bigint, n int, known boolean"
EDGE = "edge bigint, proof bigint, doc_id bigint, version bigint, at bigint, known boolean"
KEPT = "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept string"


def word_rows(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``first, last, data, starts, ends, edges``: rows of bounded size, their words, and each row's range of words."""
    data, offsets = A.text_buffers(column)
    for first, last in A.row_ranges(offsets):
        part = data[offsets[first] : offsets[last]]
        starts, ends, row = A.words(part, offsets[first : last + 1] - offsets[first])
        edges = np.searchsorted(row, np.arange(last - first + 1))
        yield first, last, part, starts, ends, edges


def settle(hashes: tuple[np.ndarray, ...], doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows that are not at the earliest coordinate of their hash."""
    order = np.lexsort((at, doc, *reversed(hashes)))
    start = A.fresh(*(h[order] for h in hashes))
    group = np.cumsum(start) - 1
    later = (doc[order] != doc[order][start][group]) | (at[order] != at[order][start][group])
    out = np.empty(len(doc), bool)
    out[order] = later
    return out


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in schema.split(", ")])


def paths(column: pa.Array, doc: np.ndarray, version: np.ndarray, window: int, gram: int) -> Iterator[list[np.ndarray]]:
    """key, path, doc, version, at, n of each path; rows with a negative ``version`` are left out."""
    letters, first_hash, second_hash = A.Hasher(0), A.Hasher(2), A.Hasher(3)
    for first, last, data, starts, ends, edges in word_rows(column):
        count = np.maximum(np.diff(edges) - window + 1, 0)
        count[version[first:last] < 0] = 0
        use = np.flatnonzero(count)
        if not len(use):
            continue
        word = A.word_hashes(data, starts, ends, letters)
        keys = first_hash.fixed(first_hash.sums(word), gram)
        sums = second_hash.sums(word)
        begin = np.repeat(edges[use], count[use]) + A.steps(count[use])
        # The key of an edge: looked for in slices, whose length the search bounds.
        least = np.empty(len(begin), np.int64)
        for a in range(0, len(begin), A.PIECE):
            low = begin[a]
            top = begin[min(a + A.PIECE, len(begin)) - 1]
            near = A.sliding_argmin(keys[low : top + window - gram + 1], window - gram + 1)
            least[a : a + A.PIECE] = low + near[begin[a : a + A.PIECE] - low]
        start = np.flatnonzero(A.fresh(least))
        n = np.diff(np.r_[start, len(begin)])
        a = begin[start]
        row = np.searchsorted(edges, a, "right") - 1
        yield [
            keys[least[start]].view(np.int64),
            second_hash.spans(sums, a, a + n - 1 + window).view(np.int64),
            doc[first + row],
            version[first + row],
            a - edges[row],
            n.astype(np.int32),
        ]


def span_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """Remove every word covered by a ``window``-word sequence that also starts earlier.

    Earlier means a smaller id, or the same id and an earlier start; sequences are judged
    on the input.  One row per input row: ``doc_id, n_words, n_removed, spans`` (removed
    runs of words, end exclusive) and ``kept`` (the remaining words joined by a space).
    A null text has no words.  A row without an id keeps its words and covers nothing.
    Rows that repeat an id are compared by start alone, so identical rows stay alike.
    Other columns are ignored.  An empty table gives an empty result.
    """
    gram = min(GRAM, max(1, window // 2))
    texts = identified(docs, id_col, text_col)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, version = numbers(batch)
            if not (parts := list(paths(batch.column("text"), doc, version, window, gram))):
                continue
            key, path, doc, version, at, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            known = settle((key, path), doc, at)
            # What is settled leaves its key, so that a hot key stays small.
            key = np.where(known, A.mix(doc.view(A.U) * A.U(31) + at.view(A.U)).view(np.int64), key)
            yield _batch(PATH, [key, path, doc, version, at, n, known])

    placed = F.struct("doc_id", "at")
    by_path = Window.partitionBy("key", "path")
    found = (
        texts.mapInArrow(parse, PATH)
        .repartition("key")
        .withColumn("source", F.first(placed).over(by_path.orderBy("doc_id", "at")))
        .withColumn("least", F.min("path").over(Window.partitionBy("key")))
        .withColumn("most", F.max("path").over(Window.partitionBy("key")))
        .withColumn("repeat", F.col("known") | (placed > F.col("source")))
        .where("repeat or (least < most)")
        .select("doc_id", "version", "at", "n", "repeat")
    )
    found = as_table(found, "paths")
    key = ["doc_id", "version"]
    branching = found.where("not repeat").groupBy(*key).agg(F.collect_list(F.struct("at", "n")).alias("wanted"))

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, one, two = A.Hasher(0), A.Hasher(4), A.Hasher(5)
        for batch in batches:
            doc, version = numbers(batch)
            owner, flat = A.row_lists(batch.column("wanted"))
            at, n = flat.field("at").to_numpy(), flat.field("n").to_numpy()
            parts = []
            for first, last, data, starts, ends, edges in word_rows(batch.column("text")):
                a, b = np.searchsorted(owner, [first, last])
                if a == b:
                    continue
                word = A.word_hashes(data, starts, ends, letters)
                edge, proof = (h.fixed(h.sums(word), window) for h in (one, two))
                rows = np.repeat(owner[a:b], n[a:b])
                place = np.repeat(at[a:b], n[a:b]) + A.steps(n[a:b])
                begin = edges[rows - first] + place
                parts.append((edge[begin].view(np.int64), proof[begin].view(np.int64), doc[rows], version[rows], place))
            if parts:
                edge, proof, doc, version, place = (np.concatenate(x) for x in zip(*parts, strict=True))
                known = settle((edge, proof), doc, place)
                edge = np.where(known, A.mix(doc.view(A.U) * A.U(31) + place.view(A.U)).view(np.int64), edge)
                yield _batch(EDGE, [edge, proof, doc, version, place, known])

    wanted = texts.join(branching, key, "left").select(*key, "text", F.col("wanted"))
    by_edge = Window.partitionBy("edge", "proof").orderBy("doc_id", "at")
    edges = (
        wanted.mapInArrow(take_apart, EDGE)
        .withColumn("source", F.first(placed).over(by_edge))
        .where(F.col("known") | (placed > F.col("source")))
        .select(*key, "at", F.lit(1).alias("n"))
    )
    repeats = found.where("repeat").select(*key, "at", "n").unionByName(edges)
    marks = repeats.groupBy(*key).agg(F.collect_list(F.struct("at", "n")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, flat = A.row_lists(batch.column("wanted"))
            at, n = (flat.field(x).to_numpy() for x in ("at", "n"))
            for first, last, data, starts, ends, edges in word_rows(batch.column("text")):
                a, b = np.searchsorted(owner, [first, last])
                begin = edges[owner[a:b] - first] + at[a:b]
                depth = np.zeros(len(starts) + 1, np.int32)
                np.add.at(depth, begin, 1)
                np.add.at(depth, begin + n[a:b] + window - 1, -1)
                gone = np.cumsum(depth[:-1]) > 0
                yield kept_words(batch.column("doc_id").slice(first, last - first), data, starts, ends, edges, gone)

    return texts.join(marks, key, "left").select(*key, "text", F.col("wanted")).mapInArrow(cut, KEPT)


def numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and versions that are negative where there is no id."""
    ids = batch.column("doc_id")
    doc = ids.fill_null(0).to_numpy(zero_copy_only=False)
    return doc, np.where(np.asarray(ids.is_null()), -1, batch.column("version").to_numpy(zero_copy_only=False))


def kept_words(
    ids: pa.Array, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, edges: np.ndarray, gone: np.ndarray
) -> pa.RecordBatch:
    """Per row: sizes, removed runs of words, and the remaining words joined by one space."""
    row = np.repeat(np.arange(len(ids)), np.diff(edges))
    turn = np.zeros(len(gone) + 1, bool)
    turn[edges] = True
    before, after = np.r_[False, gone], np.r_[gone, False]
    start, end = np.flatnonzero(after & (~before | turn)), np.flatnonzero(before & (~after | turn))
    runs = np.searchsorted(start, edges).astype(np.int32)
    base = np.repeat(edges[:-1], np.diff(runs))
    pair = pa.StructArray.from_arrays([pa.array(start - base), pa.array(end - base)], names=["start", "end"])
    keep = np.flatnonzero(~gone)
    last = np.r_[row[keep][1:] != row[keep][:-1], True] if len(keep) else np.empty(0, bool)
    size = ends[keep] - starts[keep] + ~last
    body = data[np.minimum(np.repeat(starts[keep], size) + A.steps(size), max(len(data) - 1, 0))]
    body[np.cumsum(size)[~last] - 1] = 0x20
    bytes_ = np.bincount(row[keep], size, len(ids)).astype(np.int64)
    places = np.r_[0, np.cumsum(bytes_)].astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array(np.diff(edges)),
            pa.array(np.bincount(row, gone, len(ids)).astype(np.int64)),
            pa.ListArray.from_arrays(pa.array(runs), pair),
            pa.Array.from_buffers(pa.string(), len(ids), [None, pa.py_buffer(places), pa.py_buffer(body)]),
        ],
        names=["doc_id", "n_words", "n_removed", "spans", "kept"],
    )
