"""Operator 7: quality rules and a hashed n-gram likelihood ratio.

Two multinomials over hashed byte n-grams are estimated: the raw one from every document,
the target one from the documents that a bounded sample of labelled rows trusts.  A
document's score is the mean log ratio of target to raw over its n-grams, so length cancels.
The threshold is the one that tells the sample's held-out rows apart best, where a lost good
row weighs ``GOOD_WEIGHT`` rejected bad ones.  Every document is then decided by the same two
tables and the same threshold; nothing is drawn at random.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joulecorpus.llm import arrays as A
from joulecorpus.llm.frames import bounded_sample
from joulecorpus.llm.span_dedup import word_rows

#: Bytes of the n-grams; each length has a table of its own.
LENGTHS = (3, 5)
BUCKETS = 1 << 16
#: Labelled rows that are used at most, by hash of their id; one in HELD_OUT sets the threshold.
LABELLED = 20_000
HELD_OUT = 4
GOOD_WEIGHT = 4.0
#: Added to every count.
PRIOR = 1.0
SCALE = 1 << 20
#: Buckets of one row of counts.
CHUNK = 256

# Rules: words below which a text fails, per cent of repeated words above which it fails.
FEWEST_WORDS = 20
MOST_REPEATED = 30
REPEATED_WINDOW = 8
# Symbols that are counted.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass
class Model:
    """Log ratios by length and bucket in units of 1 / SCALE, and the score that a document must reach.

    Whole units add up to the same sum in any order.
    """

    ratios: np.ndarray
    threshold: float = -np.inf


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length number, bucket of every n-gram within a row, and each row's range of them."""
    hasher = A.Hasher(6)
    sums = hasher.sums(data)
    for k, length in enumerate(LENGTHS):
        bucket = (hasher.fixed(sums, length) >> A.U(48)).astype(np.int64)
        edge = np.zeros(len(data) + length, np.int32)
        for shift in range(1, length):  # a gram may not reach over the end of its row
            edge[np.maximum(offsets[1:] - shift, 0)] = 1
        inside = edge[: len(bucket)] == 0
        yield k, bucket[inside], np.r_[0, np.cumsum(inside)][np.minimum(offsets, len(bucket))]


def scores(column: pa.Array, model: Model) -> np.ndarray:
    """Mean log ratio of every text; 0 without n-grams."""
    total, count = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    data, offsets = A.text_buffers(column)
    for first, last in A.row_ranges(offsets):
        part = data[offsets[first] : offsets[last]]
        for k, bucket, edges in gram_buckets(part, offsets[first : last + 1] - offsets[first]):
            sums = np.r_[0, np.cumsum(model.ratios[k][bucket])]
            total[first:last] += np.diff(sums[edges])
            count[first:last] += np.diff(edges)
    return total / (np.maximum(count, 1) * SCALE)


def rules(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of the base rules for every text."""
    out = {name: np.zeros(len(column), np.int64) for name in RULES}
    letters, grams = A.Hasher(0), A.Hasher(2)
    _, offsets = A.text_buffers(column)
    for first, last, data, starts, ends, edges in word_rows(column):
        rows = slice(first, last)
        at = offsets[first : last + 1] - offsets[first]
        inside = ~A.SPACE[data]
        per_row = lambda flag, at=at: np.diff(np.r_[0, np.cumsum(flag)][at])
        out["n_words"][rows] = np.diff(edges)
        out["word_chars"][rows] = per_row(inside & ((data & 0xC0) != 0x80))
        out["n_symbols"][rows] = per_row(SYMBOLS[data])
        out["n_dup_lines"][rows] = _repeated_lines(data, at, inside, letters)
        out["n_repeat_words"][rows] = _repeated_words(A.word_hashes(data, starts, ends, letters), edges, grams)
    return out


def _repeated_lines(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, hasher: A.Hasher) -> np.ndarray:
    """Lines with a word that equal an earlier line of their row."""
    rows = len(offsets) - 1
    breaks = np.flatnonzero(data == 0x0A)
    start = np.r_[offsets[:-1], breaks + 1]
    end = np.r_[offsets[1:], breaks]
    row = np.r_[np.arange(rows), np.searchsorted(offsets, breaks, "right") - 1]
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    end = np.where(np.r_[row[1:] == row[:-1], False], np.r_[start[1:] - 1, 0], offsets[row + 1]) if len(row) else end
    filled = np.r_[0, np.cumsum(inside)]
    some = filled[end] > filled[start]
    start, end, row = start[some], end[some], row[some]
    hashes = hasher.spans(hasher.sums(data), start, end)
    order = np.lexsort((hashes, row))
    again = ~A.fresh(row[order], hashes[order])
    return np.bincount(row[order][again], minlength=rows)


def _repeated_words(word: np.ndarray, edges: np.ndarray, hasher: A.Hasher) -> np.ndarray:
    """Words of each row that lie in a window which the row holds at least twice."""
    rows = len(edges) - 1
    count = np.maximum(np.diff(edges) - REPEATED_WINDOW + 1, 0)
    if not count.any():
        return np.zeros(rows, np.int64)
    begin = np.repeat(edges[:-1], count) + A.steps(count)
    row = np.repeat(np.arange(rows), count)
    hashes = hasher.fixed(hasher.sums(word), REPEATED_WINDOW)[begin]
    order = np.lexsort((hashes, row))
    start = A.fresh(row[order], hashes[order])
    again = ~start
    again[:-1] |= ~start[1:]  # the first one counts too
    at = begin[order[again]]
    depth = np.zeros(len(word) + 1, np.int32)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + REPEATED_WINDOW, -1)
    return np.diff(np.r_[0, np.cumsum(np.cumsum(depth[:-1]) > 0)][edges])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Ratio tables from all documents and the labelled sample, and the threshold.

    ``labels`` has ``doc_id`` and ``quality`` (1 is good); null values are left out.  Without
    labelled documents of both kinds the threshold lets everything pass.
    """
    spark = docs.sparkSession
    chosen = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    sample = bounded_sample(chosen.agg(F.min("quality").alias("quality")), F.xxhash64("doc_id"), LABELLED)
    known = sorted((r.doc_id, int(r.quality), r.sample_key % HELD_OUT == 0) for r in sample.collect())
    ids = np.array([k[0] for k in known], np.int64)
    trusted = np.array([k[1] == 1 and not k[2] for k in known], bool)
    shared = spark.sparkContext.broadcast((ids, trusted))  # LABELLED rows at most
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, trusted = shared.value
        counts = np.zeros((2, len(LENGTHS), BUCKETS), np.int64)
        for batch in batches:
            doc = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(ids, doc), max(len(ids) - 1, 0))
            target = (ids[at] == doc) & trusted[at] if len(ids) else np.zeros(len(doc), bool)
            target &= ~np.asarray(batch.column("doc_id").is_null())
            data, offsets = A.text_buffers(batch.column("text"))
            for first, last in A.row_ranges(offsets):
                part = data[offsets[first] : offsets[last]]
                for k, bucket, edges in gram_buckets(part, offsets[first : last + 1] - offsets[first]):
                    counts[0, k] += np.bincount(bucket, minlength=BUCKETS)
                    own = np.repeat(target[first:last], np.diff(edges))
                    counts[1, k] += np.bincount(bucket[own], minlength=BUCKETS)
        parts = counts.reshape(-1, CHUNK)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
            names=["chunk", "counts"],
        )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table["counts"].to_pylist())
        return pa.table({"chunk": table["chunk"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "chunk int, counts binary"
    summed = texts.mapInArrow(count, schema).groupBy("chunk").applyInArrow(add, schema).collect()  # 2 * LENGTHS * BUCKETS numbers
    counts = np.zeros((2 * len(LENGTHS) * BUCKETS // CHUNK, CHUNK), np.int64)
    for row in summed:
        counts[row.chunk] = np.frombuffer(row.counts, np.int64)
    logs = np.log(counts.reshape(2, len(LENGTHS), BUCKETS) + PRIOR)
    logs -= np.log(np.exp(logs).sum(axis=2, keepdims=True))
    model = Model(np.rint((logs[1] - logs[0]) * SCALE).astype(np.int64))
    held = {k[0]: k[1] for k in known if k[2]}
    if not trusted.any() or not held:
        return model
    judge = spark.sparkContext.broadcast((model.ratios, model.threshold))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["doc_id", "score"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(batch.column("text"), Model(*judge.value)))], names=names)

    few = spark.createDataFrame([(k,) for k in held], "doc_id bigint")  # LABELLED / HELD_OUT rows
    rows = texts.join(F.broadcast(few), "doc_id", "left_semi").mapInArrow(score, "doc_id bigint, score double").collect()
    model.threshold = best_threshold(np.array([r.score for r in rows]), np.array([held[r.doc_id] == 1 for r in rows], bool))
    return model


def best_threshold(score: np.ndarray, good: np.ndarray) -> float:
    """The score from which on to keep; the lowest of equally good ones, in the middle of its gap."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(score, kind="stable")
    score, good = score[order], good[order]
    lost = np.r_[0, np.cumsum(good)] / good.sum()
    caught = np.r_[0, np.cumsum(~good)] / (~good).sum()
    value = caught - GOOD_WEIGHT * lost
    value[1:-1][score[1:] == score[:-1]] = -np.inf  # a threshold can't part equal scores
    k = int(np.argmax(value))
    if k == 0:
        return -np.inf
    return float(score[k - 1] / 2 + score[k] / 2) if k < len(score) else float(np.nextafter(score[-1], np.inf))


def assess(docs: DataFrame, model: Model, text_col: str = "text", only_kept: bool = False) -> DataFrame:
    """``docs`` with the counts of the rules, ``base_failed``, ``score`` and ``kept``.

    A column of one of these names is replaced.  A null text is empty, has 0 in every count and
    fails.  Repeated rows are decided alike.  With ``only_kept`` the rows that are kept come
    back as they were.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.ratios, model.threshold))
    kinds = [(n, T.LongType()) for n in RULES] + [("base_failed", T.BooleanType()), ("score", T.DoubleType()), ("kept", T.BooleanType())]
    added = {n for n, _ in kinds}
    fields = docs.schema.fields if only_kept else [f for f in docs.schema.fields if f.name not in added]
    schema = T.StructType(list(fields) + ([] if only_kept else [T.StructField(n, t) for n, t in kinds]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            column = batch.column(text_col)
            counts = rules(column)
            failed = (counts["n_words"] < FEWEST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])
            score = scores(column, model)
            kept = ~failed & (score >= model.threshold)
            if only_kept:
                yield batch.filter(pa.array(kept))
                continue
            new = [*counts.values(), failed, score, kept]
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in fields] + [pa.array(x) for x in new], names=schema.names
            )

    return docs.mapInArrow(run, schema)
