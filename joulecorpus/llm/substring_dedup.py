"""Operator 2: remove long byte strings that an earlier document holds, by prefix-free parsing.

* **Triggers.** A rolling hash over ``GRAM`` bytes is taken at every byte.  The trigger of
  a start is the smallest hash among the grams of its ``length``-byte string, so it
  depends on that string alone, and equal strings have equal triggers.
* **Phrases.** Consecutive starts with one trigger make a phrase: the bytes from the
  first start to the end of the last start's string.  Phrases overlap by ``length - 1``
  bytes, so every start has its whole string in its own phrase, and the order of the
  corpus's suffixes, to the depth of ``length`` bytes, is that of the dictionary's.
* **Parse.** Each document is its sequence of phrase numbers (hashes).  One shuffle deals
  the parse out by trigger.  A phrase that a smaller document holds is covered as a
  whole; the remaining first occurrences are the dictionary.  Copies within a batch are
  settled before the shuffle, so a hot phrase sends one row per batch.
* **Suffix order.** Only triggers with several phrases can hide further matches.  Their
  phrases' bytes are fetched, and all their suffixes sorted; equal neighbours are the
  repeated strings, and the smallest document of each run keeps them.  A trigger of many
  phrases is dealt out by single strings instead, copies within a batch settled before that.

Phrase equality is decided on 88 hash bits and the bucket; suffix equality on the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joulecorpus.llm import arrays as A
from joulecorpus.llm.frames import identified, input_bytes
from joulecorpus.session import as_table, join_small

#: Bytes of the rolling hash; a string of ``length`` bytes must hold at least one.
GRAM = 20
#: Phrases that are packed together before the shuffle.
PACK = 1 << 19
#: Input bytes for each bucket of triggers.
BUCKET_BYTES = 4 << 20
#: Suffixes that are sorted at a time; those of one trigger stay together.
SORTED = 100_000
#: Phrases to sort from which a trigger is dealt out by strings.
HOT = 2_000

PACKED = "bucket int, pack binary"
VERDICT = "doc_id bigint, version bigint, at bigint, n int, trigger bigint"
PHRASE = "trigger bigint, doc_id bigint, version bigint, at bigint, n int, known boolean, phrase binary"
MARK = "doc_id bigint, version bigint, at bigint, n int"
KEPT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"

Columns = dict[str, np.ndarray]


def phrases(column: pa.Array, doc: np.ndarray, version: np.ndarray, length: int, gram: int) -> Iterator[Columns]:
    """The phrases of a batch, piece by piece; rows with a negative ``version`` are left out."""
    hasher = A.Hasher(0)
    data, offsets = A.text_buffers(column)
    for low, high, edges, rows, bases in A.pieces(offsets, length - 1):
        piece = data[low:high]
        starts = np.maximum(np.diff(edges) - length + 1, 0)
        starts[version[rows] < 0] = 0
        use = np.flatnonzero(starts)
        if not len(use):
            continue
        sums = hasher.sums(piece)
        grams = hasher.fixed(sums, gram)
        trigger = A.sliding_argmin(grams, length - gram + 1)
        at = np.repeat(edges[use], starts[use]) + A.steps(starts[use])
        trigger = trigger[at]
        first = np.flatnonzero(np.r_[True, trigger[1:] != trigger[:-1]])
        count = np.diff(np.r_[first, len(at)])
        row = np.searchsorted(edges, at[first], "right") - 1
        yield {
            "trigger": grams[trigger[first]],
            "phrase": hasher.spans(sums, at[first], at[first] + count - 1 + length),
            "doc": doc[rows[row]],
            "version": version[rows[row]],
            "at": at[first] - edges[row] + bases[row],
            "n": count,
        }


def settle(rows: Columns) -> tuple[Columns, np.ndarray, np.ndarray]:
    """Sort by trigger, phrase and document; which rows a smaller document covers, and group starts."""
    order = np.lexsort((rows["version"], rows["doc"], rows["phrase"], rows["trigger"]))
    rows = {k: v[order] for k, v in rows.items()}
    fresh = A.fresh(rows["trigger"], rows["phrase"])
    smallest = rows["doc"][fresh][np.cumsum(fresh) - 1]
    return rows, rows["doc"] > smallest, fresh


def pack(rows: Columns, buckets: int) -> Iterator[tuple[int, bytes]]:
    """One compressed block per bucket; what this batch settles alone goes as settled, to buckets of its own beyond."""
    rows = dict(rows, trigger=rows["trigger"] >> A.U(24), phrase=rows["phrase"] >> A.U(16))
    rows, covered, _ = settle(rows)
    bucket = (A.mix(rows["trigger"]) % A.U(buckets)).astype(np.int64)
    # By document, so that no bucket of settled rows outgrows the others.
    spread = A.mix(rows["doc"].view(A.U) >> A.U(6)) % A.U(buckets)
    bucket = np.where(covered, buckets + spread.astype(np.int64), bucket)
    order = np.lexsort((rows["at"], rows["version"], rows["doc"], covered, bucket))
    rows, covered, bucket = {k: v[order] for k, v in rows.items()}, covered[order], bucket[order]
    edges = np.r_[np.flatnonzero(A.fresh(bucket)), len(bucket)]
    squeeze = zstandard.ZstdCompressor(level=1)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = slice(a, b)
        open_ = part.stop - part.start - int(covered[part].sum())
        hashes = [
            rows[k][part][:open_].view(np.uint8).reshape(-1, 8)[:, :size].tobytes() for k, size in (("trigger", 5), ("phrase", 6))
        ]
        places = [np.diff(rows["doc"][part], prepend=0), rows["version"][part], rows["at"][part].astype(np.uint32)]
        planes = [np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() for x in places]
        planes.append(rows["n"][part].astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())
        head = np.array([b - a, open_], np.uint32).tobytes()
        yield int(bucket[a]), head + b"".join(hashes) + squeeze.compress(b"".join(planes))


def unpack(blocks: list[bytes]) -> tuple[Columns, Columns]:
    """The packed rows still to be settled, and those that were settled."""
    parts: list[tuple[Columns, int]] = []
    for block in blocks:
        n, open_ = (int(x) for x in np.frombuffer(block, np.uint32, 2))
        at, rows = 8, {}
        for name, size in (("trigger", 5), ("phrase", 6)):
            wide = np.zeros((open_, 8), np.uint8)
            wide[:, :size] = np.frombuffer(block, np.uint8, open_ * size, at).reshape(-1, size)
            rows[name] = wide.view(A.U).ravel()
            at += open_ * size
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block[at:]), np.uint8)
        at = 0
        for name, size, kind in (("doc", 8, np.int64), ("version", 8, np.int64), ("at", 4, np.uint32), ("n", 4, np.uint32)):
            plane = planes[at : at + n * size].reshape(size, n).T
            rows[name] = np.ascontiguousarray(plane).view(kind).ravel().astype(np.int64)
            at += n * size
        rows["doc"] = np.cumsum(rows["doc"])
        parts.append((rows, open_))
    still = {k: np.concatenate([r[k][:o] for r, o in parts]) for k in parts[0][0]}
    done = {k: np.concatenate([r[k][o:] for r, o in parts]) for k in ("doc", "version", "at", "n")}
    return still, done


def verdicts(blocks: list[bytes]) -> pa.RecordBatch:
    """Covered phrases (null trigger), and dictionary phrases whose suffixes must be sorted."""
    still, done = unpack(blocks)
    rows, covered, fresh = settle(still)
    group = np.cumsum(A.fresh(rows["trigger"])) - 1 if len(fresh) else np.empty(0, np.int64)
    kinds = np.bincount(group, fresh) if len(group) else np.empty(0)
    edges = np.flatnonzero(A.fresh(rows["trigger"])) if len(group) else np.empty(0, np.int64)
    if len(edges):
        several = (kinds > 1) & (np.minimum.reduceat(rows["doc"], edges) < np.maximum.reduceat(rows["doc"], edges))
        unsure = several[group] & ~covered
    else:
        unsure = covered
    take = np.r_[np.flatnonzero(covered), np.flatnonzero(unsure)]
    trigger = rows["trigger"][take].astype(np.int64)
    known = np.r_[np.ones(int(covered.sum()), bool), np.zeros(int(unsure.sum()), bool), np.ones(len(done["doc"]), bool)]
    columns = [np.r_[rows[k][take], done[k]] for k in ("doc", "version", "at")]
    return pa.RecordBatch.from_arrays(
        [
            *(pa.array(x, pa.int64()) for x in columns),
            pa.array(np.r_[rows["n"][take], done["n"]], pa.int32()),
            pa.array(np.r_[trigger, np.zeros(len(done["doc"]), np.int64)], pa.int64(), mask=known),
        ],
        names=["doc_id", "version", "at", "n", "trigger"],
    )


def repeated_starts(phrase: pa.Array, doc: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort all suffixes of the phrases; phrase number and start of those a smaller document holds."""
    data, offsets = A.text_buffers(phrase)
    owner, step = np.repeat(np.arange(len(n)), n), A.steps(n)
    begin = offsets[:-1][owner] + step
    # Eight bytes of every suffix make a key, the last ones overlap with those before; one column of keys at a time.
    places = [*range(0, length - 7, 8), length - 8] if length >= 8 else [0]
    padded = np.r_[data, np.zeros(8, np.uint8)]
    mask = A.U(2**64 - 2 ** (64 - 8 * min(length, 8)))
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    keys = [eight[begin + p].view(">u8").ravel().astype(A.U) & mask for p in places]
    order = np.lexsort(keys[::-1])
    doc = doc[owner][order]
    edges = np.flatnonzero(A.fresh(*(k[order] for k in keys)))
    smallest = np.repeat(np.minimum.reduceat(doc, edges), np.diff(np.r_[edges, len(doc)]))
    found = np.sort(order[doc > smallest])
    return owner[found], step[found]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that starts in a smaller document.

    One row per input row: ``doc_id, n_bytes, n_removed, n_spans, spans, kept`` (the
    remaining bytes).  A null text is empty.  A row without an id keeps its text and
    covers nothing.  Rows that repeat an id are judged as documents of that id, so they
    don't cover each other, whether or not their texts are equal.  Texts shorter than
    ``length`` stay.  Other columns are ignored.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    gram = min(GRAM, max(1, length // 2))
    texts = identified(docs, id_col, text_col)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs) // BUCKET_BYTES)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Columns] = []

        def flush() -> pa.RecordBatch:
            packed = list(pack({k: np.concatenate([x[k] for x in held]) for k in held[0]}, buckets))
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in packed], pa.int32()), pa.array([x for _, x in packed], pa.binary())],
                names=["bucket", "pack"],
            )

        for batch in batches:
            missing = np.asarray(batch.column(0).is_null())
            doc = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            number = np.where(missing, -1, batch.column(1).to_numpy(zero_copy_only=False))
            for part in phrases(batch.column(2), doc, number, length, gram):
                held.append(part)
                if sum(len(x["n"]) for x in held) >= PACK:
                    yield flush()
        if held:
            yield flush()

    def reduce(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([verdicts(table.column("pack").to_pylist())])

    packed = texts.mapInArrow(parse, PACKED)
    settled = as_table(packed.groupBy("bucket").applyInArrow(reduce, VERDICT), "phrases")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = A.text_buffers(batch.column("text"))
            row, flat = A.row_lists(batch.column("wanted"))
            at, n = flat.field("at").to_numpy(), flat.field("n").to_numpy().astype(np.int64)
            trigger, hot = flat.field("trigger").to_numpy(), flat.field("hot").to_numpy(zero_copy_only=False)
            doc, version = (batch.column(c).fill_null(0).to_numpy() for c in ("doc_id", "version"))

            def rows(some: np.ndarray, at: np.ndarray, n: np.ndarray, trigger: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
                begin, size = offsets[some] + at, np.where(known, 0, n + length - 1)
                values = [trigger, doc[some], version[some], at, n.astype(np.int32), known]
                columns = [*(pa.array(x) for x in values), A.slices(data, begin, size)]
                return pa.RecordBatch.from_arrays(columns, names=["trigger", "doc_id", "version", "at", "n", "known", "phrase"])

            cold, warm = np.flatnonzero(~hot), np.flatnonzero(hot)
            for a in range(0, len(cold), PACK // 8):
                some = cold[a : a + PACK // 8]
                yield rows(row[some], at[some], n[some], trigger[some], np.zeros(len(some), bool))
            edges = np.r_[0, np.cumsum(n[warm])]
            for a, b in A.row_ranges(edges, PACK // 4):
                some = warm[a:b]
                owner, place = np.repeat(row[some], n[some]), np.repeat(at[some], n[some]) + A.steps(n[some])
                # The string itself is the key; what a smaller document of this batch holds leaves it.
                size = n[some] + length - 1
                text = np.frombuffer(A.slices(data, offsets[row[some]] + at[some], size).buffers()[2], np.uint8)
                begin = np.repeat(np.cumsum(size) - size, n[some]) + A.steps(n[some])
                key, proof = (h.spans(h.sums(text), begin, begin + length) for h in (A.Hasher(11), A.Hasher(12)))
                order = np.lexsort((doc[owner], proof, key))
                start = A.fresh(key[order], proof[order])
                known = np.empty(len(owner), bool)
                known[order] = doc[owner][order] > doc[owner][order][start][np.cumsum(start) - 1]
                key = np.where(known, A.mix(doc[owner].view(A.U) * A.U(31) + place.view(A.U)), key)
                yield rows(owner, place, np.ones(len(owner), np.int64), key.view(np.int64), known)

    def sort_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, most = 0, SORTED

        def done(rows: pa.Table) -> pa.RecordBatch:
            known = rows.filter(rows["known"]).combine_chunks()
            rows = rows.filter(pc.invert(rows["known"])).combine_chunks()
            if not rows.num_rows:
                return known.select(["doc_id", "version", "at", "n"]).to_batches()[0]
            doc, n = rows["doc_id"].to_numpy(), rows["n"].to_numpy().astype(np.int64)
            phrase = rows["phrase"].chunk(0) if rows["phrase"].num_chunks == 1 else pa.concat_arrays(rows["phrase"].chunks)
            owner, step = repeated_starts(phrase, doc, n, length)
            first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (step[1:] != step[:-1] + 1)]) if len(owner) else owner
            size = np.diff(np.r_[first, len(owner)])
            owner, step = owner[first], step[first]
            values = [doc[owner], rows["version"].to_numpy()[owner], rows["at"].to_numpy()[owner] + step, size.astype(np.int32)]
            names = ["doc_id", "version", "at", "n"]
            columns = [pa.array(np.r_[known[c].to_numpy(), x]) for c, x in zip(names, values, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            held.append(batch)
            size += int(batch.column("n").to_numpy().sum())
            if size < most:
                continue
            rows = pa.Table.from_batches(held)
            trigger, suffixes = rows["trigger"].to_numpy(), np.cumsum(rows["n"].to_numpy(), dtype=np.int64)
            low, last = 0, int(np.searchsorted(trigger, trigger[-1]))  # the last trigger may go on
            while low < last:
                # As many whole triggers as the bound allows, one at least.
                high = int(np.searchsorted(suffixes, suffixes[low] + SORTED, "right"))
                high = int(np.searchsorted(trigger, trigger[min(high, last - 1)]))
                high = high if high > low else min(last, int(np.searchsorted(trigger, trigger[low], "right")))
                yield done(rows.slice(low, high - low))
                low = high
            held = rows.slice(last).to_batches()
            size = int(suffixes[-1] - (suffixes[last - 1] if last else 0))
            most = max(SORTED, 2 * size)  # a trigger that goes on is looked at again when it has doubled
        if held and sum(x.num_rows for x in held):
            yield done(pa.Table.from_batches(held))

    key = ["doc_id", "version"]
    unsure = settled.where("trigger is not null")
    hot = unsure.groupBy("trigger").agg(F.count("*").alias("phrases")).where(F.col("phrases") > HOT).select("trigger", F.lit(True).alias("hot"))
    unsure = join_small(unsure, hot, ["trigger"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = unsure.groupBy(*key).agg(F.collect_list(F.struct("at", "n", "trigger", "hot")).alias("wanted"))
    dictionary = texts.join(wanted, key, "left").select("doc_id", "version", "text", "wanted").mapInArrow(fetch, PHRASE)
    ordered = dictionary.repartition("trigger").sortWithinPartitions("trigger").mapInArrow(sort_suffixes, MARK)
    covered = settled.where("trigger is null").select(*key, "at", "n").unionByName(ordered)
    marks = covered.groupBy(*key).agg(F.collect_list(F.struct("at", "n")).alias("marks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = A.text_buffers(batch.column("text"))
            owner, flat = A.row_lists(batch.column("marks"))
            at, n = flat.field("at").to_numpy(), flat.field("n").to_numpy()
            for first, last in A.row_ranges(offsets):
                low, high = offsets[first], offsets[last]
                own = slice(*np.searchsorted(owner, [first, last]))
                start = offsets[owner[own]] - low + at[own]
                depth = np.zeros(high - low + 1, np.int32)
                np.add.at(depth, start, 1)
                np.add.at(depth, start + n[own] + length - 1, -1)
                gone = np.cumsum(depth[:-1], dtype=np.int32) > 0
                ids = batch.column("doc_id").slice(first, last - first)
                yield kept_rows(ids, data[low:high], offsets[first : last + 1] - low, gone)

    return texts.join(marks, key, "left").select("doc_id", "version", "text", "marks").mapInArrow(cut, KEPT)


def kept_rows(ids: pa.Array, data: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    """Per row: sizes, maximal removed runs and the remaining bytes."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.r_[False, gone]
    after = np.r_[gone, False]
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    removed = np.r_[0, np.cumsum(gone)][offsets]
    runs = np.searchsorted(start, offsets).astype(np.int32)
    base = np.repeat(offsets[:-1], np.diff(runs))
    pair = pa.StructArray.from_arrays([pa.array(start - base), pa.array(end - base)], names=["start", "end"])
    n_removed = np.diff(removed)
    places = np.r_[0, np.cumsum(np.diff(offsets) - n_removed)].astype(np.int32)
    kept = pa.Array.from_buffers(
        pa.binary(), len(ids), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data[~gone]))]
    )
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array(np.diff(offsets)),
            pa.array(n_removed),
            pa.array(np.diff(runs).astype(np.int64)),
            pa.ListArray.from_arrays(pa.array(runs), pair),
            kept,
        ],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
    )
