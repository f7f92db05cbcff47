"""Operator 12: alignment of two tokenizers, as an Arrow pipeline.

* **Ends.** The token lists of a slice of documents are flattened with their parent indices; byte
  lengths come from a table by id, and a cumulative sum less the document's own start gives the
  byte offset at which each token ends (segmented by document).
* **Links.** The tokens of both sides are joined by Acero on the key (document, end).  Where both end,
  a group ends; no token is empty, so a group holds one link: its last tokens.
* **Counts.** The links of a document are grouped to distinct id pairs (``Table.group_by``) and written
  once.  Partial counts of pairs are grouped again over the batches of a task and merged by Spark.
* **Scores.** A document needs the corpus-wide counts of its pairs.  Pairs are met by a hash join: the
  most frequent ones, whose number is bounded, by a broadcast, so that no hot pair is shuffled; all
  others by a shuffle.  The bound comes from a histogram of the counts, not from a sort.

The first tokenizer is byte-level: its vocabulary is read from its file and run by ``tiktoken``, which
takes a token's id as its rank; the tests hold it against the file's own library.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joulecorpus.llm import arrays as A
from joulecorpus.session import as_table

#: Distinct pairs that are broadcast at most.
HOT = 1 << 18
#: Rows of partial counts that a task holds.
HELD = 1 << 20

#: How the byte-level vocabulary cuts texts before merging (fixed values of the vocabulary).
CUT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

ALIGNED = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links array<struct<pair:bigint,n:bigint>>"
GROUPS = "doc_id bigint, ends array<bigint>, a array<array<int>>, b array<array<int>>"

Encoder = Callable[[list[str]], list[list[int]]]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_level(path: str) -> tuple[Encoder, list[bytes]]:
    """Encoder and token bytes of a byte-level BPE file; special tokens are never produced."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {x["content"] for x in content["added_tokens"]}
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in token): number for token, number in content["model"]["vocab"].items() if token not in special}
    encoding = tiktoken.Encoding("file", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})
    token = [b""] * (max(content["model"]["vocab"].values()) + 1)
    for body, number in ranks.items():
        token[number] = body
    return lambda texts: [encoding.encode_ordinary(" " + x) if x else [] for x in texts], token


def pieces(path: str) -> tuple[Encoder, list[bytes]]:
    """Encoder and token bytes of a SentencePiece model, which puts a space before each text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    token = []
    for number in range(model.get_piece_size()):
        piece = model.id_to_piece(number)
        if model.is_byte(number):
            token.append(bytes([int(piece[3:5], 16)]))
        else:
            token.append(b"" if model.is_control(number) else piece.replace("▁", " ").encode())
    return lambda texts: model.encode(texts, num_threads=1), token


class Side:
    """One tokenizer's tokens of a slice of documents."""

    def __init__(self, lists: pa.ListArray, token: pa.Array, size: pa.Array):
        self.ids = lists.flatten()
        self.parent = pc.list_parent_indices(lists)
        self.edges = lists.offsets.to_numpy().astype(np.int64)  # the tokens of each document
        self.joined = token.take(self.ids)
        total = pc.cumulative_sum(size.take(self.ids))
        self.before = np.r_[0, total.to_numpy()][self.edges]  # bytes before each document
        self.end = pc.subtract(total, pa.array(self.before[:-1]).take(self.parent))

    def key(self) -> pa.Array:
        """Document and end in one number."""
        return pc.bit_wise_or(pc.shift_left(self.parent.cast(pa.int64()), 40), self.end)

    def differs(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Documents whose tokens together are not the bytes of ``data`` between ``places``."""
        own, _ = A.text_buffers(self.joined)
        if np.array_equal(self.before, places) and np.array_equal(own, data):
            return np.zeros(len(places) - 1, bool)
        before = self.before
        return np.array([not np.array_equal(own[before[i] : before[i + 1]], data[places[i] : places[i + 1]]) for i in range(len(places) - 1)], bool)


def _edges(counts: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(counts)].astype(np.int32)


class Aligned:
    """Tokens, groups and links of a slice of documents."""

    def __init__(self, texts: pa.Array, coders: list[tuple[Encoder, pa.Array, pa.Array]]):
        plain = texts.to_pylist()
        empty = np.array([not x for x in plain], bool)
        marked = pa.array(["" if not x else " " + x for x in plain], pa.string())
        data, places = A.text_buffers(marked)
        lists = [[[] if none else x for x, none in zip(encode(["" if x is None else x for x in plain]), empty, strict=True)] for encode, _, _ in coders]
        sides = self._sides(lists, coders)
        wrong = sides[0].differs(data, places) | sides[1].differs(data, places)
        if wrong.any():
            lists = [[[] if bad else x for x, bad in zip(own, wrong, strict=True)] for own in lists]
            sides = self._sides(lists, coders)
        self.a, self.b = sides
        self.rows = len(plain)
        a = pa.table({"key": self.a.key(), "a": self.a.ids, "i": pa.array(np.arange(len(self.a.ids)))})
        b = pa.table({"key": self.b.key(), "b": self.b.ids, "j": pa.array(np.arange(len(self.b.ids)))})
        self.links = a.join(b, keys="key", join_type="inner", use_threads=False).combine_chunks()
        # The group of a token is the number of groups that end before it.
        self.group_a, self.group_b = (self._groups(x, len(s.ids)) for x, s in (("i", self.a), ("j", self.b)))
        self.doc = self.links["key"].to_numpy() >> 40

    @staticmethod
    def _sides(lists: list, coders: list) -> tuple[Side, Side]:
        a, b = (Side(pa.array(own, pa.list_(pa.int32())), token, size) for own, (_, token, size) in zip(lists, coders, strict=True))
        return a, b

    def _groups(self, column: str, size: int) -> np.ndarray:
        last = np.zeros(size, np.int64)
        last[self.links[column].to_numpy()] = 1
        return np.cumsum(last) - last

    def counts(self) -> list[np.ndarray]:
        groups = np.bincount(self.doc, minlength=self.rows)
        return [np.diff(self.a.edges), np.diff(self.b.edges), groups, groups]

    def pairs(self, width: int) -> pa.ListArray:
        """The distinct id pairs of each document's links, ``a * width + b``, and how often each occurs."""
        pair = self.links["a"].to_numpy().astype(np.int64) * width + self.links["b"].to_numpy()
        own = pa.table({"doc": self.doc, "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc")
        edges = _edges(np.bincount(own["doc"].to_numpy(), minlength=self.rows))
        values = pa.StructArray.from_arrays([own["pair"].combine_chunks(), own["count_all"].combine_chunks()], names=["pair", "n"])
        return pa.ListArray.from_arrays(pa.array(edges), values)

    def digests(self) -> list[str]:
        """SHA-256 of each document's groups as text; empty without tokens."""
        a, b = self.a.ids.to_numpy(), self.b.ids.to_numpy()
        groups = int(self.links.num_rows)
        # In each group the tokens of the first side come before those of the second.
        at_a = np.arange(len(a)) + np.searchsorted(self.group_b, self.group_a)
        at_b = np.arange(len(b)) + np.searchsorted(self.group_a, self.group_b, "right")
        number, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        number[at_a], number[at_b] = a, b
        mark[at_a[np.r_[np.diff(self.group_a) > 0, True][: len(a)]]] = ord("|")
        mark[at_b[np.r_[np.diff(self.group_b) > 0, True][: len(b)]]] = ord(";")
        assert groups == 0 or len(a)
        body, ends = decimals(number, mark)
        edges = np.r_[0, ends][self.a.edges + self.b.edges]
        raw = memoryview(body)
        return [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def grouped(self) -> list[pa.Array]:
        """Ends of the groups of each document, and the ids of both sides in each."""
        counts = np.bincount(self.doc, minlength=self.rows)
        edges = pa.array(_edges(counts))
        ends = np.sort(self.links["key"].to_numpy()) & ((1 << 40) - 1)
        out = [pa.ListArray.from_arrays(edges, pa.array(ends))]
        for side, group in ((self.a, self.group_a), (self.b, self.group_b)):
            inner = pa.ListArray.from_arrays(pa.array(_edges(np.bincount(group, minlength=int(counts.sum())))), side.ids)
            out.append(pa.ListArray.from_arrays(edges, inner))
        return out


def decimals(number: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in decimal digits, each followed by its mark; and where each ends."""
    most = len(str(int(number.max()))) if len(number) else 1
    width = np.ones(len(number), np.int64)
    for k in range(1, most):
        width += number >= 10**k
    out = np.zeros((len(number), most + 1), np.uint8)
    for k in range(most):  # the digit of weight 10 ** (width - 1 - k)
        out[:, k] = ord("0") + number // 10 ** np.maximum(width - 1 - k, 0) % 10
    out[np.arange(len(number)), width] = mark
    return np.ascontiguousarray(out[np.arange(most + 1) <= width[:, None]]), np.cumsum(width + 1)


def _loaded(paths: tuple[str, str]) -> list[tuple[Encoder, pa.Array, pa.Array]]:
    found = (byte_level(paths[0]), pieces(paths[1]))
    return [(encode, pa.array(token, pa.binary()), pa.array([len(t) for t in token], pa.int64())) for encode, token in found]


def _slices(batch: pa.RecordBatch, coders: list) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    _, offsets = A.text_buffers(batch.column("text"))
    for first, last in A.row_ranges(offsets):
        rows = batch.slice(first, last - first)
        yield rows, Aligned(rows.column("text"), coders)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def token_groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ends, a, b``: the byte offset at which each group ends, and the ids of both tokenizers in it."""

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = None
        for batch in batches:
            coders = coders or _loaded((a_path, b_path))
            for rows, own in _slices(batch, coders):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *own.grouped()], names=["doc_id", "ends", "a", "b"])

    return _texts(docs, id_col, text_col).mapInArrow(group, GROUPS)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, count``: how many links hold each pair, from partial counts of tasks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(parts: list[pa.Table]) -> pa.Table:
            return pa.concat_tables(parts).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])

        held: list[pa.Table] = []
        for batch in batches:
            _, flat = A.row_lists(batch.column("links"))
            held.append(pa.table({"pair": flat.field("pair"), "n": flat.field("n")}))
            if sum(x.num_rows for x in held) > HELD:
                held = [merged(held)]
                if held[0].num_rows > HELD // 2:  # too many distinct pairs to hold
                    yield from held.pop().combine_chunks().to_batches()
        if held:
            yield from merged(held).combine_chunks().to_batches()

    return aligned.select("links").mapInArrow(partial, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("count"))


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row.

    The text, after one space, is cut by a byte-level BPE (``a_path``) and a SentencePiece model
    (``b_path``).  Groups end where tokens of both end; a link is a pair of tokens that end together.
    ``n_best`` counts the links whose id pair occurs, in the whole corpus, as often as any pair of
    its second id; ``count_sum`` adds the pairs' counts.  A null or empty text, and one that either
    tokenizer does not give back byte for byte, has no tokens: zeros and an empty digest.
    Null and repeated ids are rows like any other.  Other columns are ignored; an empty table
    gives an empty result.
    """
    width = len(pieces(b_path)[1])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders, row = None, TaskContext.get().partitionId() << 40
        for batch in batches:
            coders = coders or _loaded((a_path, b_path))
            for rows, own in _slices(batch, coders):
                columns = [np.arange(row, row + own.rows), rows.column("doc_id"), *own.counts(), own.digests(), own.pairs(width)]
                row += own.rows
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.name for f in schema.fields])

    schema = T._parse_datatype_string(ALIGNED)
    aligned = as_table(_texts(docs, id_col, text_col).mapInArrow(align, schema), "aligned")
    counts = as_table(pair_counts(aligned), "pairs")
    # One row for each id of the second vocabulary: bounded by its size.
    most = counts.groupBy(F.expr(f"pair % {width}").alias("second")).agg(F.max("count").alias("most"))
    judged = counts.join(F.broadcast(most), F.expr(f"pair % {width}") == F.col("second")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    level = F.floor(F.log2("count")).cast("int")
    histogram = {row.level: row["count"] for row in counts.select(level.alias("level")).groupBy("level").count().collect()}
    least, rows = 64, 0
    while least and rows + histogram.get(least - 1, 0) <= hot:
        least -= 1
        rows += histogram.get(least, 0)

    def scores(links: DataFrame, own: DataFrame) -> DataFrame:
        met = links.join(own, "pair")
        return met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))

    links = aligned.select("row", F.inline("links"))
    scored = scores(links, F.broadcast(judged.where(level >= least)))
    if least:
        rare = judged.where(level < least)
        left = links.join(F.broadcast(judged.where(level >= least).select("pair")), "pair", "left_anti")
        scored = scored.unionByName(scores(left, rare)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("n_best", "count_sum")}
    names = ("n_a", "n_b", "n_groups", "n_links")
    return aligned.drop("links").join(scored, "row", "left").select("doc_id", *names, zero["n_best"], zero["count_sum"], "groups_sha256")
