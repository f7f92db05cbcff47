"""Operator 6: SentencePiece encoding and decoding by a shared-prefix search.

A text becomes marked words: spaces turn into the mark, one mark goes in front, and the
text is cut before each run of marks, where no piece reaches across.  The distinct words of
a batch are sorted, which lays them out as a trie in depth-first order; a stack holds the
forward state of every prefix of the current word, and the next word keeps the states of
the prefix that it shares.  Each distinct word is thus searched once, and each
distinct prefix once.

The forward search is Viterbi's: the state of a prefix says which piece ends there.  For a
unigram model that is the piece of the best summed score.  A merge (BPE) model does not
maximise a sum, so summed scores would give wrong pieces there; instead two pieces may
follow each other only if merging their joint text gives back just these two.  A sequence
whose neighbours all pass is the one that merging gives, and each prefix has exactly one, so
the same search is exact.  Characters without a piece fall back to their bytes.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import astuple, dataclass, field
from itertools import chain
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joulecorpus.llm import arrays as A

MARK = "▁"
#: Neighbour checks and words that each half of a memory holds.
REMEMBERED = 300_000
#: Numbers of characters without a piece, above those of all pieces.
NO_PIECE = 1 << 24


@dataclass
class Vocabulary:
    """Pieces by id.  ``plain`` pieces can be found in a text; the others are control and byte pieces."""

    pieces: list[str]
    scores: list[float]
    plain: list[bool]
    byte_ids: list[int]
    unknown: int
    unigram: bool = False

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in ids]
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        kinds = {2: False, 1: True}
        kind = _model_type(model.serialized_model_proto())
        if kind not in kinds:
            raise ValueError(f"model type {kind} is neither unigram nor BPE")
        return Vocabulary(
            [model.id_to_piece(i) for i in ids],
            [model.get_score(i) for i in ids],
            [not s for s in special],
            byte_ids if all(model.is_byte(i) for i in byte_ids) else [],
            model.unk_id(),
            kinds[kind],
        )


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else 4 if kind == 5 else 8
        yield tag >> 3, data[at : at + size]
        at += size


def _model_type(model: bytes) -> int:
    """1 is unigram, 2 is BPE; field 3 of field 2 of the model, 1 if absent."""
    for number, value in _fields(model):
        if number == 2:
            return int(dict(_fields(value)).get(3, 1))
    return 1


class Memory:
    """A dict of bounded size: what has not been asked for lately is forgotten, half at a time."""

    def __init__(self) -> None:
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        self.young[key] = value


@dataclass
class Segmenter:
    """Pieces of marked words, sharing the search among words with a common prefix."""

    vocabulary: Vocabulary
    ids: dict[str, int] = field(init=False)
    score: dict[str, float] = field(init=False)
    word: re.Pattern = field(init=False)
    lengths: dict[str, tuple[int, ...]] = field(init=False)
    chain: dict[int, tuple[tuple[int, int], ...]] = field(init=False)
    fits: Memory = field(default_factory=Memory)
    known: Memory = field(default_factory=Memory)
    searched: int = 0

    def __post_init__(self) -> None:
        v = self.vocabulary
        self.ids = {p: i for i, (p, plain) in enumerate(zip(v.pieces, v.plain, strict=True)) if plain}
        self.score = {p: v.scores[i] for p, i in self.ids.items()}
        # By the last four characters, how long the longer pieces are that end with them.
        ending: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) > 3:
                ending.setdefault(piece[-4:], set()).add(len(piece))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in ending.items()}
        # All pieces that a piece ends with, itself first, and its last character.
        self.chain = {}
        for piece, number in self.ids.items():
            ends = [(n, len(piece) - k) for k in range(len(piece) - 1) if (n := self.ids.get(piece[k:])) is not None]
            self.chain[number] = (*ends, (self.number(piece[-1]), 1))
        # A line break that no piece holds is a word of its own, so that lines share words.
        alone = "" if any("\n" in p for p in self.ids) else "\n"
        self.word = re.compile((f"{alone}|" if alone else "") + f"{MARK}*[^{MARK}{alone}]+|{MARK}+")
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece reaches across words")

    def merged(self, text: str) -> list[str]:
        """Merge the best-scored neighbours, the leftmost of equals, until none has a piece."""
        parts = list(text)
        while True:
            best = None
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best[0]):
                    best = (score, k)
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def follows(self, left: int, right: int) -> bool:
        """Whether one number may come after another; ``NO_PIECE`` on the left is the start."""
        key = left << 32 | right
        known = self.fits.young.get(key)
        if known is None and (known := self.fits.get(key)) is None:
            pair = [self.text(n) for n in (left, right) if n != NO_PIECE]
            known = self.merged("".join(pair)) == pair
            self.fits.put(key, known)
        return known

    def text(self, number: int) -> str:
        return self.vocabulary.pieces[number] if number < NO_PIECE else chr(number - NO_PIECE - 1)

    def number(self, piece: str) -> int:
        """The id of a piece, or the number of a character that has none."""
        known = self.ids.get(piece)
        return known if known is not None else NO_PIECE + 1 + ord(piece)

    def endings(self, word: str, j: int) -> tuple[tuple[int, int], ...]:
        """Number and length of every piece that may end the prefix of ``j`` characters, longest first."""
        for size in self.lengths.get(word[j - 4 : j], ()) if j > 3 else ():
            if size <= j and (number := self.ids.get(word[j - size : j])) is not None:
                return self.chain[number]
        for size in (3, 2):
            if size <= j and (number := self.ids.get(word[j - size : j])) is not None:
                return self.chain[number]
        return ((self.number(word[j - 1]), 1),)

    def encode_sorted(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of each of the sorted words."""
        v, endings, follows, fits = self.vocabulary, self.endings, self.follows, self.fits
        ids, lengths, suffixes = self.ids, self.lengths, self.chain
        lowest = min(self.score.values(), default=0.0) - 10.0
        before = ""
        longest = max(map(len, words), default=0) + 1
        # The piece that ends each prefix of the current word, and the best score up to there.
        ends, sizes, totals = [NO_PIECE] * longest, [0] * longest, [0.0] * longest
        for word in words:
            shared = len(commonprefix((before, word)))
            for j in range(shared + 1, len(word) + 1):
                if v.unigram:
                    ways = [(totals[j - k] + (v.scores[n] if n < NO_PIECE else lowest), -k, n) for n, k in endings(word, j)]
                    totals[j], size, number = max(ways)
                    size = -size
                else:
                    # ``endings`` and ``follows`` without their calls, where most of the time goes.
                    ways = None
                    if j > 3:
                        for size in lengths.get(word[j - 4 : j], ()):
                            if size <= j and (number := ids.get(word[j - size : j])) is not None:
                                ways = suffixes[number]
                                break
                    remembered = fits.young
                    for number, size in ways or endings(word, j):
                        left = ends[j - size]
                        known = remembered.get(left << 32 | number)
                        if known or (known is None and follows(left, number)):
                            break
                    else:
                        last = self.merged(word[:j])[-1]
                        number, size = self.number(last), len(last)
                ends[j] = number
                sizes[j] = size
            self.searched += len(word) - shared
            before = word
            out: list[int] = []
            j = len(word)
            while j:
                number = ends[j]
                j -= sizes[j]
                if number < NO_PIECE:
                    out.append(number)
                elif v.byte_ids:
                    out.extend(v.byte_ids[b] for b in reversed(self.text(number).encode()))
                else:
                    out.append(v.unknown)
            out.reverse()
            yield out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and where each text's ids begin."""
        marked = [self.word.findall(MARK + text.replace(" ", MARK)) if text else [] for text in texts]
        counts = [len(m) for m in marked]
        distinct = dict.fromkeys(chain.from_iterable(marked))
        young, old = self.known.young, self.known.old
        coded = {w: young.get(w) or old.get(w) for w in distinct}
        words = sorted(w for w, ids in coded.items() if ids is None)
        for word, ids in zip(words, self.encode_sorted(words), strict=True):
            coded[word] = array("i", ids).tobytes()
        if len(young) + len(coded) > REMEMBERED:  # what this slice did not hold is forgotten by halves
            self.known.old, self.known.young = young, coded
        else:
            young.update(coded)
        size = np.fromiter(map(len, coded.values()), np.int64, len(coded)) // 4
        flat = np.frombuffer(b"".join(coded.values()), np.int32)
        begin = np.cumsum(size) - size
        number = dict(zip(coded, range(len(coded)), strict=True))
        used = np.fromiter(map(number.__getitem__, chain.from_iterable(marked)), np.int64, sum(counts))
        ids = flat[np.repeat(begin[used], size[used]) + A.steps(size[used])]
        ends = np.r_[0, np.cumsum(size[used])][np.r_[0, np.cumsum(counts)].astype(np.int64)]
        return ids, ends


@dataclass
class Joiner:
    """Texts of ids: a table of bytes for each piece, gathered and joined."""

    vocabulary: Vocabulary

    def __post_init__(self) -> None:
        v = self.vocabulary
        of_byte = {i: bytes([b]) for b, i in enumerate(v.byte_ids)}
        plain = [p.replace(MARK, " ").encode() if ok else of_byte.get(i, b"") for i, (p, ok) in enumerate(zip(v.pieces, v.plain, strict=True))]
        if 0 <= v.unknown < len(plain):
            plain[v.unknown] = " ⁇ ".encode()
        self.size = np.array([len(p) for p in plain])
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(plain), np.uint8)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The text of each list of ids; the mark in front goes."""
        size = self.size[ids]
        body = self.data[np.repeat(self.begin[ids], size) + A.steps(size)]
        at = np.r_[0, np.cumsum(size)][ends]
        lead = at[:-1][at[:-1] < at[1:]]
        lead = lead[body[lead] == 0x20]
        keep = np.ones(len(body), bool)
        keep[lead] = False
        places = (at - np.searchsorted(lead, at)).astype(np.int32)
        return pa.Array.from_buffers(
            pa.binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(body[keep]))]
        )


def _added(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != name]).add(name, kind)


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    rest = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), column], names=[*rest, name])


def coded_rows(batch: pa.RecordBatch, text_col: str, segmenter: Segmenter) -> Iterator[tuple[pa.RecordBatch, pa.ListArray]]:
    """The batch in slices of bounded size, each with the ids of its texts."""
    _, offsets = A.text_buffers(batch.column(text_col))
    for first, last in A.row_ranges(offsets, 4 * A.PIECE):
        rows = batch.slice(first, last - first)
        ids, ends = segmenter.encode(rows.column(text_col).to_pylist())
        yield rows, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))


def decoded(tokens: pa.ListArray, joiner: Joiner) -> pa.Array:
    """Texts of lists of ids; null lists and null ids are empty."""
    _, flat = A.row_lists(tokens)
    lists = tokens.fill_null([]) if tokens.null_count else tokens
    ids = flat.fill_null(joiner.vocabulary.pieces.index("<s>") if "<s>" in joiner.vocabulary.pieces else 0)
    return joiner.decode(ids.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py())


def encode(docs: DataFrame, model: str, text_col: str = "text", name: str = "tokens") -> DataFrame:
    """``docs`` with the ids of each text in column ``name``, which replaces one of that name.

    A null or empty text has no ids.  Texts that hold the mark itself are read as if it were a
    space, as the model does.  Repeated rows and other columns pass unchanged.
    """
    shared = docs.sparkSession.sparkContext.broadcast(astuple(Vocabulary.load(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(Vocabulary(*shared.value))
        for batch in batches:
            for rows, tokens in coded_rows(batch, text_col, segmenter):
                yield _with(rows, name, tokens)

    return docs.mapInArrow(run, _added(docs.schema, name, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, model: str, tokens_col: str = "tokens", name: str = "text") -> DataFrame:
    """``df`` with the text of each list of ids in column ``name``, which replaces one of that name.

    A null list gives an empty text; ids of control pieces and null ids give nothing.
    """
    shared = df.sparkSession.sparkContext.broadcast(astuple(Vocabulary.load(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner = Joiner(Vocabulary(*shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                yield _with(rows, name, decoded(pa.concat_arrays([rows.column(tokens_col)]), joiner))

    raw = df.mapInArrow(run, _added(df.schema, name, T.BinaryType()))
    return raw.withColumn(name, F.decode(name, "UTF-8"))


def encode_checked(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens, tokens, round_trip``: whether decoding the ids gives the text's bytes back.

    Columns of these names are replaced; a null text counts as empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(astuple(Vocabulary.load(model)))
    schema = docs.schema
    for name, kind in (("n_tokens", T.LongType()), ("tokens", T.ArrayType(T.IntegerType())), ("round_trip", T.BooleanType())):
        schema = _added(schema, name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter, joiner = Segmenter(Vocabulary(*shared.value)), Joiner(Vocabulary(*shared.value))
        for batch in batches:
            for rows, tokens in coded_rows(batch, text_col, segmenter):
                same = pc.equal(decoded(tokens, joiner), rows.column(text_col).fill_null("").cast(pa.binary()))
                count = pa.array(np.diff(tokens.offsets.to_numpy()).astype(np.int64))
                for name, column in (("n_tokens", count), ("tokens", tokens), ("round_trip", same)):
                    rows = _with(rows, name, column)
                yield rows

    return docs.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, tokens, round_trip`` of every row; see ``encode_checked``."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return encode_checked(texts, model).drop("text")
