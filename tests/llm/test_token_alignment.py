"""Operator 12 against both libraries token by token."""

from __future__ import annotations

import hashlib
import os
import random
from collections import Counter

import pytest
import sentencepiece
import tokenizers

from joulecorpus.llm import token_alignment as alignment
from joulecorpus.llm.queries import BYTE_PAIRS, PIECES

SCHEMA = "doc_id bigint, text string, links int, row string"


def token_bytes():
    """Bytes of every token of both, from the libraries' own decoders."""
    own = tokenizers.Tokenizer.from_file(BYTE_PAIRS)
    letters = alignment.byte_letters()
    a = {i: bytes(letters[c] for c in t) for t, i in own.get_vocab().items() if t != "<|endoftext|>"}
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    b = {}
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        b[i] = bytes([int(piece[1:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
    return own, model, a, b


def brute(rows):
    own, model, a_bytes, b_bytes = token_bytes()
    own.encode_special_tokens = True
    found, count = [], Counter()
    for i, text, *_ in rows:
        want = (" " + (text or "")).encode()
        a = own.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        if b"".join(a_bytes[x] for x in a) != want or b"".join(b_bytes[x] for x in b) != want:
            found.append((i, 0, 0, [], ""))
            continue
        groups, links, x, y, left, right = [], [], 0, 0, [], []
        while x < len(a) or y < len(b):
            if sum(len(a_bytes[t]) for t in left) <= sum(len(b_bytes[t]) for t in right):
                left.append(a[x])
                x += 1
            else:
                right.append(b[y])
                y += 1
            if left and right and sum(len(a_bytes[t]) for t in left) == sum(len(b_bytes[t]) for t in right):
                groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
                links.append((left[-1], right[-1]))
                left, right = [], []
        count.update(links)
        found.append((i, len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best: dict = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(((i, n, m, len(p), len(p), sum(count[x] == best[x[1]] for x in p), sum(count[x] for x in p), h) for i, n, m, p, h in found), key=str)


def corpus():
    random.seed(12)
    words = ["the", "The", "naïve", "數據", "🙂", "don't", "3.14", "  ", "\n", "\t\t", "antidisestablishment", "<s>", "<|endoftext|>", "ﬁ", "é", "x" * 90]
    rows = [(i, " ".join(random.choices(words, k=random.randint(1, 60))), 1, "a") for i in range(120)]
    rows += [(500 + i, rows[3][1], None, None) for i in range(60)]
    rows += [(None, "no id", 1, None), (7, None, 1, None), (8, "", 1, None), (9, " ", 1, None), (9, " ", 1, None), (10, "a▁b", 1, None), (11, "a\0b", 1, None)]
    return [*rows, (12, "long " * 30_000, 1, None), (13, "z" * 20_000, 1, None)]


@pytest.mark.parametrize("hot", [alignment.HOT, 40, 0])
def test_against_the_libraries(spark, hot):
    rows = corpus()
    got = alignment.alignment(spark.createDataFrame(rows, SCHEMA).repartition(4), BYTE_PAIRS, PIECES, hot=hot)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_small_batches_of_partial_counts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "HELD", 8)
    rows = corpus()[:60]
    got = alignment.alignment(spark.createDataFrame(rows, SCHEMA).repartition(2), BYTE_PAIRS, PIECES)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_groups_are_the_tokens_in_order(spark):
    rows = [(1, "naïve tokens 數據", 1, "a"), (2, None, 1, "a")]
    got = {r.doc_id: r for r in alignment.token_groups(spark.createDataFrame(rows, SCHEMA), BYTE_PAIRS, PIECES).collect()}
    _, model, a_bytes, b_bytes = token_bytes()
    assert [x for g in got[1].b for x in g] == model.encode("naïve tokens 數據")
    ends = 0
    for end, a, b in zip(got[1].ends, got[1].a, got[1].b, strict=True):
        assert b"".join(a_bytes[x] for x in a) == b"".join(b_bytes[x] for x in b)
        ends += sum(len(a_bytes[x]) for x in a)
        assert end == ends
    assert (got[2].ends, got[2].a, got[2].b) == ([], [], [])


def test_empty_table(spark):
    assert alignment.alignment(spark.createDataFrame([], SCHEMA), BYTE_PAIRS, PIECES).collect() == []


def test_vocabulary_is_the_files_own(spark):
    assert os.path.exists(BYTE_PAIRS)
    own = tokenizers.Tokenizer.from_file(BYTE_PAIRS)
    own.encode_special_tokens = True
    encode, token = alignment.byte_level(BYTE_PAIRS)
    texts = [t for _, t, *_ in corpus() if t]
    assert encode(texts) == [own.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert len(token) == own.get_vocab_size(with_added_tokens=False)
