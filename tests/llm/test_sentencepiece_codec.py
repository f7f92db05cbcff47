"""Operator 6 against the model's own library, plain Viterbi, and exact round trips."""

from __future__ import annotations

import os
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from joulecorpus.llm import sentencepiece_codec as S

MODEL = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers") + "/piece_bpe_32k.model"
SCHEMA = "doc_id bigint, text string, tokens string, n_tokens int"


def texts() -> list:
    rng = random.Random(1)
    out = [None, "", " ", "  ", "   x", "a\n b  c   d", "\n\n", "ﬁ Ⅷ é é", "日本語 ☃ 🎉", "a\u0000b", "x ", "<s> </s> <0x0A>", "\r\n;\r\n}\r", "a" * 500, " " * 70 + "z", "▁a▁▁b"]
    pieces = ["the", " of", "ing", "  ", "\n", "été", "ción", "123", ".", "'s", "()", "    ", "\t", "Ω", "aaa", "lichß", "W"]
    out += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    out += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 1000), rng.randint(0x4E00, 0x9000)])) for _ in range(30)) for _ in range(100)]
    return out


@pytest.fixture(scope="module")
def vocabulary():
    return S.Vocabulary.load(MODEL)


def test_ids_are_those_of_the_library(vocabulary):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids, ends = S.Segmenter(vocabulary).encode(texts())
    for k, text in enumerate(texts()):
        assert ids[ends[k] : ends[k + 1]].tolist() == model.encode(text or ""), repr(text)
    back = S.Joiner(vocabulary).decode(ids, ends).to_pylist()
    assert back == [model.decode(model.encode(t or "")).encode() for t in texts()]
    assert back == [(t or "").replace("▁", " ").encode() for t in texts()]


def test_prefixes_are_searched_once(vocabulary):
    segmenter = S.Segmenter(vocabulary)
    words = sorted({"▁" + "abcdefgh"[:n] + x for n in range(8) for x in ("", "y", "yz")})
    list(segmenter.encode_sorted(words))
    assert segmenter.searched == len({w[:k] for w in words for k in range(1, len(w) + 1)})


def test_unigram_viterbi():
    rng = random.Random(2)
    pieces = sorted({"".join(rng.choice("▁abc") if k == 0 else rng.choice("abc") for k in range(rng.randint(1, 4))) for _ in range(40)} | set("abc▁"))
    scores = [rng.uniform(-9, -1) for _ in pieces]
    v = S.Vocabulary(["<unk>", *pieces], [0.0, *scores], [False] + [True] * len(pieces), [], 0, unigram=True)
    segmenter, value = S.Segmenter(v), dict(zip(pieces, scores))

    def best(word):
        if not word:
            return 0.0
        return max(value[word[:k]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in value)

    words = sorted({"▁" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(60)})
    for word, ids in zip(words, segmenter.encode_sorted(words)):
        assert "".join(v.pieces[i] for i in ids) == word
        assert np.isclose(sum(v.scores[i] for i in ids), best(word))


def test_round_trip_on_spark(spark, vocabulary):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(k if k != 7 else None, t, "clash", 1) for k, t in enumerate(texts())] + [(3, texts()[3], None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = S.round_trip(df, MODEL).collect()
    assert sorted((str(r.doc_id), list(r.tokens), r.round_trip) for r in got) == sorted(
        (str(i), model.encode(t or ""), "▁" not in (t or "")) for i, t, *_ in rows
    )
    assert all(r.n_tokens == len(r.tokens) for r in got)
    coded = S.encode(df, MODEL)
    assert coded.columns == ["doc_id", "text", "n_tokens", "tokens"]
    back = S.decode(coded.drop("text"), MODEL).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), (t or "").replace("▁", " ")) for i, t, *_ in rows)
    assert S.round_trip(df.limit(0), MODEL).collect() == []


def test_decoding_null_lists_and_control_ids(vocabulary):
    tokens = pa.array([[1, 264, 2], None, [], [264, None]], pa.list_(pa.int32()))
    assert S.decoded(tokens, S.Joiner(vocabulary)).to_pylist() == [b"a", b"", b"", b"a"]
