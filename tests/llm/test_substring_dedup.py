"""Operator 2 against a direct search over all strings."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

from joulecorpus.llm import arrays, substring_dedup as module
from joulecorpus.llm.substring_dedup import substring_dedup

SCHEMA = "doc_id bigint, text string, kept string, at int"


def brute(rows: list[tuple], length: int) -> list[tuple]:
    first: dict[bytes, int] = {}
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    for i, t in texts:
        if i is not None:
            for p in range(len(t) - length + 1):
                s = t[p : p + length]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        if i is not None:
            for p in range(len(t) - length + 1):
                if first[t[p : p + length]] < i:
                    gone[p : p + length] = [True] * length
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def check(spark, rows, length=50):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substring_dedup(df, length=length).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[4], r[2])
    assert sorted(got, key=key) == sorted(brute(rows, length), key=key)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["ab", "été", "the", "of", "x", "\n", "日本"]
    passages = ["".join(rng.choice(vocabulary) for _ in range(rng.randint(10, 80))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice("abc ") for _ in range(rng.randint(0, 90))) for _ in range(4)]
        text = "".join(parts)
        if rng.random() < 0.5 and rows:
            text = rng.choice(rows)[1] or ""
            cut = rng.randint(0, len(text))
            text = text[:cut] + rng.choice(["", "é", "zz"]) + text[cut:]
        rows.append((rng.randint(0, 400), text, None, 1))
    check(spark, rows)


def test_other_lengths(spark):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcde ") for _ in range(900))
    rows = [(i, "x" * i + passage[rng.randint(0, 300) : rng.randint(400, 900)] + "y" * i, None, 0) for i in range(30)]
    for length in (3, 300, 600):
        check(spark, rows, length)


def test_edge_cases(spark):
    same = "0123456789" * 6
    rows = [
        (1, None, None, None), (2, "", "k", 1), (None, same, None, 2), (3, same, None, 3), (3, same, None, 3), (3, same + "!", None, 0),
        (4, same, None, 4), (5, "x" * 49, None, 5), (6, "x" * 49, None, 5), (7, "a" * 3000, None, 0), (8, "a" * 500 + "b", None, 0),
        (-9, same[:50], None, 0),
    ]
    check(spark, rows)


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], T._parse_datatype_string(SCHEMA))).collect() == []


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    rng = random.Random(9)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    rows = [(1, shared, None, 0), (2, "q" * 70 + shared[100:3900] + "r" * 20, None, 0), (3, shared[2000:] + shared[:500], None, 0)]
    monkeypatch.setattr(arrays.pieces, "__defaults__", (700,))
    monkeypatch.setattr(module, "SORTED", 10)
    schema = SCHEMA
    batch = spark.createDataFrame(rows, schema).toArrow().combine_chunks().to_batches()[0]
    import numpy as np

    got = list(module.phrases(batch.column(1), np.array([1, 2, 3]), np.zeros(3, int), 50, 20))
    covered = {(int(d), int(a) + k) for x in got for d, a, n in zip(x["doc"], x["at"], x["n"]) for k in range(n)}
    assert covered == {(i, p) for i, t, *_ in rows for p in range(len(t) - 49)}


def test_a_hot_trigger_is_dealt_out_by_strings(spark, monkeypatch):
    rng = random.Random(21)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(120))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(60)) + passage + "zyx"[i % 3] * 70, None, 1) for i in range(400)]
    rows += [(i, rows[i][1][20:] + "q", None, 1) for i in range(0, 400, 50)] + [(None, passage, None, 1)]
    counter = spark.sparkContext.accumulator(0)
    own = module.repeated_starts

    def counted(phrase, doc, n, length):
        counter.add(int((n > 1).sum()))
        return own(phrase, doc, n, length)

    monkeypatch.setattr(module, "repeated_starts", counted)
    check(spark, rows)
    before = counter.value
    monkeypatch.setattr(module, "HOT", 20)
    check(spark, rows)
    # The hot triggers' phrases are no longer sorted as groups.
    assert before > 400 and counter.value - before < before / 4


def test_settled_rows_pass_the_buckets():
    import numpy as np

    n = 1000
    rows = {
        "trigger": np.full(n, 2**60, np.uint64), "phrase": np.full(n, 2**50, np.uint64), "doc": np.arange(n) * 64,
        "version": np.zeros(n, np.int64), "at": np.arange(n), "n": np.ones(n, np.int64),
    }
    own = [module.unpack([x]) for b, x in module.pack(rows, 8) if b < 8]
    beyond = [module.unpack([x]) for b, x in module.pack(rows, 8) if b >= 8]
    assert [(len(still["doc"]), len(done["doc"])) for still, done in own] == [(1, 0)]
    assert len(beyond) == 8 and sum(len(done["doc"]) for _, done in beyond) == n - 1 and not any(len(still["doc"]) for still, _ in beyond)
