"""Operator 4 against a direct search over all windows."""

from __future__ import annotations

import random
import re

from joulecorpus.llm import arrays
from joulecorpus.llm.span_dedup import span_dedup

SCHEMA = "doc_id bigint, text string, kept string, n int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows: list[tuple], window: int) -> list[tuple]:
    first: dict[tuple, tuple] = {}
    texts = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    for i, words in texts:
        if i is not None:
            for p in range(len(words) - window + 1):
                key = tuple(words[p : p + window])
                first[key] = min(first.get(key, (i, p)), (i, p))
    out = []
    for i, words in texts:
        gone = [False] * len(words)
        if i is not None:
            for p in range(len(words) - window + 1):
                if first[tuple(words[p : p + window])] < (i, p):
                    gone[p : p + window] = [True] * window
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def check(spark, rows, window=20):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in span_dedup(df, window=window).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[3], r[2])
    assert sorted(got, key=key) == sorted(brute(rows, window), key=key)


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = ["a", "the", "été", "of", "日本", "x1"]
    passages = [[rng.choice(words) for _ in range(rng.randint(10, 60))] for _ in range(10)]
    rows = []
    for i in range(150):
        parts: list[str] = []
        for _ in range(4):
            parts += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.3 and rows:
            parts = WORD.findall(rng.choice(rows)[1])
            parts.insert(rng.randint(0, len(parts)), "new")
        rows.append((rng.randint(0, 400), rng.choice([" ", "\n", " \t"]).join(parts) + rng.choice(["", " ", "\n"]), None, 1))
    check(spark, rows)


def test_edge_cases(spark):
    same = " ".join(f"w{i}" for i in range(25))
    rows = [
        (1, None, None, None), (2, "", "k", 1), (None, same, None, 2), (3, same, None, 3), (3, same, None, 3), (3, same + " !", None, 0),
        (4, same, None, 4), (5, "one two", None, 5), (7, "a " * 300, None, 0), (8, "a " * 50 + "b", None, 0), (9, "\n\n\v", None, 0),
        (-9, "  " + " ".join(f"w{i}" for i in range(20)), None, 0), (10, "x" * 5000, None, 0), (11, same + " " + same, None, 0),
    ]
    check(spark, rows)


def test_empty_table(spark):
    assert span_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(arrays, "PIECE", 64)
    monkeypatch.setattr(arrays.row_ranges, "__defaults__", (200,))
    import numpy as np
    import pyarrow as pa

    from joulecorpus.llm.span_dedup import paths

    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcd") * rng.randint(1, 9) for _ in range(n)) for n in (3, 200, 19, 20, 21, 90)]
    parts = list(paths(pa.array(texts), np.arange(6), np.zeros(6, int), 20, 5))
    covered = [(int(d), int(a) + k) for x in parts for d, a, n in zip(x[2], x[4], x[5]) for k in range(n)]
    assert sorted(covered) == [(i, p) for i, t in enumerate(texts) for p in range(len(t.split()) - 19)]
