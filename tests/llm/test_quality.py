"""Operator 7: base rules against direct counts, ratios against plain counting, held-out accuracy."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from joulecorpus.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_rules(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked))


def texts() -> list:
    rng = random.Random(6)
    out: list = [None, "", "\n", "a", "\n\na\n\na\n \n", "日本 é#", "x\r\nx\r\nx", "w " * 40, "a b c d e f g h " * 3, "|" * 9]
    for _ in range(60):
        words = [rng.choice(["the", "été", "of", "x#", "\n", "日本"]) for _ in range(rng.randint(0, 120))]
        out.append(rng.choice([" ", "  ", "\t"]).join(words))
    return out


@pytest.mark.parametrize("limit", [1 << 20, 100])
def test_rules(limit, monkeypatch):
    monkeypatch.setattr(quality.A.row_ranges, "__defaults__", (limit,))
    got = quality.rules(pa.array(texts()))
    assert list(zip(*(got[n].tolist() for n in quality.RULES))) == [plain_rules(t) for t in texts()]


def test_grams_stay_within_rows(monkeypatch):
    data = [b"abcdefg", b"", b"ab", b"abc", b"abcdefg", b"xabcdefgx"]
    buffers = quality.A.text_buffers(pa.array([d.decode() for d in data]))
    for k, bucket, edges in quality.gram_buckets(*buffers):
        n = quality.LENGTHS[k]
        assert np.diff(edges).tolist() == [max(len(d) - n + 1, 0) for d in data]
        of = {}
        flat = [d[i : i + n] for d in data for i in range(len(d) - n + 1)]
        for gram, b in zip(flat, bucket.tolist(), strict=True):
            assert of.setdefault(gram, b) == b


def documents(spark, n=400):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(25, 90))]
        good = i % 4 != 0
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words), "x", 1))
        if i % 2 == 0:
            labels.append((i, int(good), 0))
    rows += [(9000, None, None, None), (None, rows[1][1], "x", None), (1, rows[1][1], "x", 1)]
    labels += [(None, 1, 0), (3, None, 0), (77777, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, kept string, score int"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = documents(spark)
    model = quality.fit(docs.repartition(3), labels)
    again = quality.fit(docs.repartition(5), labels)
    assert np.array_equal(model.ratios, again.ratios) and model.threshold == again.threshold
    out = quality.assess(docs, model)
    assert out.columns == ["doc_id", "text", *quality.RULES, "base_failed", "score", "kept"]
    rows = out.collect()
    assert len(rows) == 403
    for r in rows:
        assert r.kept == (r.doc_id != 9000 and (r.doc_id is None or r.doc_id % 4 != 0))
        assert tuple(r[n] for n in quality.RULES) == plain_rules(r.text)
    kept = quality.assess(docs, model, only_kept=True)
    assert kept.schema == docs.schema and kept.count() == sum(r.kept for r in rows)


def test_ratio_is_that_of_the_counts(spark):
    docs, labels = documents(spark, 40)
    model = quality.fit(docs, labels)
    known = sorted((r.doc_id, r.quality) for r in labels.collect() if r.doc_id is not None and r.quality is not None)
    raw = np.zeros((len(quality.LENGTHS), quality.BUCKETS))
    for r in docs.collect():
        for k, bucket, _ in quality.gram_buckets(*quality.A.text_buffers(pa.array([r.text], pa.string()))):
            raw[k] += np.bincount(bucket, minlength=quality.BUCKETS)
    logs = np.log((raw + 1) / (raw + 1).sum(axis=1, keepdims=True))
    assert known and np.allclose(np.exp(model.ratios / quality.SCALE + logs).sum(axis=1), 1, atol=1e-4)


def test_without_labels(spark):
    docs, labels = documents(spark, 20)
    model = quality.fit(docs, labels.limit(0))
    assert model.threshold == -np.inf
    rows = quality.assess(docs, model).collect()
    assert all(r.kept == (not r.base_failed) for r in rows)
    empty = quality.fit(docs.limit(0), labels)
    assert quality.assess(docs.limit(0), empty).collect() == []


def test_threshold():
    score, good = np.array([0.1, 0.2, 0.3, 0.3, 0.5]), np.array([False, False, True, False, True])
    assert quality.best_threshold(score, good) == 0.25
    assert quality.best_threshold(score, np.ones(5, bool)) == -np.inf
    assert quality.best_threshold(np.zeros(4), np.array([True, False, True, False])) == -np.inf
