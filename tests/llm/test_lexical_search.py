"""Operator 13 against plain scores of all documents, and against its SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest

from joulecorpus.llm import lexical_search as search

DOCS = "doc_id bigint, text string, item_id int, score string"
ITEMS = "item_id bigint, text string, bag binary"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, k=20):
    bags = [(i, Counter(words(t))) for i, t, *_ in docs if words(t)]
    count, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    queries: dict = {}
    for item, text, *_ in items:
        if item is not None:
            queries.setdefault(item, Counter()).update(words(text))
    out = []
    for item, query in queries.items():
        found = []
        for i, bag in bags:
            m = 75 + 25 * sum(bag.values()) * count // length
            gain = lambda t: math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m))
            score = sum(n * gain(t) for t, n in query.items() if t in bag)
            if i is not None and score > 0:
                found.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def check(spark, docs, items, **options):
    got = search.lexical_search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), **options)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == brute(docs, items, options.get("k", 20))


def corpus():
    random.seed(13)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünïcode", "数据", "X9"]
    text = lambda n: " ".join(random.choices(vocabulary, k=n))
    docs = [(i, text(random.randint(1, 40)), 1, "x") for i in range(200)]
    copied = text(15)
    docs += [(1000 - i, copied, None, None) for i in range(90)]  # one bag, a third of the rows, ids falling
    docs += [(5000 + i, copied.upper() + " zzz" * (i % 3), None, None) for i in range(30)]  # equal bags, other lengths
    return docs, [(i, text(random.randint(1, 12)), None) for i in range(25)] + [(99, copied + " " + copied, b"q")]


def test_against_brute_force(spark):
    docs, items = corpus()
    check(spark, docs, items)
    check(spark, docs, items, k=3)


def test_blocks_of_items_give_the_same_rows(spark):
    docs, items = corpus()
    check(spark, docs, items, block=40)


def test_small_tables_in_slices_of_one_class(spark, monkeypatch):
    monkeypatch.setattr(search, "CELLS", 1)
    docs, items = corpus()
    check(spark, docs[:40], items[:4], k=2)


def test_nulls_ties_repeats_and_long_texts(spark):
    docs = [(None, "alpha beta", 1, None), (1, None, 1, None), (2, "", 1, None), (3, "...", 1, None), (4, "alpha", 1, None), (4, "alpha", 1, None)]
    docs += [(7, "alpha gamma " * 50_000, 1, None), (6, "Alpha,BETA;beta", 1, None), (8, "delta", 1, None)]
    items = [(1, "ALPHA beta", None), (2, None, None), (3, "missing", None), (None, "alpha", None), (4, "beta", None), (4, "delta delta", None)]
    check(spark, docs, items)


@pytest.mark.parametrize("docs,items", [([], [(1, "a", None)]), ([(1, "a", 1, "b")], []), ([(1, None, 1, "b")], [(1, "a", None)])])
def test_empty_tables(spark, docs, items):
    check(spark, docs, items)


def test_oracle(spark):
    docs, items = corpus()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([d[:2] for d in docs], columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame([i[:2] for i in items], columns=["item_id", "text"]))
    assert sorted(con.execute(search.ORACLE).fetchall()) == brute(docs, items)
