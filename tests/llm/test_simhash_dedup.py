"""Operator 8 against plain fingerprints, all pairs and a plain union-find."""

from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from joulecorpus.llm.components import components
from joulecorpus.llm.simhash_dedup import links, simhash_components, simhash_links

SCHEMA = "doc_id bigint, text string, fp string, component_id int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_print(text: str | None) -> int:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs) -> dict:
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def brute(rows, distance=2):
    fps = [(i, plain_print(t)) for i, t, *_ in rows]
    distinct = sorted({f for _, f in fps})
    pairs = [(a, b) for a in distinct for b in distinct if a <= b and (a ^ b).bit_count() <= distance]
    of = plain_components(pairs)
    names: dict = {}
    for i, f in fps:
        if i is not None:
            names[of[f]] = min(names.get(of[f], i), i)
    return sorted(((i, f, names.get(of[f])) for i, f in fps), key=str)


def check(spark, rows):
    got = simhash_components(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got.collect()), key=str) == brute(rows)


def test_texts(spark):
    rng = random.Random(2)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(rng.randint(30, 200))] for _ in range(12)]
    rows = []
    for i in rng.sample(range(500), 120):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(["Zed", "été", "q"])
        rows.append((i, rng.choice([" ", "\n\t"]).join(words), None, 1))
    check(spark, rows)


def test_edge_cases(spark):
    rows = [
        (1, None, None, None), (2, "", "x", 1), (None, "A b c d", None, 2), (None, "only here now", None, 1), (5, "a B C d", None, 2),
        (5, "a b c d", None, 2), (6, "one", None, 1), (7, "one two", None, 1), (8, "ONE TWO", None, 1), (9, "w " * 30000, None, 0),
        (10, "É é", None, 0),
    ]
    check(spark, rows)
    assert simhash_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_links_connect_what_all_pairs_connect(spark):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(20)]
    fps = set()
    for _ in range(900):
        f = rng.choice(centres)
        for _ in range(rng.randint(0, 5)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    fps = sorted(fps)
    pairs = [(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if (a ^ b).bit_count() <= 2]
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp bigint").repartition(4)
    found = [(r.u % 2**64, r.v % 2**64) for r in simhash_links(df, 2).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    assert plain_components(found) == plain_components(pairs)


def test_one_dense_block_sends_few_links():
    rng = np.random.default_rng(0)
    fps = np.unique(rng.integers(0, 2**11, 3000).astype(np.uint64))
    u, v = links(np.zeros(len(fps), np.uint64), fps, 2)
    assert len(u) < 8 * len(fps)
    of = plain_components(list(zip(u.tolist(), v.tolist())))
    assert len(of) == len(fps) and set(of.values()) == {int(fps[0])}


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    edges += [(5000, 5001 + i) for i in range(50)] + [(7, 7), (8, 8)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == plain_components([e for e in edges if e[0] != e[1]])
