"""Operator 3 against a plain loop, and its law at the edges."""

from __future__ import annotations

import hashlib
import re

import duckdb
import pytest

from joulecorpus.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, size string, target int"


def plain_targets(sizes: dict) -> dict:
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, free, rest = {}, list(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        share = {s: rest * weight[s] / total for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
            free.remove(s)
    return target


def rows_of():
    rows = []
    for i in range(300):
        source = ["b", "a", "é", None, "Z", "tiny", "b", "b"][i % 8]
        rows.append((i, "w " * (1 + i * 7 % 40) if source != "tiny" or i < 30 else "x", source, "clash", 1))
    return rows + [(1000, None, "a", None, None), (1001, "", "empty", None, None), (None, "a b", "a", None, None), (5, rows[5][1], "tiny", None, 2)]


@pytest.mark.parametrize("whole", [False, True])
def test_against_a_loop(spark, whole):
    rows = rows_of()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: dict = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = plain_targets(sizes)
    got = mixing.curriculum(spark.createDataFrame(rows, SCHEMA).repartition(3), whole=whole).collect()
    assert len(got) == len(rows)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-5 for r in own)
        slack = max(r.size for r in own) / 2 + 1 if whole else 1
        assert abs(sum(r.taken for r in own) - want[s]) <= slack
        own.sort(key=lambda r: (r.doc_id is None, hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.size, r.positions))
        firsts = [r.positions[0] for r in own if r.positions]
        assert firsts == sorted(firsts) and all(0 <= p <= 1 for r in own for p in r.positions)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    if whole:
        assert all(r.taken == r.size * len(r.positions) for r in got)


def test_demand_is_inverted(spark):
    from pyspark.sql import functions as F

    df = spark.range(0, 101).select((F.col("id") / 100).alias("x"))
    for slope in (0.5, -0.5):
        t = df.select("x", mixing.invert_demand(F.col("x"), F.lit(slope)).alias("t")).collect()
        assert all(abs(r.t + slope * (r.t * r.t - r.t) - r.x) < 1e-12 for r in t)


def test_mix_is_in_order_and_reruns_agree(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA)
    one, two = (mixing.mixed(d).collect() for d in (df.repartition(2), df.repartition(5)))
    assert one == two
    plan = mixing.curriculum(df, whole=True).collect()
    want = sorted((p, r.doc_id is not None, r.doc_id or 0) for r in plan for p in r.positions)
    assert [r.doc_id for r in one] == [i if known else None for _, known, i in want]
    assert set(one) <= set(df.collect())


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA)
    for out in (mixing.by_position(mixing.curriculum(df)), mixing.mixed(df)):
        assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def test_empty_and_wordless(spark):
    assert mixing.curriculum(spark.createDataFrame([], SCHEMA)).collect() == []
    got = mixing.curriculum(spark.createDataFrame([(1, "", None, None, 1), (2, None, "a", None, 1)], SCHEMA)).collect()
    assert [(r.taken, r.target, r.positions) for r in got] == [(0, 0.0, [])] * 2


def test_sql(spark, tmp_path):
    df = spark.createDataFrame(rows_of(), SCHEMA)
    df.coalesce(1).write.parquet(str(tmp_path / "documents"))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = sorted(duckdb.sql(mixing.ORACLE).fetchall(), key=str)
    got = mixing.curriculum(df).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got), key=str) == want
