"""The pipeline's stages against the operators' brute-force versions, each on its own input."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from joulecorpus.llm.frames import bound_batches
from joulecorpus.llm.queries import ORACLES, QUERIES
from test_line_dedup import brute as brute_lines
from test_near_dedup import brute as brute_groups
from test_quality import plain_rules

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def good(text):
    words, _, _, _, repeated = plain_rules(text)
    return "!!" not in text and words >= 20 and 100 * repeated <= 30 * words


def rows_of():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "st"]) for _ in range(rng.randint(1, 4)))
    line = lambda: " ".join(word() for _ in range(rng.randint(6, 30)))
    shared = [line() for _ in range(4)]
    rows = []
    for i in range(160):
        text = "\n".join(rng.choice(shared) if rng.random() < 0.2 else line() for _ in range(rng.randint(2, 6)))
        if i % 10 == 3:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if i % 10 == 5 and rows:
            text = rows[rng.randrange(len(rows))][1]
        if i % 10 == 7 and rows:
            words = (rows[rng.randrange(len(rows))][1] or "").split(" ")
            words[rng.randrange(len(words))] = "new"
            text = " ".join(words)
        rows.append((i, text, "en", rng.choice(["a", "a", "b", None]), len(text)))
    return rows + [(500, None, None, None, None), (501, "", "en", "a", 0), (None, line() + "\n" + line(), "en", "b", 1), (2, rows[2][1], "en", "b", 9)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows_of(), SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    labels = [(r[0], int("!!" not in r[1]), 0) for r in rows_of()[:160]]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before, after = docs.collect(), out.collect()
        if k < 4:
            assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        if name == "quality_rules":
            assert set(after) <= set(before)
            assert {r.doc_id for r in after if r.doc_id is not None and r.doc_id < 160} == {r[0] for r in rows_of()[:160] if good(r[1])}
        elif name == "fuzzy_lines":
            want = brute_lines([(r.doc_id, r.text) for r in before])
            assert Counter((r.doc_id, r.text) for r in after) == Counter((i, t) for i, n, gone, t in want if len(gone) < n)
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "near_duplicates":
            assert set(after) <= set(before)
            want = brute_groups([(r.doc_id, r.text, None) for r in before])
            assert sorted((r.doc_id is None, r.doc_id or 0) for r in after) == want
        elif name == "source_mix":
            assert set(after) <= set(before) and max(Counter(after).values()) <= 3
        else:
            assert len(after) == len(before) and all(r.round_trip and r.n_tokens == len(r.tokens) for r in after)
        docs = out


def test_run_is_the_stages_in_order(spark, sf_dir):
    out = P.run(spark, sf_dir).select("doc_id", "n_tokens").collect()
    again = P.run(spark, sf_dir).select("doc_id", "n_tokens").collect()
    assert out and sorted(out, key=str) == sorted(again, key=str)


def test_stages_on_an_empty_table(spark, sf_dir):
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf_dir).collect() == []


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_texts_go_to_workers_in_batches_of_bounded_bytes(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    asked = spark.conf.get(name)
    docs = spark.range(0, 12000, 1, 1).select(F.repeat(F.lit("x"), 2000).alias("text"), F.lit(0).alias("n_chars"))
    monkeypatch.setattr(P.line_dedup, "without_repeated_lines", lambda docs: docs)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    try:
        out = P.fuzzy_lines(spark, docs, "")
        got = [r.size for r in out.mapInArrow(sizes, "size bigint").collect()]
        assert sum(got) > 12000 * 2000 and max(got) < 5 << 20
        spark.conf.set(name, "1000")  # a smaller one stays
        bound_batches(spark)
        assert spark.conf.get(name).rstrip("b") == "1000"
    finally:
        spark.conf.set(name, asked)
