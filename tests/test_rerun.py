"""Outputs that are written again, several formats at once, and streams without data."""

from __future__ import annotations

from pyspark.sql import functions as F

from joulecorpus.sinks import writers
from joulecorpus.streaming import snapshots as streams


def test_a_run_without_rows_any_more_leaves_none(spark, tmp_path):
    path = str(tmp_path / "report")
    first = spark.createDataFrame([("a b", 1), ("c%d", 2), (None, 3), ("kept", 4)], "run_id string, v int")
    writers.write_report(first, path)
    writers.clear_runs(spark, path, spark.createDataFrame([("a b",), ("c%d",), (None,), ("new",)], "run_id string"))
    assert [tuple(r) for r in spark.read.json(path).select("run_id", "v").collect()] == [("kept", 4)]
    writers.clear_runs(spark, str(tmp_path / "absent"), first)


def test_several_formats_come_from_one_evaluation(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(20).select("id", *[F.lit("x").alias(n) for n in ("Texto", "Resumo", "Texto_clean", "Resumo_clean")], F.lit("train").alias("split"))
    paths = writers.save(rows.mapInArrow(counted, rows.schema), str(tmp_path), ["jsonl", "json", "csv", "parquet"])
    assert seen.value == 20 and len(paths) == 4
    assert spark.read.parquet(paths["parquet"]).count() == 20


def test_formats_are_replaced_and_the_rows_are_written_once_each(spark, tmp_path, monkeypatch):
    names = ("Texto", "Resumo", "Texto_clean", "Resumo_clean")
    formats = ["jsonl", "json", "csv", "parquet"]
    monkeypatch.setattr(writers, "as_table", lambda *_: 1 / 0)  # no copy beside the datasets
    for count in (20, 5):  # a second run replaces the first
        side = F.when(F.col("id") % 5 == 0, "007").when(F.col("id") % 5 == 1, None).otherwise("a b")
        rows = spark.range(count).select("id", *[F.lit("x").alias(n) for n in names], side.alias("split"))
        paths = writers.save(rows, str(tmp_path), formats)
        back = spark.read.schema(rows.schema).parquet(paths["parquet"])
        assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
        text = spark.read.schema("text string, split string").json(paths["jsonl"])
        assert sorted(str(r.split) for r in text.collect()) == sorted(str(r.split) for r in rows.collect())
        assert list(paths) == formats
        assert spark.read.json(paths["json"]).count() == spark.read.option("header", True).csv(paths["csv"]).count() == count
    monkeypatch.undo()
    writers.save(back.where("id < 3"), str(tmp_path), formats)  # rows that come from the datasets themselves
    assert spark.read.parquet(paths["parquet"]).count() == spark.read.json(paths["json"]).count() == 3


def test_streams_without_data_give_empty_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("k int, v int").parquet(str(tmp_path / "in"))
    table = streams.drain_append(stream, "empty", str(tmp_path / "p1"), str(tmp_path / "t1"))
    assert spark.read.schema(stream.schema).parquet(table).collect() == []
    grouped = stream.groupBy("k").agg(F.sum("v").alias("s"))
    out = streams.drain_update(grouped, ["k"], "empty", str(tmp_path / "p2"), str(tmp_path / "t2"))
    assert out.columns == ["k", "s"] and out.collect() == []
    spark.createDataFrame([(1, 2), (1, 3)], "k int, v int").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, v int").parquet(str(tmp_path / "in"))
    assert spark.read.parquet(streams.drain_append(stream, "empty", str(tmp_path / "p1"), str(tmp_path / "t1"))).count() == 2
