"""The maintained table of readings: one scan, only changed parts, and the same figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from joulecorpus.config import SyncConfig
from joulecorpus.operators import partials, telemetry
from joulecorpus.plans import energy_job
from joulecorpus.session import path_exists
from tests.test_sync import make

CONFIG = SyncConfig(interval_s=4.0, logging_steps=5, baseline_s=2.0)
NAMES = ("gpu_stats", "run_summary", "final_metrics", "interval_metrics", "step_metrics", "metrics_long")


def rows(df):
    rounded = df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("string").alias(c) for c, t in df.dtypes])
    return sorted(map(tuple, rounded.collect()), key=repr)


def parted(spark):
    _, readings, steps, starts = make(spark)
    readings = readings.withColumn("method", F.lit("pynvml")).withColumn("hour", F.floor(F.col("ts") / 3).cast("int"))
    return readings.unionByName(readings.where("ts % 2 < 1")), steps, steps.where("step % 20 = 0").withColumn("type", F.lit("training_step")), starts


def tables(readings, steps, markers, starts):
    return energy_job.tables_of_partials(readings, steps, markers, starts, CONFIG)


def test_partials_are_the_readings(spark):
    readings, *_ = parted(spark)
    kept = partials.reading_partials(readings)
    assert kept.agg(F.sum("copies")).first()[0] == readings.count() and kept.count() < readings.count()
    flagged = telemetry.unify_readings(readings, errors="flag")
    assert rows(partials.expanded(kept).select(*flagged.columns)) == rows(flagged)


def test_weighed_figures_equal_those_of_single_readings(spark):
    readings, *_ = parted(spark)
    own = telemetry.tag_phase(readings, CONFIG.baseline_s)
    slim = telemetry.tag_phase(partials.reading_partials(readings), CONFIG.baseline_s)
    assert rows(telemetry.run_facts(slim)) == rows(telemetry.run_facts(own))
    facts = telemetry.run_facts(own)
    want = telemetry.gpu_stats_full(telemetry.unify_readings(telemetry.monitored(own)), facts)
    assert rows(telemetry.gpu_stats_full(telemetry.monitored(slim).where("not failed"), facts)) == rows(want)


def test_the_job_scans_the_raw_readings_once(spark, tmp_path):
    readings, steps, markers, starts = parted(spark)
    readings.drop("hour").write.parquet(str(tmp_path / "raw"))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    raw = spark.read.parquet(str(tmp_path / "raw"))
    seen = raw.mapInArrow(counted, raw.schema)
    found = energy_job.energy_tables(seen, steps, markers, starts, CONFIG)
    energy_job.energy_job(found, str(tmp_path / "out"))
    assert read.value == readings.count()


def test_only_changed_parts_are_read(spark, tmp_path):
    readings, steps, markers, starts = parted(spark)
    source, table = str(tmp_path / "raw"), str(tmp_path / "kept")
    hours = sorted(r.hour for r in readings.select("hour").distinct().collect())
    assert len(hours) > 2
    write = lambda df, mode="append": df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("hour").parquet(source)
    write(readings.where(F.col("hour") != hours[-1]))
    assert partials.refresh(spark, source, table) == partials.Refreshed(tuple(map(str, sorted(hours[:-1], key=str))), ())
    assert partials.refresh(spark, source, table) == partials.Refreshed((), ())
    write(readings.where(F.col("hour") == hours[-1]))
    assert partials.refresh(spark, source, table).read == (str(hours[-1]),)
    whole = partials.reading_partials(readings)
    assert rows(partials.maintained(spark, table)) == rows(whole.select(*partials.KEYS, *partials.VALUES, "copies"))
    mine, want = tables(partials.maintained(spark, table), steps, markers, starts), tables(whole, steps, markers, starts)
    assert all(rows(mine[name]) == rows(want[name]) for name in NAMES)
    # More readings for a known hour replace its partials, and an hour that is gone loses them.
    write(readings.where(F.col("hour") == hours[0]))
    assert partials.refresh(spark, source, table).read == (str(hours[0]),)
    twice = readings.unionByName(readings.where(F.col("hour") == hours[0]))
    assert rows(partials.maintained(spark, table)) == rows(partials.reading_partials(twice).select(*partials.KEYS, *partials.VALUES, "copies"))
    from joulecorpus.session import remove_path

    remove_path(spark, f"{source}/hour={hours[1]}")
    assert partials.refresh(spark, source, table) == partials.Refreshed((), (str(hours[1]),))
    assert not path_exists(spark, f"{table}/partials/hour={hours[1]}")
    left = twice.where(F.col("hour") != hours[1])
    assert partials.maintained(spark, table).agg(F.sum("copies")).first()[0] == left.count()


def test_many_changed_parts_and_rows_without_a_part(spark, tmp_path, monkeypatch):
    readings, *_ = parted(spark)
    source, table = str(tmp_path / "raw"), str(tmp_path / "kept")
    readings.withColumn("hour", F.nullif("hour", F.lit(1))).write.partitionBy("hour").parquet(source)
    assert None in partials.refresh(spark, source, table).read
    assert partials.maintained(spark, table).agg(F.sum("copies")).first()[0] == readings.count()
    monkeypatch.setattr(partials, "NAMED_PARTS", 0)
    readings.where("hour = 0").write.mode("append").partitionBy("hour").parquet(source)
    assert partials.refresh(spark, source, table).read == ("0",)
    assert partials.maintained(spark, table).agg(F.sum("copies")).first()[0] == readings.count() + readings.where("hour = 0").count()
