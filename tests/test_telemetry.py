from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from joulecorpus.functions import energy
from joulecorpus.operators import telemetry

CURRENT = "run_id int, gpu_id int, ts double, name string, power_w double, temperature_c double, utilization_percent double, memory_used_mb double, error string"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_formulas(spark):
    lit = F.lit
    assert value(spark, energy.energy_efficiency(lit(10.0), lit(10), lit(0), lit(80.0))) == pytest.approx(1.25)
    assert value(spark, energy.energy_efficiency(lit(10.0), lit(5), lit(5), lit(80.0))) == float("inf")
    assert value(spark, energy.energy_efficiency(lit(10.0), lit(5), lit(0), lit(0.0))) == float("inf")
    assert value(spark, energy.efficiency_score(lit(0.5), lit(1000), lit(3600.0))) == pytest.approx(0.05)
    assert value(spark, energy.efficiency_score(lit(0.5), lit(0), lit(3600.0))) == 0
    assert value(spark, energy.efficiency_score(lit(0.5), lit(10), lit(0.0))) == 0
    assert value(spark, energy.carbon_kg(lit(1.0))) == 0.5
    assert value(spark, energy.carbon_kg(lit(0.5))) == 0.25


def test_legacy_and_current_fields(spark):
    schema = "run_id int, gpu_id int, ts double, power_w double, power_draw_w double, utilization_percent double, utilization_gpu_percent double, error string"
    rows = [
        (1, 0, 1.0, 100.0, 5.0, None, 7.0, None),
        (1, 0, 2.0, 0.0, 50.0, 0.0, 8.0, None),
        (1, 0, 3.0, None, None, None, None, None),
        (1, 0, 4.0, 9.0, None, None, None, "broken"),
    ]
    df = spark.createDataFrame(rows, schema)
    found = telemetry.unify_readings(df).orderBy("ts").collect()
    assert [(r["power"], r["utilization"], r["temperature"], r["name"]) for r in found] == [
        (100.0, 7.0, 0.0, "Unknown"),
        (50.0, 8.0, 0.0, "Unknown"),
        (0.0, 0.0, 0.0, "Unknown"),
    ]
    flagged = telemetry.unify_readings(df, errors="flag").orderBy("ts").collect()
    assert flagged[3]["power"] is None and flagged[3]["name"] is None


def test_legacy_units_floor(spark):
    df = spark.createDataFrame([(1500.0, 1048575.0, 2.5 * 1048576)], "power_mw double, memory_used_bytes double, memory_total_bytes double")
    assert tuple(telemetry.normalize_readings(df, legacy=True).first()) == (1.5, 0.0, 2.0)
    assert telemetry.normalize_readings(df).first()["memory_total_mb"] == 2.5


def test_baseline_and_statistics(spark):
    base = [(1, 0, float(t), "A", 50.0, 40.0, 1.0, 10.0, None) for t in range(5)]
    work = [(1, 0, 10.0 + t, "B", 150.0 + 5 * t, 60.0 + t, 50.0, 100.0, None) for t in range(5)]
    df = spark.createDataFrame(base + work, CURRENT)
    tagged = telemetry.tag_phase(df, 5.0)
    assert telemetry.baseline_power(tagged).first()["baseline_power_w"] == 50.0
    unified = telemetry.unify_readings(telemetry.monitored(tagged))
    row = telemetry.gpu_stats_full(unified, telemetry.run_facts(tagged)).first()
    hours = 4.0 / 3600
    assert row["power_avg_w"] == 160.0 and row["power_baseline_adjusted_w"] == 110.0
    assert row["energy_consumed_wh"] == pytest.approx(160.0 * hours)
    assert row["energy_consumed_kwh"] == pytest.approx(110.0 * hours / 1000)
    assert row["energy_consumed_baseline_adjusted_wh"] == pytest.approx(110.0 * hours)
    assert (row["name"], row["samples_count"], row["temperature_max_c"]) == ("B", 5, 64.0)


def test_power_below_the_baseline_counts_as_zero(spark):
    df = spark.createDataFrame([(1, 0, 0.0, "A", 90.0, 1.0, 1.0, 1.0, None), (1, 0, 9.0, "A", 10.0, 1.0, 1.0, 1.0, None)], CURRENT)
    tagged = telemetry.tag_phase(df, 5.0)
    row = telemetry.gpu_stats(telemetry.unify_readings(telemetry.monitored(tagged)), telemetry.run_facts(tagged)).first()
    assert row["power_baseline_adjusted_w"] == 0.0 and row["energy_consumed_wh"] == 0.0


def test_since_a_time(spark):
    df = spark.createDataFrame(
        [(1, 0, 1001.0, "A", 100.0, 0.0, 0.0, 0.0, None), (1, 0, 1005.0, "A", 150.0, 0.0, 0.0, 0.0, None),
         (1, 0, 1008.0, "A", 120.0, 0.0, 0.0, 0.0, None), (2, 0, 1001.0, "A", 1.0, 0.0, 0.0, 0.0, None)], CURRENT
    )
    runs = spark.createDataFrame([(1, None), (2, None)], "run_id int, baseline_power_w double")
    found = {r["run_id"]: r for r in telemetry.metrics_since(telemetry.unify_readings(df), runs, df, 1003.0, 1010.0).collect()}
    assert found[1]["duration_s"] == 7.0 and found[1]["power_avg_w"] == 135.0 and found[1]["error"] is None
    assert found[2]["error"] == telemetry.NO_DATA_IN_PERIOD and found[2]["total_samples"] == 0


def test_thousand_snapshots_and_an_empty_run(spark):
    rows = [(1, 0, float(i), "A", 150.0 + 0.1 * i, 1.0, 1.0, 1.0, None) for i in range(1000)]
    df = spark.createDataFrame(rows, CURRENT).withColumn("method", F.lit("pynvml"))
    runs = spark.createDataFrame([(1,), (2,)], "run_id int")
    markers = spark.createDataFrame([(1, 5.0)], "run_id int, ts double")
    found = {r["run_id"]: r for r in telemetry.run_summary(telemetry.run_facts(telemetry.tag_phase(df, 0.0)), runs, markers).collect()}
    assert found[1]["total_samples"] == 1000 and found[1]["monitoring_duration_s"] == 999.0
    assert found[1]["monitoring_method"] == "pynvml" and found[1]["sync_markers"] == 1
    assert found[2]["error"] == telemetry.NO_DATA and found[2]["total_samples"] == 0


def test_preferred_method(spark):
    rows = [(1, "nvitop"), (1, "pynvml"), (2, "nvitop"), (3, "nvidia_smi"), (3, "pynvml"), (4, "other")]
    df = spark.createDataFrame(rows, "run_id int, method string")
    found = {(r["run_id"], r["method"]) for r in telemetry.pick_method(df).collect()}
    assert found == {(1, "pynvml"), (2, "nvitop"), (3, "nvidia_smi"), (4, "other")}


def test_failed_runs_pass_through(spark):
    progress = spark.createDataFrame([(1, 3600.0, 1000, 3.0)], "run_id int, total_duration_s double, total_steps int, total_epochs double")
    totals = spark.createDataFrame([(1, 0.5, 550.0, 70.0)], "run_id int, total_energy_consumed_kwh double, avg_power_w double, max_temperature_c double")
    errors = spark.createDataFrame([(2, "none")], "run_id int, error string")
    found = {r["run_id"]: r for r in telemetry.final_metrics(totals, progress, errors).collect()}
    assert found[1]["energy_per_step_wh"] == 0.5 and found[1]["carbon_footprint_estimate_kg"] == 0.25
    assert found[2]["error"] == "none" and found[2]["total_steps"] is None


def test_advice(spark):
    df = spark.createDataFrame([(1, 0, 301.04, 80.0), (1, 1, 300.0, 80.06)], "run_id int, gpu_id int, power_avg_w double, temperature_max_c double")
    assert sorted(r["recommendation"] for r in telemetry.recommendations(df).collect()) == [
        "gpu_0: Alto consumo (301.0W) - considere otimização",
        "gpu_1: Temperatura alta (80.1°C) - verificar resfriamento",
    ]


def test_markers_get_an_empty_map(spark):
    df = spark.createDataFrame([(1, 1.0, "step", 100)], "run_id int, ts double, type string, step int")
    row = telemetry.sync_markers(df).first()
    assert row["metadata"] == {} and row["epoch"] is None and row["step"] == 100
    given = df.withColumn("metadata", F.create_map(F.lit("loss"), F.lit("0.5")))
    assert telemetry.sync_markers(given).first()["metadata"] == {"loss": "0.5"}


def test_sample_arrays_are_bounded_and_complete(spark):
    rows = [(1, g, float(t), f"G{g}", float(t), 1.0, 1.0, 1.0, None) for g in (0, 1) for t in range(300 if g else 20)]
    random.seed(2)
    random.shuffle(rows)
    arrays = telemetry.gpu_sample_arrays(telemetry.unify_readings(spark.createDataFrame(rows, CURRENT)), rows=64).collect()
    assert all(len(r["power_samples_w"]) <= 64 for r in arrays)
    for g, n in ((0, 20), (1, 300)):
        chunks = sorted((r["chunk"], r["power_samples_w"]) for r in arrays if r["gpu_id"] == g)
        assert [p for _, samples in chunks for p in samples] == [float(t) for t in range(n)]


@pytest.mark.parametrize("block_s", [1.0, 7.0, 1000.0])
def test_periods_equal_filtering(spark, block_s):
    random.seed(4)
    rows = [
        (random.choice([1, 1, 1, 2]), random.randint(0, 1), float(random.randint(0, 100)), "A", random.uniform(1, 99), 1.0, 2.0, 3.0, None)
        for _ in range(500)
    ]
    periods = [(1, "a", 10.0, 60.0), (1, "b", 30.0, 31.0), (1, "c", 5.0, 5.0), (2, "a", 0.0, 100.0), (1, "d", 200.0, 300.0)]
    unified = telemetry.unify_readings(spark.createDataFrame(rows, CURRENT))
    frame = spark.createDataFrame(periods, "run_id int, workload string, start_ts double, end_ts double")
    baselines = spark.createDataFrame([(1, 5.0), (2, None)], "run_id int, baseline_power_w double")
    found = {
        (r["run_id"], r["workload"], r["gpu_id"]): r
        for r in telemetry.period_stats(unified, frame, baselines, block_s).collect()
    }
    expected = {}
    for run, name, start, end in periods:
        for gpu in (0, 1):
            power = [r[4] for r in rows if r[0] == run and r[1] == gpu and start <= r[2] <= end]
            if power:
                expected[(run, name, gpu)] = power
    assert set(found) == set(expected)
    for key, power in expected.items():
        assert found[key]["power_avg_w"] == pytest.approx(sum(power) / len(power))
        assert found[key]["samples_count"] == len(power) and found[key]["power_min_w"] == min(power)


def test_most_efficient_workload(spark):
    df = spark.createDataFrame(
        [(1, "x", 10.0, 5.0), (1, "x", 10.0, 5.0), (1, "y", 10.0, 4.0), (1, "z", 0.0, 0.0)],
        "run_id int, workload string, duration_s double, energy_consumed_wh double",
    )
    found = {r["workload"]: r for r in telemetry.workload_compare(df).collect()}
    assert found["x"]["efficiency_wh_per_s"] == 1.0 and found["z"]["efficiency_wh_per_s"] == 0.0
    assert [w for w, r in found.items() if r["is_most_efficient"]] == ["z"]


def test_readings_of_nested_snapshots(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "m", [(0, None), (1, "bad")]), (1, 2.0, "m", [])],
        "run_id int, timestamp double, method string, gpus array<struct<gpu_id: int, error: string>>",
    )
    assert [(r["snapshot_ts"], r["gpu_id"]) for r in telemetry.explode_readings(df).collect()] == [(1.0, 0)]
