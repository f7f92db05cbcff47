"""The registered queries as DuckDB SQL over the same tables, written independently."""

from __future__ import annotations

# Fixed values, stated here anew so that a wrong key in the code under test shows.
TOKEN_PATTERN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"
INTERVAL_KEYS = {
    "timestamp": "timestamp",
    "step": "step",
    "epoch": "epoch",
    "power_avg_w": "power_avg_w",
    "power_max_w": "power_max_w",
    "power_min_w": "power_min_w",
    "energy_consumed_wh": "energy_consumed_wh",
    "temperature_avg_c": "temperature_avg_c",
    "temperature_max_c": "temperature_max_c",
    "gpu_utilization_avg_percent": "utilization_avg_percent",
    "memory_used_avg_mb": "memory_used_avg_mb",
    "duration_s": "duration_s",
    "samples_count": "samples_count",
    "efficiency_wh_per_step": "efficiency_wh_per_step",
}
STEP_KEYS = {
    "step": "step",
    "epoch": "epoch",
    "power_avg_w": "power_avg_w",
    "energy_per_step_wh": "energy_per_step_wh",
    "temperature_avg_c": "temperature_avg_c",
    "gpu_utilization_avg_percent": "utilization_avg_percent",
    "memory_used_avg_mb": "memory_used_avg_mb",
    "energy_efficiency": "energy_efficiency",
}
_FINAL = (
    "total_duration_s total_steps total_epochs total_energy_consumed_kwh avg_power_w max_temperature_c "
    "energy_per_step_wh energy_per_epoch_kwh energy_efficiency_score carbon_footprint_estimate_kg"
)
FINAL_KEYS = {name: name for name in _FINAL.split()}
FINAL_TEXT_KEYS = {"summary": "summary_text"}
FAILED_TEXT_KEYS = {"monitoring_error": "error", "monitoring_method": "monitoring_method", "final_energy/error": "error"}
RUN_KEYS = {"monitoring_duration_s": "monitoring_duration_s", "total_samples": "total_samples"}
RUN_TEXT_KEYS = {"monitoring_method": "monitoring_method"}
GPU_KEYS = {"power_avg_w": "power_avg_w", "energy_consumed_kwh": "energy_consumed_kwh"}
GPU_TEXT_KEYS = {"gpu_name": "name"}
SUMMARY_LINES = (
    "🔋 RELATÓRIO ENERGÉTICO FINAL:",
    "• Duração: %.0fs (%.2fh)",
    "• Steps: %d",
    "• Épocas: %.2f",
    "• Energia total: %.4f kWh",
    "• Potência média: %.1fW",
    "• Energia por step: %.2fWh",
    "• Energia por época: %.4fkWh",
    "• Score de eficiência: %.4f",
    "• Pegada de carbono estimada: %.6fkg CO2",
)

# Named sub-queries, each after the ones it reads.
VIEWS = {
    "events_t": "SELECT *, epoch_us(ts) / 1e6 AS t, cast(props->>'$.k' AS int) AS K FROM events",
    "pairs": """
SELECT doc_id, concat('P', cast(doc_id AS varchar)) AS Processo,
  CASE WHEN doc_id % 17 = 0 THEN NULL ELSE replace(text, chr(10), concat('_x000D_', chr(10))) END AS Texto,
  CASE WHEN doc_id % 23 = 0 THEN NULL ELSE split_part(text, chr(10), 1) END AS Resumo
FROM documents""",
    "qa_pairs": """
SELECT conv_id, turn, text AS Texto, summary AS Resumo FROM (
  SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS summary,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nrole FROM conversations) q
WHERE role = 'user' AND nrole = 'assistant'""",
    "telemetry": """
SELECT event_id, user_id % 3 AS run_id, user_id % 4 AS gpu_id, concat('GPU', cast(user_id % 4 AS varchar)) AS name, t AS ts,
  CASE WHEN user_id % 2 = 0 THEN 'nvidia_smi' ELSE 'pynvml' END AS method,
  CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE value END AS power_w,
  CASE WHEN event_type = 'view' THEN value END AS power_draw_w,
  CASE WHEN event_type = 'error' THEN 'device error' END AS error,
  cast(K AS double) AS utilization_percent, 40.0::DOUBLE + cast(K AS double) / 4 AS temperature_c,
  1000.0::DOUBLE + 10 * cast(K AS double) AS memory_used_mb, event_type = 'purchase' AS is_step
FROM events_t""",
    "steps": """
SELECT run_id, ts, event_id, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS step,
  cast(row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS double) / 100 AS epoch
FROM telemetry WHERE is_step""",
    "smi_lines": """
SELECT event_id, run_id, ts, CASE WHEN event_id % 101 = 0 THEN 'invalid data format' ELSE concat_ws(', ',
  cast(gpu_id AS varchar), name,
  CASE WHEN error IS NOT NULL THEN '[N/A]' ELSE cast(coalesce(power_w, power_draw_w) AS varchar) END,
  cast(cast(floor(temperature_c) AS int) AS varchar), cast(cast(floor(utilization_percent) AS int) AS varchar),
  '4096', '8192') END AS line
FROM telemetry""",
    "markers": "SELECT run_id, ts, 'training_step' AS type, step, epoch FROM steps WHERE step % 50 = 0",
    "periods": """
SELECT run_id, concat('w', cast(floor(step / 100) AS int)) AS workload, min(ts) AS start_ts, max(ts) AS end_ts
FROM steps GROUP BY run_id, concat('w', cast(floor(step / 100) AS int))""",
    "long_periods": """
SELECT run_id, concat(workload, '-all') AS workload, start_ts, max(end_ts) OVER (PARTITION BY run_id) AS end_ts FROM periods
UNION ALL SELECT run_id, concat(workload, '-half'), start_ts, (start_ts + max(end_ts) OVER (PARTITION BY run_id)) / 2 FROM periods""",
    "starts": "SELECT run_id, min(ts) AS start_ts FROM telemetry GROUP BY run_id",
    # Cleaning on this corpus: its only white space is space and line feed.
    "cleaned": r"""
SELECT *, trim(regexp_replace(replace(coalesce(Texto, ''), '_x000D_', chr(10)), '\s+', ' ', 'g')) AS Texto_clean,
  trim(regexp_replace(replace(coalesce(Resumo, ''), '_x000D_', chr(10)), '\s+', ' ', 'g')) AS Resumo_clean
FROM pairs""",
    "kept": """
SELECT * FROM cleaned WHERE Texto IS NOT NULL AND Resumo IS NOT NULL
  AND length(Texto_clean) BETWEEN 50 AND 50000 AND length(Resumo_clean) BETWEEN 10 AND 5000""",
    "hashed": """
SELECT *, ('0x' || substr(md5(concat(cast(doc_id AS varchar), ':42')), 1, 8))::BIGINT::DOUBLE / 4294967296 AS share FROM kept""",
    "sided": """
SELECT *, CASE WHEN share < 0.2::DOUBLE THEN 'test'
  WHEN share < 0.2::DOUBLE + (1 - 0.2::DOUBLE) * 0.1::DOUBLE THEN 'validation' ELSE 'train' END AS split FROM hashed""",
    "unified": """
SELECT event_id, run_id, gpu_id, ts, coalesce(name, 'Unknown') AS name,
  coalesce(nullif(power_w, 0), power_draw_w, 0) AS power, coalesce(utilization_percent, 0) AS utilization,
  coalesce(temperature_c, 0) AS temperature, coalesce(memory_used_mb, 0) AS memory_used
FROM telemetry WHERE error IS NULL""",
    "monitored": "SELECT t.* FROM telemetry t JOIN starts USING (run_id) WHERE t.ts >= start_ts + 86400",
    "unified_monitored": "SELECT u.* FROM unified u JOIN starts USING (run_id) WHERE u.ts >= start_ts + 86400",
    "baseline": """
SELECT run_id, avg(power_w) FILTER (WHERE ts < start_ts + 86400 AND error IS NULL) AS baseline_power_w
FROM telemetry JOIN starts USING (run_id) GROUP BY run_id""",
    "facts": """
SELECT run_id, max(ts) - min(ts) AS duration_s, count(DISTINCT ts) AS total_samples, any_value(baseline_power_w) AS baseline_power_w
FROM monitored JOIN baseline USING (run_id) GROUP BY run_id""",
    "stats": """
SELECT run_id, gpu_id, avg(power) AS power_avg_w, max(power) AS power_max_w, min(power) AS power_min_w,
  max_by(name, ts) AS name, count(*) AS samples_count, avg(temperature) AS temperature_avg_c,
  max(temperature) AS temperature_max_c, avg(utilization) AS utilization_avg_percent,
  avg(memory_used) AS memory_used_avg_mb, max(utilization) AS utilization_max_percent,
  max(memory_used) AS memory_used_max_mb,
  greatest(0, avg(power) - coalesce(any_value(baseline_power_w), 0)) AS power_baseline_adjusted_w,
  any_value(duration_s) / 3600 AS h
FROM unified_monitored JOIN facts USING (run_id) GROUP BY run_id, gpu_id""",
    "totals": """
SELECT run_id, sum(power_baseline_adjusted_w * h / 1000) AS total_energy_consumed_kwh, sum(power_avg_w) AS avg_power_w,
  max(temperature_max_c) AS max_temperature_c FROM stats GROUP BY run_id""",
    "progress": """
SELECT run_id, max(t.ts) - min(t.ts) AS total_duration_s,
  (SELECT max(step) FROM steps s WHERE s.run_id = t.run_id) AS total_steps,
  (SELECT max(epoch) FROM steps s WHERE s.run_id = t.run_id) AS total_epochs
FROM telemetry t GROUP BY run_id""",
    "final": """
SELECT run_id, total_duration_s, total_steps, total_epochs, total_energy_consumed_kwh, avg_power_w, max_temperature_c,
  total_energy_consumed_kwh * 1000 / greatest(1, total_steps) AS energy_per_step_wh,
  total_energy_consumed_kwh / greatest(1.0::DOUBLE, total_epochs) AS energy_per_epoch_kwh,
  CASE WHEN total_steps = 0 OR total_duration_s = 0 THEN 0 ELSE
    round_even((total_energy_consumed_kwh * 1000 / total_steps)
      / greatest(1.0::DOUBLE, (total_steps / (total_duration_s / 3600)) / 100), 4) END AS energy_efficiency_score,
  round_even(total_energy_consumed_kwh * 0.5::DOUBLE, 6) AS carbon_footprint_estimate_kg
FROM progress JOIN totals USING (run_id)""",
    "run_method": """
SELECT run_id, min_by(method, CASE method WHEN 'nvidia_smi' THEN 1 WHEN 'pynvml' THEN 2 ELSE 3 END) AS method
FROM monitored GROUP BY run_id""",
    "registered": "SELECT DISTINCT user_id % 4 AS run_id FROM events",
    "summary": """
SELECT r.run_id, CASE WHEN f.run_id IS NULL THEN 'Nenhum dado coletado' END AS error, m.method AS monitoring_method,
  coalesce(f.duration_s, 0) AS monitoring_duration_s, coalesce(f.total_samples, 0) AS total_samples,
  1.0::DOUBLE AS sampling_interval_s, b.baseline_power_w,
  (SELECT count(*) FROM markers k WHERE k.run_id = r.run_id) AS sync_markers, true AS high_precision_enabled
FROM registered r LEFT JOIN facts f USING (run_id) LEFT JOIN run_method m USING (run_id) LEFT JOIN baseline b USING (run_id)""",
    "timed_steps": """
SELECT s.run_id, s.step, s.ts, s.epoch, m.ts AS last_ok
FROM steps s ASOF LEFT JOIN (SELECT run_id, ts FROM monitored WHERE error IS NULL) m
  ON s.run_id = m.run_id AND s.ts >= m.ts""",
    "walk": """
SELECT run_id, 0::BIGINT AS step, start_ts AS ts, 0::DOUBLE AS epoch, start_ts AS last_sync, 0::BIGINT AS last_step,
  false AS by_time, false AS by_step, false AS fired, start_ts AS sync_after, 0::BIGINT AS step_after FROM starts
UNION ALL
SELECT run_id, step, ts, epoch, last_sync, last_step, by_time, by_step, fired,
  CASE WHEN fired AND by_time THEN ts ELSE last_sync END, CASE WHEN fired THEN step ELSE last_step END
FROM (SELECT s.run_id, s.step, s.ts, s.epoch, w.sync_after AS last_sync, w.step_after AS last_step,
    s.ts - w.sync_after >= 86400 AS by_time, s.step % 10 = 0 AS by_step,
    (s.ts - w.sync_after >= 86400 OR s.step % 10 = 0) AND coalesce(s.last_ok >= w.sync_after, false) AS fired
  FROM walk w JOIN timed_steps s ON s.run_id = w.run_id AND s.step = w.step + 1) q""",
    "fired": "SELECT run_id, step, ts, epoch, last_sync, last_step, by_time, by_step FROM walk WHERE fired",
    "snapshot_counts": """
SELECT f.run_id, f.step, count(DISTINCT m.ts) AS samples_count,
  count(DISTINCT CASE WHEN m.error IS NULL THEN m.ts END) AS usable
FROM fired f JOIN monitored m ON m.run_id = f.run_id AND m.ts BETWEEN f.last_sync AND f.ts GROUP BY f.run_id, f.step""",
    "windows": """
SELECT f.run_id, f.ts AS timestamp, f.step, f.epoch, avg(u.power) AS power_avg_w, max(u.power) AS power_max_w,
  min(u.power) AS power_min_w, avg(u.power) * ((f.ts - f.last_sync) / 3600) AS energy_consumed_wh,
  avg(u.temperature) AS temperature_avg_c, max(u.temperature) AS temperature_max_c,
  avg(u.utilization) AS utilization_avg_percent, avg(u.memory_used) AS memory_used_avg_mb,
  string_agg(DISTINCT u.name, ', ' ORDER BY u.name) AS gpu_name, f.ts - f.last_sync AS duration_s,
  any_value(c.samples_count) AS samples_count,
  sum(u.power) / any_value(c.usable) * ((f.ts - f.last_sync) / 3600) AS energy_all_gpus_wh,
  f.last_sync, f.last_step, f.by_time, f.by_step
FROM fired f JOIN unified_monitored u ON u.run_id = f.run_id AND u.ts BETWEEN f.last_sync AND f.ts
  JOIN snapshot_counts c ON c.run_id = f.run_id AND c.step = f.step
GROUP BY f.run_id, f.ts, f.step, f.epoch, f.last_sync, f.last_step, f.by_time, f.by_step""",
    "intervals": """
SELECT *, energy_consumed_wh / greatest(1, step - last_step) AS efficiency_wh_per_step FROM windows WHERE by_time""",
    "logged": """
SELECT *, energy_consumed_wh / greatest(1, step - last_step) AS energy_per_step_wh,
  CASE WHEN step <= last_step OR utilization_avg_percent <= 0 THEN 'inf'::DOUBLE
    ELSE energy_consumed_wh / (step - last_step) / greatest(0.01::DOUBLE, utilization_avg_percent / 100) END AS energy_efficiency
FROM windows WHERE by_step""",
    "gpu_full": """
SELECT run_id, gpu_id, power_avg_w, power_max_w, power_min_w, name, samples_count, temperature_avg_c, temperature_max_c,
  utilization_avg_percent, memory_used_avg_mb, utilization_max_percent, memory_used_max_mb, power_baseline_adjusted_w,
  power_avg_w * h AS energy_consumed_wh, power_baseline_adjusted_w * h / 1000 AS energy_consumed_kwh,
  power_baseline_adjusted_w * h AS energy_consumed_baseline_adjusted_wh,
  power_baseline_adjusted_w * h / 1000 AS energy_consumed_baseline_adjusted_kwh FROM stats""",
}


def _keyed(view: str, prefix: str, keys: dict[str, str], step: str, text: bool = False) -> str:
    """One SELECT per metric name of a namespace."""
    kind = "NULL::DOUBLE AS value, cast({c} AS varchar) AS text" if text else "cast({c} AS DOUBLE) AS value, NULL::VARCHAR AS text"
    return "\nUNION ALL ".join(
        f"SELECT run_id, {step} AS step, concat({prefix}, '{key}') AS key, {kind.format(c=column)} FROM {view}"
        for key, column in keys.items()
    )


_SUMMARY_TEXT = "printf('" + "\n".join(SUMMARY_LINES) + """', total_duration_s, total_duration_s / 3600, total_steps, total_epochs,
  total_energy_consumed_kwh, avg_power_w, energy_per_step_wh, energy_per_epoch_kwh, energy_efficiency_score,
  carbon_footprint_estimate_kg)"""

VIEWS["told"] = f"SELECT *, {_SUMMARY_TEXT} AS summary_text FROM final"
VIEWS["done"] = "SELECT * FROM summary WHERE error IS NULL"
VIEWS["failed"] = """
SELECT run_id, error, coalesce(monitoring_method, 'unknown') AS monitoring_method FROM summary WHERE error IS NOT NULL"""

_NO_STEP = "NULL::BIGINT"
_GPU = "'energy/gpu_', cast(gpu_id AS varchar), '/'"
VIEWS["long_rows"] = "\nUNION ALL ".join(
    [
        _keyed("intervals", "'energy_interval/'", INTERVAL_KEYS, "step"),
        _keyed("logged", "'energy_step/'", STEP_KEYS, "step"),
        _keyed("told", "'final_energy/'", FINAL_KEYS, _NO_STEP),
        _keyed("told", "'final_energy/'", FINAL_TEXT_KEYS, _NO_STEP, text=True),
        _keyed("done", "'energy/'", RUN_KEYS, _NO_STEP),
        _keyed("done", "'energy/'", RUN_TEXT_KEYS, _NO_STEP, text=True),
        _keyed("failed", "''", FAILED_TEXT_KEYS, _NO_STEP, text=True),
        _keyed("gpu_full", _GPU, GPU_KEYS, _NO_STEP),
        _keyed("gpu_full", _GPU, GPU_TEXT_KEYS, _NO_STEP, text=True),
    ]
)

READS = {
    "telemetry": ["events_t"],
    "steps": ["telemetry"],
    "smi_lines": ["telemetry"],
    "markers": ["steps"],
    "periods": ["steps"],
    "long_periods": ["periods"],
    "starts": ["telemetry"],
    "cleaned": ["pairs"],
    "kept": ["cleaned"],
    "hashed": ["kept"],
    "sided": ["hashed"],
    "unified": ["telemetry"],
    "monitored": ["telemetry", "starts"],
    "unified_monitored": ["unified", "starts"],
    "baseline": ["telemetry", "starts"],
    "facts": ["monitored", "baseline"],
    "stats": ["unified_monitored", "facts"],
    "totals": ["stats"],
    "progress": ["telemetry", "steps"],
    "final": ["progress", "totals"],
    "run_method": ["monitored"],
    "summary": ["registered", "facts", "run_method", "baseline", "markers"],
    "timed_steps": ["steps", "monitored"],
    "walk": ["starts", "timed_steps"],
    "fired": ["walk"],
    "snapshot_counts": ["fired", "monitored"],
    "windows": ["fired", "unified_monitored", "snapshot_counts"],
    "intervals": ["windows"],
    "logged": ["windows"],
    "gpu_full": ["stats"],
    "told": ["final"],
    "done": ["summary"],
    "failed": ["summary"],
    "long_rows": ["intervals", "logged", "told", "done", "failed", "gpu_full"],
}


def _closure(names: list[str]) -> list[str]:
    wanted: set[str] = set()

    def visit(name: str) -> None:
        for needed in READS.get(name, []):
            visit(needed)
        wanted.add(name)

    for name in names:
        visit(name)
    return [name for name in VIEWS if name in wanted]


def over(views: str, body: str) -> str:
    """``body`` with the named views, and all they read, as common table expressions."""
    parts = [f"{name} AS {'' if name == 'walk' else 'MATERIALIZED '}({VIEWS[name]})" for name in _closure(views.split())]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


def rounded(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({name.strip()} + 1e-9::DOUBLE, {digits}) AS {name.strip()}" for name in columns.split(","))


def _tokens(column: str) -> str:
    return f"regexp_extract_all(coalesce({column}, ''), '{TOKEN_PATTERN}')"


def _count_tokens(column: str) -> str:
    return f"len({_tokens(column)})"


_PROMPT = "concat('Summarize:', chr(10), {c}, chr(10), 'Summary:')"


def _padded(column: str) -> tuple[str, str]:
    ids = (
        f"list_transform(list_slice({_tokens(_PROMPT.format(c=column))}, 1, 512), "
        "lambda x: (('0x' || substr(md5(x), 1, 8))::BIGINT % 32000 + 1)::INT)"
    )
    mask = f"list_transform({ids}, lambda x: 1)"
    return (
        f"array_to_string(list_resize({ids}, 512, 0), ',')",
        f"array_to_string(list_resize({mask}, 512, 0), ',')",
    )


_INPUT_IDS, _MASK = _padded("Texto_clean")

_GPU_BASE = "power_avg_w, power_max_w, power_min_w, temperature_avg_c, temperature_max_c, utilization_avg_percent, memory_used_avg_mb, power_baseline_adjusted_w"
_WINDOW_NUMBERS = (
    "timestamp, epoch, power_avg_w, power_max_w, power_min_w, energy_consumed_wh, temperature_avg_c, temperature_max_c, "
    "utilization_avg_percent, memory_used_avg_mb, duration_s, last_sync"
)
_TUMBLING = "power_avg_w, power_max_w, power_min_w, temperature_avg_c, temperature_max_c, utilization_avg_percent, memory_used_avg_mb, energy_consumed_wh"

_LENGTHS = ", ".join(
    f"round({f}(length({column})) + 1e-9::DOUBLE, 6) AS {prefix}_{name}_length"
    for column, prefix in (("Texto_clean", "text"), ("Resumo_clean", "summary"))
    for f, name in (("avg", "mean"), ("median", "median"))
) + ", " + ", ".join(
    f"{f}(length({column})) AS {prefix}_{f}_length"
    for column, prefix in (("Texto_clean", "text"), ("Resumo_clean", "summary"))
    for f in ("min", "max")
)


def _split(source: str, key: str, partition: str = "") -> str:
    by = f"PARTITION BY {partition}" if partition else ""
    return f"""
SELECT *, row_number() OVER ({by} ORDER BY md5(concat(cast({key} AS varchar), ':42')), {key}) AS place,
  ceil(0.2::DOUBLE * count(*) OVER ({by})) AS n_test, count(*) OVER ({by}) AS n FROM {source}"""


_SIDE = """CASE WHEN place <= n_test THEN 'test'
  WHEN place <= n_test + ceil(0.1::DOUBLE * (n - n_test)) THEN 'validation' ELSE 'train' END AS split"""

_ARTIFACTS = "Texto"
for _debris, _meaning in (
    ("'_x000D_'", "chr(10)"), ("'_x000A_'", "chr(10)"), ("'_x0009_'", "chr(9)"), ("'â€™'", "''''"),
    ("'â€œ'", "'\"'"), ("concat('â€', chr(157))", "'\"'"), ("'â€\"'", "'—'"),
):
    _ARTIFACTS = f"replace({_ARTIFACTS}, {_debris}, {_meaning})"

# The same words become debris and are then restored to what the debris means.
_RESTORED = "replace(Texto, '_x000D_', chr(10))"
for _word, _meaning in (
    ("'the'", "chr(10)"), ("'von'", "chr(9)"), ("'de '", "''''"), ("'of'", "'\"'"), ("'und'", "'\"'"), ("'que'", "'—'"),
):
    _RESTORED = f"replace({_RESTORED}, {_word}, {_meaning})"

_CLEAN = r"trim(regexp_replace({c}, '\s+', ' ', 'g'))"

_ORDERS = """(SELECT o_orderkey, o_totalprice::DOUBLE / 7 AS kwh, o_custkey % 50 AS steps,
  (o_orderkey % 7) * 3600.0::DOUBLE AS seconds, o_orderkey % 60 AS last FROM orders) q"""

_COMPARED = """SELECT run_id, workload, round(duration_s + 1e-9::DOUBLE, 6) AS duration_s, round(wh + 1e-9::DOUBLE, 6) AS energy_wh,
  round(CASE WHEN duration_s > 0 THEN wh / duration_s ELSE 0 END + 1e-9::DOUBLE, 6) AS efficiency_wh_per_s,
  row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN duration_s > 0 THEN wh / duration_s ELSE 0 END, workload) = 1
    AS is_most_efficient
FROM (SELECT run_id, workload, max(d) AS duration_s, sum(greatest(0, p - b) * d / 3600) AS wh
  FROM (SELECT p.run_id, p.workload, u.gpu_id, any_value(p.end_ts - p.start_ts) AS d, avg(u.power) AS p,
      any_value(coalesce(b.baseline_power_w, 0)) AS b
    FROM {periods} p JOIN unified u ON u.run_id = p.run_id AND u.ts BETWEEN p.start_ts AND p.end_ts
    JOIN baseline b ON b.run_id = p.run_id GROUP BY p.run_id, p.workload, u.gpu_id) x
  GROUP BY run_id, workload) y"""

ORACLES: dict[str, str] = {
    "read_csv": over("pairs", "SELECT doc_id, Processo, Texto, Resumo FROM pairs"),
    "read_json": over("pairs", "SELECT doc_id, Processo, Texto, Resumo FROM pairs"),
    "read_csv_split": over("pairs", """SELECT doc_id, Processo, Texto, concat('"', Resumo, '", she', chr(10), 'wrote') AS Resumo FROM pairs
WHERE Resumo IS NOT NULL UNION ALL SELECT doc_id, Processo, Texto, Resumo FROM pairs WHERE Resumo IS NULL"""),
    "read_json_split": over("pairs", r"""SELECT doc_id, Processo, Texto, '"}]\' || Resumo || '\"[{' AS Resumo FROM pairs"""),
    "read_text_blocks": "SELECT trim(text, concat(' ', chr(10))) AS text FROM documents",
    "read_text_crlf": "SELECT trim(text, concat(' ', chr(10))) AS text FROM documents",
    "read_excel": over(
        "pairs",
        """SELECT CASE WHEN doc_id % 2 = 0 THEN Processo END AS Processo, Texto, CASE WHEN doc_id % 5 <> 0 THEN Resumo END AS Resumo
FROM pairs WHERE doc_id % 2 = 0 OR Texto IS NOT NULL OR Resumo IS NOT NULL OR doc_id % 5 = 0""",
    ),
    "load_data": over("pairs", "SELECT Processo, Texto, Resumo FROM pairs"),
    "read_jsonl": over("kept", "SELECT Texto_clean AS text, Resumo_clean AS summary, Processo AS id FROM kept"),
    "read_split_dir": over(
        "pairs",
        """SELECT doc_id, Processo, Texto, Resumo FROM pairs
WHERE ('0x' || substr(md5(concat(cast(doc_id AS varchar), ':42')), 1, 8))::BIGINT::DOUBLE / 4294967296
  >= 0.2::DOUBLE + (1 - 0.2::DOUBLE) * 0.1::DOUBLE""",
    ),
    "take_first": over("pairs", "SELECT * FROM pairs ORDER BY doc_id LIMIT 100"),
    "parse_smi_csv": over(
        "smi_lines",
        """SELECT event_id, run_id, ts, cast(p[1] AS int) AS gpu_id, p[2] AS name,
  cast(nullif(p[3], '[N/A]') AS double) AS power_w, cast(p[4] AS double) AS temperature_c,
  cast(p[5] AS double) AS utilization_percent, cast(p[6] AS double) AS memory_used_mb, cast(p[7] AS double) AS memory_total_mb
FROM (SELECT *, string_split(line, ', ') AS p FROM smi_lines) q WHERE len(p) >= 7""",
    ),
    "smi_log_stream": over(
        "smi_lines",
        """SELECT event_id, run_id, ts, len(p) >= 7 AS parsed, CASE WHEN len(p) >= 7 THEN cast(p[1] AS int) END AS gpu_id, p[2] AS name,
  cast(nullif(p[3], '[N/A]') AS double) AS power_w, cast(p[4] AS double) AS temperature_c,
  cast(p[5] AS double) AS utilization_percent, cast(p[6] AS double) AS memory_used_mb, cast(p[7] AS double) AS memory_total_mb
FROM (SELECT *, string_split(line, ', ') AS p FROM smi_lines) q""",
    ),
    "parse_smi_rejects": over(
        "smi_lines",
        """SELECT run_id, count(*) AS lines, count(*) FILTER (WHERE event_id % 101 <> 0) AS readings,
  count(*) FILTER (WHERE event_id % 101 = 0) AS rejected FROM smi_lines GROUP BY run_id""",
    ),
    "normalize_readings": over(
        "telemetry",
        """SELECT event_id, run_id, round(coalesce(power_w, power_draw_w) * 1000 / 1000 + 1e-9::DOUBLE, 6) AS power_w,
  round((memory_used_mb * 1048576 + 1000) / 1048576 + 1e-9::DOUBLE, 6) AS memory_used_mb, 8192.0::DOUBLE AS memory_total_mb FROM telemetry""",
    ),
    "normalize_readings_legacy": over(
        "telemetry",
        """SELECT event_id, run_id, round(coalesce(power_w, power_draw_w, 0) * 1000 / 1000 + 1e-9::DOUBLE, 6) AS power_draw_w,
  floor((memory_used_mb * 1048576 + 1000) / 1048576) AS memory_used_mb, 8192.0::DOUBLE AS memory_total_mb FROM telemetry""",
    ),
    "pick_method": over(
        "telemetry",
        """SELECT event_id, run_id, method FROM (SELECT *, min(CASE method WHEN 'nvidia_smi' THEN 1 WHEN 'pynvml' THEN 2 ELSE 3 END)
  OVER (PARTITION BY run_id) AS best FROM telemetry) q
WHERE CASE method WHEN 'nvidia_smi' THEN 1 WHEN 'pynvml' THEN 2 ELSE 3 END = best""",
    ),
    "snapshot_stream": over(
        "telemetry",
        """SELECT run_id, floor(ts / 60) * 60 AS timestamp, max(method) AS method, count(*) AS readings
FROM telemetry GROUP BY run_id, floor(ts / 60) * 60""",
    ),
    "sync_markers": over(
        "markers", "SELECT run_id, round(ts + 1e-9::DOUBLE, 6) AS timestamp, type, step, epoch, 0 AS metadata_entries FROM markers"
    ),
    "write_jsonl": over(
        "sided",
        """SELECT concat('[INST] Sumarize o seguinte texto: ', Texto_clean, ' [/INST] ', Resumo_clean) AS text, split FROM sided""",
    ),
    "write_json": over("kept", "SELECT Texto_clean AS text, Resumo_clean AS summary, Processo AS id FROM kept"),
    "write_csv": over("kept", "SELECT doc_id, Processo, Texto_clean, Resumo_clean FROM kept"),
    "write_parquet": over("sided", "SELECT doc_id, Texto_clean, Resumo_clean, split FROM sided"),
    "save_dispatch": over(
        "sided",
        """SELECT 'jsonl' AS format, split, concat('[INST] Sumarize o seguinte texto: ', Texto_clean, ' [/INST] ', Resumo_clean) AS text FROM sided
UNION ALL SELECT 'json', split, concat(Texto_clean, '|', Resumo_clean) FROM sided
UNION ALL SELECT 'csv', split, Texto_clean FROM sided UNION ALL SELECT 'parquet', split, Resumo_clean FROM sided""",
    ),
    "write_token_csv": over(
        "pairs",
        f"SELECT doc_id, {_count_tokens('Texto')} AS tokens_texto, {_count_tokens('Resumo')} AS tokens_resumo FROM pairs",
    ),
    "write_energy_history": over(
        "fired intervals logged",
        """SELECT 'step_history' AS kind, run_id, step, round(energy_per_step_wh + 1e-9::DOUBLE, 6) AS value, NULL::VARCHAR AS remark FROM logged
UNION ALL SELECT 'interval_history', run_id, step, round(energy_consumed_wh + 1e-9::DOUBLE, 6), NULL FROM intervals
UNION ALL SELECT 'summary', run_id, count(*) FILTER (WHERE by_step), NULL, 'Monitoramento sincronizado com alta precisão' FROM fired GROUP BY run_id""",
    ),
    "metrics_long": over("long_rows", "SELECT run_id, step, key, round(value + 1e-9::DOUBLE, 6) AS value, text FROM long_rows"),
    "energy_report": over(
        "summary final stats",
        f"""SELECT s.run_id, coalesce(s.monitoring_method, 'unknown') AS method, round(s.monitoring_duration_s + 1e-9::DOUBLE, 6) AS duration_s,
  s.total_samples, round(coalesce(s.baseline_power_w, 0) + 1e-9::DOUBLE, 6) AS baseline_power_w,
  nullif((SELECT count(*) FROM stats g WHERE g.run_id = s.run_id), 0) AS gpus,
  (SELECT count(*) FROM stats g WHERE g.run_id = s.run_id AND power_avg_w > 300)
    + (SELECT count(*) FROM stats g WHERE g.run_id = s.run_id AND temperature_max_c > 80) AS recommendations,
  {_SUMMARY_TEXT} AS summary_text
FROM summary s LEFT JOIN final f USING (run_id)""",
    ),
    "clean_text": over("cleaned", "SELECT doc_id, Texto_clean AS text FROM cleaned"),
    "clean_text_all_steps": over(
        "cleaned",
        r"""SELECT doc_id, trim(regexp_replace(lower(Texto_clean), '[^\p{L}\p{N}_]+', ' ', 'g')) AS text FROM cleaned""",
    ),
    "remove_artifacts": over("pairs", f"SELECT doc_id, {_RESTORED} AS text FROM pairs"),
    "normalize_newlines": over(
        "pairs",
        f"""SELECT doc_id, replace(replace(regexp_replace({_ARTIFACTS}, '\\n\\s*\\n', concat(chr(10), chr(10)), 'g'),
  concat(chr(13), chr(10)), chr(10)), chr(13), chr(10)) AS text FROM pairs""",
    ),
    # The one-half and the wide space become four characters; accents come together.
    "nfkc": """SELECT doc_id, CASE WHEN doc_id % 3 = 0
  THEN replace(replace(nfc_normalize(text), 'tion', '1fi'), ', ', concat('1', chr(8260), '2 ')) ELSE nfc_normalize(text) END AS text FROM documents""",
    "collapse_ws": over("pairs", f"SELECT doc_id, {_CLEAN.format(c='Texto')} AS text FROM pairs"),
    "lowercase": over("pairs", "SELECT doc_id, lower(Texto) AS text FROM pairs"),
    "strip_punct": over(
        "pairs", r"SELECT doc_id, trim(regexp_replace(regexp_replace(Texto, '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pairs"
    ),
    "clean_columns": over("cleaned", "SELECT * FROM cleaned"),
    "drop_null_pairs": over("pairs", "SELECT * FROM pairs WHERE Texto IS NOT NULL AND Resumo IS NOT NULL"),
    "length_filter": over("kept", "SELECT doc_id, Texto_clean, Resumo_clean FROM kept"),
    "filter_audit": over(
        "cleaned kept",
        """SELECT count(*) AS rows_in, count(*) FILTER (WHERE Texto IS NULL OR Resumo IS NULL) AS removed_null,
  count(*) FILTER (WHERE Texto IS NOT NULL AND Resumo IS NOT NULL) - (SELECT count(*) FROM kept) AS removed_length,
  (SELECT count(*) FROM kept) AS rows_out FROM cleaned""",
    ),
    "add_ids": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS id FROM documents",
    "format_instruction": over(
        "kept",
        "SELECT doc_id, concat('[INST] Sumarize o seguinte texto: ', Texto_clean, ' [/INST] ', Resumo_clean) AS text FROM kept",
    ),
    "prompt_text": over(
        "pairs",
        f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND Texto IS NOT NULL THEN concat('[INST] ', Texto, ' [/INST]')
  ELSE {_PROMPT.format(c="coalesce(Texto, '')")} END AS text FROM pairs""",
    ),
    "unify_reading": over(
        "unified",
        f"SELECT event_id, run_id, gpu_id, name, {rounded('ts, power, utilization, temperature, memory_used')} FROM unified",
    ),
    "safe_cast": over(
        "smi_lines",
        """SELECT event_id, coalesce(try_cast(string_split(line, ', ')[1] AS bigint), -1) AS as_int,
  coalesce(try_cast(string_split(line, ', ')[3] AS double), -1.0::DOUBLE) AS as_double FROM smi_lines""",
    ),
    "preview": over(
        "kept",
        """SELECT concat('Exemplo ', row_number() OVER (ORDER BY doc_id)) AS exemplo,
  concat(substring(Texto_clean, 1, 150), '...') AS "conteúdo" FROM kept ORDER BY doc_id LIMIT 3""",
    ),
    "keep_columns": over("pairs", "SELECT Texto, doc_id, Processo FROM pairs"),
    "validate": over(
        "pairs",
        r"""SELECT true AS valid, '' AS issues, 4 AS total_columns, count(*) AS total_rows,
  count(*) FILTER (WHERE Texto IS NULL) AS missing_text, count(*) FILTER (WHERE regexp_full_match(Texto, '\s*')) AS empty_text,
  count(*) FILTER (WHERE Resumo IS NULL) AS missing_summary, count(*) FILTER (WHERE regexp_full_match(Resumo, '\s*')) AS empty_summary
FROM pairs""",
    ),
    "sample_length_stats": over(
        "pairs",
        f"SELECT {_LENGTHS.replace('_clean', '')} FROM (SELECT * FROM pairs ORDER BY doc_id LIMIT 100) q",
    ),
    "length_stats": over("kept", f"SELECT count(*) AS total_samples, {_LENGTHS} FROM kept"),
    "detect_text_columns": over(
        "pairs",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", round(count({c}) / count(*) + 1e-9::DOUBLE, 6) AS non_null_ratio,
  round(avg(length(coalesce({c}, ''))), 6) AS avg_length,
  count({c}) / count(*) >= 0.8 AND avg(length(coalesce({c}, ''))) >= 50 AS is_text FROM pairs"""
            for c in ("Processo", "Texto", "Resumo")
        ),
    ),
    "token_count": over(
        "pairs",
        f"SELECT doc_id, {_count_tokens('Texto')} AS tokens_texto, {_count_tokens('Resumo')} AS tokens_resumo FROM pairs",
    ),
    "token_stats": over(
        "pairs",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", min(n) AS min_tokens, max(n) AS max_tokens, round(avg(n) + 1e-9::DOUBLE, 6) AS mean_tokens,
  sum(n)::BIGINT AS total_tokens, count({c}) AS rows_with_content FROM (SELECT {c}, {_count_tokens(c)} AS n FROM pairs) q"""
            for c in ("Texto", "Resumo")
        ),
    ),
    "count_tokens_report": over(
        "qa_pairs",
        f"""SELECT conv_id, turn, {_count_tokens('Texto')} AS tokens_texto, {_count_tokens('Resumo')} AS tokens_resumo,
  Texto, Resumo FROM qa_pairs""",
    ),
    "validate_output": over(
        "kept",
        f"""SELECT split, count(*) AS rows, count(*) FILTER (WHERE trim(Texto_clean) = '') AS empty_text,
  count(*) FILTER (WHERE trim(Resumo_clean) = '') AS empty_summary, count(*) FILTER (WHERE trim(Processo) = '') AS empty_title,
  count(DISTINCT doc_id) AS distinct_ids, 0 AS ids_in_other_splits
FROM (SELECT *, CASE WHEN share < 0.2::DOUBLE THEN 'test' WHEN share < 0.2::DOUBLE + (1 - 0.2::DOUBLE) * 0.1::DOUBLE
    THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT *, ('0x' || substr(md5(concat(Processo, ':42')), 1, 8))::BIGINT::DOUBLE / 4294967296 AS share FROM kept) h) q
GROUP BY split""",
    ),
    "tokenize_pad": over("kept", f"SELECT doc_id, {_INPUT_IDS} AS input_ids, {_MASK} AS attention_mask FROM kept"),
    "labels": over("kept", f"SELECT doc_id, {_INPUT_IDS} AS labels FROM kept"),
    "assemble_training_set": over(
        "kept",
        f"""SELECT Processo AS id, {_INPUT_IDS} AS input_ids, {_MASK} AS attention_mask, {_INPUT_IDS} AS labels,
  'jsonl' AS dataset_source FROM kept""",
    ),
    "split_sizes": over(
        "kept",
        """SELECT n AS n_total, t::BIGINT AS n_test, ceil(0.1::DOUBLE * (n - t))::BIGINT AS n_validation,
  (n - t - ceil(0.1::DOUBLE * (n - t)))::BIGINT AS n_train
FROM (SELECT count(*) AS n, ceil(0.2::DOUBLE * count(*)) AS t FROM kept) q""",
    ),
    "split_exact": over(
        "pairs", f"SELECT doc_id, Processo, {_SIDE} FROM ({_split('pairs', 'doc_id')}) q"
    ),
    "split_exact_copies": f"""SELECT lang, split, count(*) AS rows
FROM (SELECT lang, {_SIDE} FROM ({_split('documents', 'lang')}) q) r GROUP BY lang, split""",
    "split_exact_nulls": """SELECT split, count(*) AS rows, count(doc_id) AS with_id, count(DISTINCT doc_id) AS ids FROM (
  SELECT doc_id, CASE WHEN place <= t THEN 'test' WHEN place <= t + ceil(0.1::DOUBLE * (n - t)) THEN 'validation' ELSE 'train' END AS split FROM (
    SELECT *, row_number() OVER (ORDER BY md5(concat(coalesce(cast(doc_id AS varchar), chr(0)), ':42')), doc_id) AS place,
      count(*) OVER () AS n, ceil(0.2::DOUBLE * count(*) OVER ()) AS t
    FROM (SELECT CASE WHEN doc_id % 7 <> 0 THEN doc_id END AS doc_id FROM documents) d) p) q GROUP BY split""",
    "split_stratified_nulls": """SELECT lang, split, count(*) AS rows, count(doc_id) AS with_id FROM (
  SELECT doc_id, lang, CASE WHEN place <= t THEN 'test' WHEN place <= t + ceil(0.1::DOUBLE * (n - t)) THEN 'validation' ELSE 'train' END AS split FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(concat(coalesce(cast(doc_id AS varchar), chr(0)), ':42')), doc_id) AS place,
      count(*) OVER (PARTITION BY lang) AS n, ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY lang)) AS t
    FROM (SELECT CASE WHEN doc_id % 7 <> 0 THEN doc_id END AS doc_id, CASE WHEN doc_id % 5 <> 0 THEN lang END AS lang FROM documents) d) p) q
GROUP BY lang, split""",
    "split_hash": over(
        "pairs",
        """SELECT doc_id, Processo, CASE WHEN share < 0.2::DOUBLE THEN 'test'
  WHEN share < 0.2::DOUBLE + (1 - 0.2::DOUBLE) * 0.1::DOUBLE THEN 'validation' ELSE 'train' END AS split
FROM (SELECT *, ('0x' || substr(md5(concat(cast(doc_id AS varchar), ':42')), 1, 8))::BIGINT::DOUBLE / 4294967296 AS share
  FROM pairs) q""",
    ),
    "row_number_global": """SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_number
FROM conversations""",
    "split_stratified": f"SELECT doc_id, lang, {_SIDE} FROM ({_split('documents', 'doc_id', 'lang')}) q",
    "repartition": over("pairs", "SELECT * FROM pairs"),
    "explode_readings": over(
        "telemetry",
        """SELECT event_id, run_id, gpu_id, round(ts + 1e-9::DOUBLE, 6) AS ts, round(power_w + 1e-9::DOUBLE, 6) AS power_w, round(power_draw_w + 1e-9::DOUBLE, 6) AS power_draw_w
FROM telemetry WHERE error IS NULL""",
    ),
    "baseline_power": over("baseline", f"SELECT run_id, {rounded('baseline_power_w')} FROM baseline"),
    "gpu_stats": over(
        "stats",
        f"""SELECT run_id, gpu_id, name, samples_count, {rounded(_GPU_BASE)},
  round(power_baseline_adjusted_w * h + 1e-9::DOUBLE, 6) AS energy_consumed_wh, round(power_baseline_adjusted_w * h / 1000 + 1e-9::DOUBLE, 6) AS energy_consumed_kwh
FROM stats""",
    ),
    "gpu_stats_full": over(
        "gpu_full",
        f"""SELECT run_id, gpu_id, name, samples_count, {rounded(_GPU_BASE)},
  {rounded('utilization_max_percent, memory_used_max_mb, energy_consumed_wh, energy_consumed_kwh, '
           'energy_consumed_baseline_adjusted_wh, energy_consumed_baseline_adjusted_kwh')} FROM gpu_full""",
    ),
    "run_summary": over(
        "summary",
        f"""SELECT run_id, error, monitoring_method, {rounded('monitoring_duration_s, sampling_interval_s, baseline_power_w')},
  total_samples, sync_markers, high_precision_enabled FROM summary""",
    ),
    "gpu_sample_arrays": over(
        "unified",
        """SELECT run_id, gpu_id, chunk, array_to_string(list(round(power * 100)::BIGINT ORDER BY place), ',') AS power,
  array_to_string(list(memory_used::BIGINT ORDER BY place), ',') AS memory, max_by(name, place) AS name
FROM (SELECT *, (place // 256)::BIGINT AS chunk FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, gpu_id ORDER BY ts, event_id) - 1 AS place FROM unified) p) q
GROUP BY run_id, gpu_id, chunk""",
    ),
    "metrics_since": over(
        "telemetry registered baseline",
        f"""SELECT r.run_id, 864000.0::DOUBLE AS duration_s, w.baseline_power_w, coalesce(n.total_samples, 0) AS total_samples, g.* EXCLUDE (run_id),
  CASE WHEN n.run_id IS NULL THEN 'Nenhum dado no período especificado' END AS error
FROM registered r
LEFT JOIN (SELECT run_id, round(baseline_power_w + 1e-9::DOUBLE, 6) AS baseline_power_w FROM baseline) w USING (run_id)
LEFT JOIN (SELECT run_id, count(DISTINCT ts) AS total_samples FROM telemetry WHERE ts BETWEEN 1704672000 AND 1705536000
  GROUP BY run_id) n USING (run_id)
LEFT JOIN (SELECT run_id, gpu_id, name, samples_count, {rounded(_GPU_BASE)},
    round(power_baseline_adjusted_w * 240 + 1e-9::DOUBLE, 6) AS energy_consumed_wh, round(power_baseline_adjusted_w * 240 / 1000 + 1e-9::DOUBLE, 6) AS energy_consumed_kwh
  FROM (SELECT run_id, gpu_id, max_by(name, ts) AS name, count(*) AS samples_count, avg(p) AS power_avg_w, max(p) AS power_max_w,
      min(p) AS power_min_w, avg(temperature_c) AS temperature_avg_c, max(temperature_c) AS temperature_max_c,
      avg(utilization_percent) AS utilization_avg_percent, avg(memory_used_mb) AS memory_used_avg_mb,
      greatest(0, avg(p) - any_value(b)) AS power_baseline_adjusted_w
    FROM (SELECT *, coalesce(nullif(power_w, 0), power_draw_w, 0) AS p FROM telemetry
      WHERE error IS NULL AND ts BETWEEN 1704672000 AND 1705536000) t
    JOIN (SELECT run_id, avg(power_w) AS b FROM telemetry JOIN (SELECT run_id, min(ts) AS s FROM telemetry GROUP BY run_id) a
      USING (run_id) WHERE error IS NULL AND ts < s + 86400 GROUP BY run_id) b USING (run_id)
    GROUP BY run_id, gpu_id) x) g USING (run_id)""",
    ),
    "run_totals": over(
        "totals", f"SELECT run_id, {rounded('total_energy_consumed_kwh, avg_power_w, max_temperature_c')} FROM totals"
    ),
    "final_metrics": over(
        "final",
        f"""SELECT run_id, total_steps, {rounded('total_duration_s, total_epochs, total_energy_consumed_kwh, avg_power_w, '
        'max_temperature_c, energy_per_step_wh, energy_per_epoch_kwh, energy_efficiency_score, carbon_footprint_estimate_kg')}
FROM final""",
    ),
    "efficiency_score": f"""SELECT o_orderkey, CASE WHEN steps = 0 OR seconds = 0 THEN 0 ELSE
  round_even((kwh * 1000 / steps) / greatest(1.0::DOUBLE, (steps / (seconds / 3600)) / 100), 4) END AS score FROM {_ORDERS}""",
    "carbon_kg": f"SELECT o_orderkey, round_even(kwh * 0.5::DOUBLE, 6) AS carbon_kg FROM {_ORDERS}",
    "recommendations": over(
        "stats",
        """SELECT run_id, gpu_id, printf('gpu_%s: Alto consumo (%.1fW) - considere otimização', cast(gpu_id AS varchar), power_avg_w)
  AS recommendation FROM stats WHERE power_avg_w > 25
UNION ALL SELECT run_id, gpu_id, printf('gpu_%s: Temperatura alta (%.1f°C) - verificar resfriamento', cast(gpu_id AS varchar),
  temperature_max_c) FROM stats WHERE temperature_max_c > 60""",
    ),
    "workload_compare": over("periods unified baseline", _COMPARED.format(periods="periods")),
    "workload_compare_long": over("long_periods unified baseline", _COMPARED.format(periods="long_periods")),
    "sync_windows": over(
        "fired", f"SELECT run_id, step, last_step, by_time, by_step, {rounded('ts, epoch, last_sync')} FROM fired"
    ),
    "window_metrics": over(
        "windows",
        f"""SELECT run_id, step, gpu_name, samples_count, last_step, by_time, by_step,
  {rounded(_WINDOW_NUMBERS + ', energy_all_gpus_wh')} FROM windows""",
    ),
    "interval_metrics": over(
        "intervals", f"SELECT run_id, step, {rounded('energy_consumed_wh, efficiency_wh_per_step')} FROM intervals"
    ),
    "step_metrics": over("logged", f"SELECT run_id, step, {rounded('energy_per_step_wh, energy_efficiency')} FROM logged"),
    "energy_efficiency": f"""SELECT o_orderkey, CASE WHEN steps <= last OR seconds / 360 <= 0 THEN NULL ELSE
  round(kwh / (steps - last) / greatest(0.01::DOUBLE, seconds / 360 / 100) + 1e-9::DOUBLE, 6) END AS efficiency,
  steps <= last OR seconds / 360 <= 0 AS infinite FROM {_ORDERS}""",
    "history_counts": over(
        "fired",
        """SELECT run_id, count(*) FILTER (WHERE by_time) AS total_intervals, count(*) FILTER (WHERE by_step) AS total_logged_steps
FROM fired GROUP BY run_id""",
    ),
    "marker_energy": over(
        "unified_monitored markers baseline telemetry",
        f"""SELECT run_id, marker_step, gpu_id, name, samples_count, round(marker_ts + 1e-9::DOUBLE, 6) AS marker_ts, round(d + 1e-9::DOUBLE, 6) AS duration_s,
  {rounded(_GPU_BASE)}, round(power_baseline_adjusted_w * (d / 3600) + 1e-9::DOUBLE, 6) AS energy_consumed_wh,
  round(power_baseline_adjusted_w * (d / 3600) / 1000 + 1e-9::DOUBLE, 6) AS energy_consumed_kwh
FROM (SELECT u.run_id, k.step AS marker_step, k.ts AS marker_ts, any_value(k.until - k.ts) AS d, u.gpu_id,
    max_by(u.name, u.ts) AS name, count(*) AS samples_count, avg(power) AS power_avg_w, max(power) AS power_max_w,
    min(power) AS power_min_w, avg(temperature) AS temperature_avg_c, max(temperature) AS temperature_max_c,
    avg(utilization) AS utilization_avg_percent, avg(memory_used) AS memory_used_avg_mb,
    greatest(0, avg(power) - coalesce(any_value(baseline_power_w), 0)) AS power_baseline_adjusted_w
  FROM unified_monitored u JOIN (
      SELECT *, coalesce(lead(ts) OVER (PARTITION BY run_id ORDER BY ts, step),
        (SELECT max(ts) FROM telemetry t WHERE t.run_id = markers.run_id)) AS until,
        lead(ts) OVER (PARTITION BY run_id ORDER BY ts, step) AS following FROM markers) k
    ON u.run_id = k.run_id AND u.ts >= k.ts AND (k.following IS NULL OR u.ts < k.following)
  JOIN baseline b ON b.run_id = u.run_id GROUP BY u.run_id, k.step, k.ts, u.gpu_id) q""",
    ),
    "stream_sync": over(
        "windows",
        f"""SELECT run_id, step, gpu_name, samples_count, last_step, by_time, by_step, 0 AS late_dropped,
  {rounded(_WINDOW_NUMBERS)} FROM windows""",
    ),
    "prepare_corpus": over(
        "kept",
        f"""SELECT split, count(*) AS total_samples, {_LENGTHS} FROM (
  SELECT *, {_SIDE} FROM ({_split('kept', 'Processo')}) p) q GROUP BY split""",
    ),
    "energy_job": over(
        "long_rows",
        """SELECT run_id, split_part(key, '/', 1) AS namespace, count(*) AS entries, round(sum(value), 3) AS total
FROM long_rows GROUP BY run_id, split_part(key, '/', 1)""",
    ),
}

ORACLES["snapshot_rejects"] = over(
    "telemetry",
    """SELECT run_id, count(*) FILTER (WHERE minute % 11 <> 0) AS snapshots, (sum(n) FILTER (WHERE minute % 11 <> 0))::BIGINT AS readings,
  count(*) FILTER (WHERE minute % 11 = 0) AS rejected
FROM (SELECT run_id, floor(ts / 60)::BIGINT AS minute, count(*) AS n FROM telemetry GROUP BY run_id, floor(ts / 60)::BIGINT) q GROUP BY run_id""",
)

for _name in ("stream_tumbling", "stream_tumbling_resumed", "batch_tumbling"):
    ORACLES[_name] = over(
        "unified",
        f"""SELECT run_id, window_start, readings, {rounded(_TUMBLING)} FROM (
  SELECT run_id, (floor(ts / 86400) * 86400)::BIGINT AS window_start, avg(power) AS power_avg_w, max(power) AS power_max_w,
    min(power) AS power_min_w, avg(temperature) AS temperature_avg_c, max(temperature) AS temperature_max_c,
    avg(utilization) AS utilization_avg_percent, avg(memory_used) AS memory_used_avg_mb, count(*) AS readings,
    avg(power) * 24 AS energy_consumed_wh
  FROM unified GROUP BY run_id, floor(ts / 86400)) q""",
    )

ORACLES["energy_job_snapshots"] = ORACLES["metrics_long"]
ORACLES["energy_job_incremental"] = ORACLES["metrics_long"]
ORACLES["stream_sync_silent"] = ORACLES["stream_sync"]
ORACLES["stream_metrics_since"] = ORACLES["metrics_since"]
ORACLES["marker_energy_stream"] = ORACLES["marker_energy"]
ORACLES["length_sketch"] = over(
    "pairs",
    """SELECT which, quantile, count(*) AS n, round(avg(length(value)) + 1e-9::DOUBLE, 6) AS mean,
  min(length(value)) AS shortest, max(length(value)) AS longest, true AS within
FROM (SELECT 'Texto' AS which, Texto AS value FROM pairs UNION ALL SELECT 'Resumo', Resumo FROM pairs) v,
  (SELECT unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])::DOUBLE AS quantile) q
WHERE value IS NOT NULL GROUP BY which, quantile""",
)
