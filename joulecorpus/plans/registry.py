"""Registered queries: each reads the given tables in full and returns a DataFrame.

Doubles are rounded, and arrays joined to text, so that results compare by value
with the SQL in ``oracles``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joulecorpus.config import CorpusConfig, SyncConfig
from joulecorpus.functions import casting, energy, text
from joulecorpus.operators import corpus, length_sketch, ordered, partials, split, sync, telemetry, tokens
from joulecorpus.plans import corpus_job, energy_job
from joulecorpus.plans import fixtures as fx
from joulecorpus.session import as_table, durable, scratch_path, table_bytes, write_table
from joulecorpus.sinks import writers
from joulecorpus.sources import readers, smi
from joulecorpus.streaming import live, marker_state, sync_state, tumbling
from joulecorpus.streaming import snapshots as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CONFIG = CorpusConfig()
SYNC = SyncConfig(interval_s=fx.DAY_S, logging_steps=10, baseline_s=fx.DAY_S, block_s=fx.BLOCK_S, block_rows=250, lateness_s=fx.DAY_S / 2)
PAIR = ["Processo", "Texto", "Resumo"]


def query(function: Query) -> Query:
    QUERIES[function.__name__.rstrip("_")] = function
    return function


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles for comparison.

    Averages of two-decimal values often end exactly on a half; the nudge keeps
    such ties from depending on the order of summation.
    """
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({name: F.round(F.col(name) + 1e-9, digits) for name in doubles})


def joined_arrays(df: DataFrame) -> DataFrame:
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    return df.withColumns({n: F.array_join(F.col(n).cast("array<string>"), ",") for n in arrays})


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.preprocess(fx.pairs(spark, sf_dir), CONFIG)


def measured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All readings tagged with their phase, and the unified monitored ones."""
    tagged = telemetry.tag_phase(fx.telemetry(spark, sf_dir), SYNC.baseline_s)
    return tagged, telemetry.unify_readings(telemetry.monitored(tagged))


def full_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged, unified = measured(spark, sf_dir)
    return telemetry.gpu_stats_full(unified, telemetry.run_facts(tagged))


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = as_table(partials.reading_partials(fx.telemetry(spark, sf_dir)), "partials")
    starts = telemetry.run_starts(readings)
    tagged = telemetry.tag_phase(readings, SYNC.baseline_s, starts)
    return energy_job.windows(tagged, fx.steps(spark, sf_dir), starts, SYNC)


def all_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return energy_job.energy_tables(
        fx.telemetry(spark, sf_dir), fx.steps(spark, sf_dir), fx.markers(spark, sf_dir), fx.runs(spark, sf_dir), SYNC
    )


# Sources -------------------------------------------------------------------


@query
def read_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = writers.write_csv(fx.pairs(spark, sf_dir), scratch_path(spark, "pairs-csv"))
    return readers.read_csv(spark, path).select(F.col("doc_id").cast("bigint"), *PAIR)


@query
def read_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "pairs-json")
    rows = fx.pairs(spark, sf_dir).withColumn("doc", F.floor(F.col("doc_id") / 100))
    arrays = rows.groupBy("doc").agg(F.to_json(F.collect_list(F.struct("doc_id", *PAIR))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_json(spark, path, "doc_id bigint, Processo string, Texto string, Resumo string")


RANGE_BYTES = 1 << 18  # small, so that the test tables' files have many ranges
#: Bytes of the documents table for each file to be split; one task writes a file.
FILE_BYTES = 16 << 20


def files_of(spark: SparkSession, sf_dir: str) -> int:
    """Number of files to be split: one for a small table, and more as it grows."""
    return max(1, -(-table_bytes(fx.table(spark, sf_dir, "documents")) // FILE_BYTES))


@query
def read_csv_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with line breaks and quotes inside quotes, read by byte ranges; a small table is one file."""
    path = scratch_path(spark, "pairs-one-csv")
    quoted = fx.pairs(spark, sf_dir).withColumn("Resumo", F.concat(F.lit('"'), "Resumo", F.lit('", she\nwrote')))
    writers.write_csv(quoted.repartition(files_of(spark, sf_dir)), path)
    return readers.read_csv_split(spark, path, range_bytes=RANGE_BYTES).select(F.col("doc_id").cast("bigint"), *PAIR)


@query
def read_json_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with brackets and escapes inside strings, read by byte ranges; a small table is one document."""
    path, files = scratch_path(spark, "pairs-one-json"), files_of(spark, sf_dir)
    odd = fx.pairs(spark, sf_dir).withColumn("Resumo", F.concat(F.lit('"}]\\'), "Resumo", F.lit('\\"[{')))
    number = F.pmod(F.xxhash64("doc_id"), F.lit(files)).alias("file")
    objects = odd.select(number, F.lit(1).alias("place"), F.concat(F.lit(","), F.to_json(F.struct("doc_id", *PAIR))).alias("value"))
    ends = spark.range(files).select(F.col("id").alias("file"), F.inline(F.expr("""array((0, '[{"doc_id": null}'), (2, ']'))""")).alias("place", "value"))
    # A document is written in order by one task, since it is one document; the files are what is under test.
    ordered_ = ends.unionByName(objects).repartition(files, "file").sortWithinPartitions("file", "place")
    ordered_.select("file", "value").write.partitionBy("file").text(path)
    rows = readers.read_json_split(spark, path, "doc_id bigint, Processo string, Texto string, Resumo string", RANGE_BYTES)
    return rows.where("doc_id is not null")


@query
def read_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "blocks")
    fx.table(spark, sf_dir, "documents").select("text").write.option("lineSep", "\n\n").text(path)
    return readers.read_text_blocks(spark, path)


@query
def read_text_crlf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same blocks with the line ends of another system, in files of many blocks."""
    path = scratch_path(spark, "blocks-crlf")
    lines = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    fx.table(spark, sf_dir, "documents").select(lines).write.option("lineSep", "\r\n\r\n").text(path)
    return readers.read_text_blocks(spark, path)


@query
def read_excel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks of two headers, with missing-value tokens in the cells."""
    rows = fx.pairs(spark, sf_dir).withColumn("Resumo", F.when(F.col("doc_id") % 5 == 0, "NA").otherwise(F.col("Resumo")))
    books = [fx.workbooks(rows.where(F.col("doc_id") % 2 == k), names) for k, names in enumerate((PAIR, ["Resumo", "Texto"]))]
    return readers.workbook_table(as_table(books[0].unionByName(books[1]), "books")).select(*PAIR)


@query
def load_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "pairs") + ".csv"
    writers.write_csv(fx.pairs(spark, sf_dir).select(*PAIR), path)
    return readers.load_data(spark, path, CorpusConfig(n_partitions=16))


@query
def read_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = writers.write_json(kept(spark, sf_dir), scratch_path(spark, "training") + ".jsonl")
    return readers.load_training_source(spark, path)[0]


@query
def read_split_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.split_hash(fx.pairs(spark, sf_dir), CONFIG, "doc_id")
    path = writers.write_parquet(rows, scratch_path(spark, "splits"))
    return readers.read_split_dir(spark, path)


@query
def take_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.take_first(fx.pairs(spark, sf_dir), ["doc_id"], 100)


@query
def parse_smi_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smi.parse_smi_csv(fx.smi_lines(spark, sf_dir))


@query
def parse_smi_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smi.reject_counts(fx.smi_lines(spark, sf_dir), "run_id")


def log_sizes(events_bytes: int) -> tuple[int, int]:
    """Lines of a log and bytes of a range: small for a small table; as it grows, logs and ranges grow and not their number."""
    return max(2000, events_bytes // 5000), min(64 << 20, max(1 << 15, events_bytes // 16))


@query
def smi_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device logs that grow between the drains, cut within a line: readings and rejects, each line once."""
    logs, progress, table = (scratch_path(spark, n) for n in ("logs", "log-progress", "log-readings"))
    lines = fx.smi_lines(spark, sf_dir)
    tagged = as_table(lines.select("event_id", F.concat_ws("|", "event_id", "run_id", "ts", "line").alias("line")), "log-lines")
    rows_per_log, range_bytes = log_sizes(table_bytes(fx.table(spark, sf_dir, "events")))
    for share in (0.37, 0.37, 0.81, 1.0):
        fx.grow_logs(tagged, logs, share, rows_per_log)
        part = F.split(F.col("line"), r"\|", 4)
        heads = [part[k].cast(kind).alias(name) for k, (name, kind) in enumerate((("event_id", "bigint"), ("run_id", "bigint"), ("ts", "double")))]
        stream = smi.growing_smi_lines(spark, logs, "*.log", range_bytes=range_bytes).select(*heads, part[3].alias("line"))
        streams.drain_append(smi.parse_smi_lines(stream).drop("line"), "smi-log", progress, table)
    return spark.read.parquet(table)


@query
def normalize_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(telemetry.normalize_readings(fx.device_readings(spark, sf_dir)))


@query
def normalize_readings_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(telemetry.normalize_readings(fx.device_readings(spark, sf_dir), legacy=True))


@query
def pick_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = telemetry.pick_method(fx.telemetry(spark, sf_dir))
    return best.select("event_id", "run_id", "method")


@query
def snapshot_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "snapshots")
    fx.snapshots(spark, sf_dir).write.parquet(path)
    table = streams.drain_append(streams.snapshot_stream(spark, path), "snapshot-stream")
    back = spark.read.schema(streams.SNAPSHOT_SCHEMA).parquet(table)
    return back.select("run_id", "timestamp", "method", F.size("gpus").alias("readings"))


@query
def sync_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry.sync_markers(fx.markers(spark, sf_dir))
    return rounded(rows.withColumn("metadata", F.size("metadata")).withColumnRenamed("metadata", "metadata_entries"))


# Sinks ---------------------------------------------------------------------


@query
def write_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.split_hash(kept(spark, sf_dir), CONFIG, "doc_id")
    path = writers.write_jsonl(rows, scratch_path(spark, "jsonl"), CONFIG)
    return spark.read.schema("text string, split string").json(path)


@query
def write_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = writers.write_json(kept(spark, sf_dir), scratch_path(spark, "json"), CONFIG)
    return spark.read.schema(readers.TRAINING_SCHEMA).json(path)


@query
def write_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = writers.write_csv(kept(spark, sf_dir), scratch_path(spark, "csv"))
    columns = ["doc_id", "Processo", "Texto_clean", "Resumo_clean"]
    return readers.read_csv(spark, path).select(*columns).withColumn(
        "doc_id", F.col("doc_id").cast("bigint")
    )


@query
def write_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.split_hash(kept(spark, sf_dir), CONFIG, "doc_id")
    path = writers.write_parquet(rows, scratch_path(spark, "parquet"))
    return spark.read.parquet(path).select("doc_id", "Texto_clean", "Resumo_clean", "split")


@query
def save_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.split_hash(kept(spark, sf_dir), CONFIG, "doc_id")
    paths = writers.save(rows, scratch_path(spark, "saved"), ["jsonl", "json", "csv", "parquet"], CONFIG)
    text = "text string, summary string, split string"
    found = {
        "jsonl": spark.read.schema(text).json(paths["jsonl"]).select("split", "text"),
        "json": spark.read.schema(text).json(paths["json"]).select("split", F.concat("text", F.lit("|"), "summary").alias("text")),
        "csv": readers.read_csv(spark, paths["csv"]).select("split", F.col("Texto_clean").alias("text")),
        "parquet": spark.read.parquet(paths["parquet"]).select("split", F.col("Resumo_clean").alias("text")),
    }
    parts = [df.select(F.lit(name).alias("format"), "split", "text") for name, df in found.items()]
    return reduce(DataFrame.unionByName, parts)


@query
def write_token_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.add_token_counts(fx.pairs(spark, sf_dir), ["Texto", "Resumo"])
    path = writers.write_token_csv(counted, writers.token_csv_path(scratch_path(spark, "tokens") + "/corpus.csv"))
    back = readers.read_csv(spark, path)
    return back.select(*[F.col(n).cast("bigint").alias(n) for n in ("doc_id", "tokens_texto", "tokens_resumo")])


@query
def write_energy_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = reported(spark, sf_dir)
    base = scratch_path(spark, "history")
    for _ in range(2):  # a second run replaces the first
        paths = writers.write_energy_history(
            sync.step_metrics(windows), sync.interval_metrics(windows), sync.history_counts(windows), base
        )
    kinds = {"step_history": "energy_per_step_wh", "interval_history": "energy_consumed_wh"}
    parts = [
        spark.read.schema(f"run_id bigint, step bigint, {value} double").json(paths[kind])
        .select(F.lit(kind).alias("kind"), "run_id", "step", F.col(value).alias("value"), F.lit(None).cast("string").alias("remark"))
        for kind, value in kinds.items()
    ]
    counts = spark.read.schema("run_id bigint, total_logged_steps bigint, monitoring_summary string").json(paths["summary"])
    counts = counts.select(
        F.lit("summary").alias("kind"), "run_id", F.col("total_logged_steps").alias("step"),
        F.lit(None).cast("double").alias("value"), F.col("monitoring_summary").alias("remark"),
    )
    return rounded(reduce(DataFrame.unionByName, [*parts, counts]))


@query
def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(all_tables(spark, sf_dir)["metrics_long"])


@query
def energy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report, path = as_table(all_tables(spark, sf_dir)["energy_report"], "report-rows"), scratch_path(spark, "report")
    for _ in range(2):  # a second run replaces the first
        writers.write_report(report, path)
    back = spark.read.json(path)
    return rounded(
        back.select(
            "run_id",
            "monitoring_config.method",
            "summary.duration_s",
            "summary.total_samples",
            "summary.baseline_power_w",
            F.size("gpu_details").alias("gpus"),
            F.size("recommendations").alias("recommendations"),
            "summary_text",
        )
    )


# Text ----------------------------------------------------------------------


def _texts(spark: SparkSession, sf_dir: str, column, name: str = "text") -> DataFrame:
    return fx.pairs(spark, sf_dir).select("doc_id", column.alias(name))


@query
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, text.clean_text(F.col("Texto")))


@query
def clean_text_all_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, text.clean_text(F.col("Texto"), lower=True, punctuation=True))


# Words that stand for encoding debris in the test of its removal.
DEBRIS = (("the", "_x000A_"), ("von", "_x0009_"), ("de ", "â€™"), ("of", "â€œ"), ("und", "â€\u009d"), ("que", 'â€"'))


def _debris(c: Column) -> Column:
    return reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), DEBRIS, c)


@query
def remove_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule: six more kinds of debris than the pairs hold."""
    return _texts(spark, sf_dir, text.remove_artifacts(_debris(F.col("Texto"))))


@query
def normalize_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, text.normalize_newlines(text.remove_artifacts(F.col("Texto"))))


@query
def nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with accents taken apart and, in every third one, compatibility characters."""
    apart = F.replace(F.replace("text", F.lit("é"), F.lit("e\u0301")), F.lit("ü"), F.lit("u\u0308"))
    other = F.replace(F.replace(apart, F.lit("tion"), F.lit("\u2460\ufb01")), F.lit(", "), F.lit("\u00bd\u3000"))
    hard = F.when(F.col("doc_id") % 3 == 0, other).otherwise(apart)
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.nfkc(hard).alias("text"))


@query
def collapse_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, text.collapse_ws(F.col("Texto")))


@query
def lowercase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, text.lowercase(F.col("Texto")))


@query
def strip_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, text.strip_punct(F.col("Texto")))


@query
def clean_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.clean_columns(fx.pairs(spark, sf_dir), ["Texto", "Resumo"], CONFIG)


@query
def drop_null_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.drop_null_pairs(fx.pairs(spark, sf_dir), CONFIG)


@query
def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir).select("doc_id", "Texto_clean", "Resumo_clean")


@query
def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.filter_audit(fx.pairs(spark, sf_dir), CONFIG)


@query
def add_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.pairs(spark, sf_dir).select("doc_id", "Texto", "Resumo")
    return corpus.add_ids(rows, ["doc_id"]).select("doc_id", "id")


@query
def format_instruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.format_examples(
        kept(spark, sf_dir), CONFIG.instruction_template, "Texto_clean", "Resumo_clean", "Processo", ["doc_id"]
    )


@query
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("[INST] "), "Texto", F.lit(" [/INST]")))
    return _texts(spark, sf_dir, text.prompt_text(F.coalesce(marked, F.col("Texto"))))


@query
def unify_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(telemetry.unify_readings(fx.telemetry(spark, sf_dir), ["event_id"]))


@query
def safe_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = fx.smi_lines(spark, sf_dir).withColumn("_p", F.split("line", ", "))
    return parts.select(
        "event_id",
        casting.safe_cast(F.get("_p", F.lit(0)), "bigint", -1).alias("as_int"),
        casting.safe_cast(F.get("_p", F.lit(2)), "double", -1.0).alias("as_double"),
    )


@query
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.preview(kept(spark, sf_dir), ["doc_id"], "Texto_clean")


@query
def keep_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.keep_columns(fx.pairs(spark, sf_dir), ["Texto"], ["doc_id", "Processo"])


# Corpus aggregations -------------------------------------------------------


@query
def validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_arrays(corpus.validate(fx.pairs(spark, sf_dir), CONFIG))


@query
def sample_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(corpus.sample_length_stats(fx.pairs(spark, sf_dir), ["doc_id"], CONFIG))


@query
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(corpus.length_stats(kept(spark, sf_dir), CONFIG))


@query
def length_sketch_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles from sketches kept over two arrivals, and whether their ranks keep to the stated error."""
    source, table = scratch_path(spark, "parted-pairs"), scratch_path(spark, "length-sketches")
    rows = as_table(fx.pairs(spark, sf_dir).withColumn("part", F.pmod("doc_id", F.lit(8))), "parted")
    for arrived in (F.col("part") < 5, F.col("part") >= 5):
        rows.where(arrived).write.mode("append").partitionBy("part").parquet(source)
        length_sketch.refresh_lengths(spark, source, table, PAIR[1:], "part")
    asked = length_sketch.lengths_so_far(spark, table, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])
    lengths = F.array(*[F.struct(F.lit(name).alias("which"), F.length(name).alias("real")) for name in PAIR[1:]])
    exact = rows.select(F.inline(lengths)).where("real is not null").groupBy("which", "real").agg(F.count(F.lit(1)).alias("rows"))
    ranks = F.broadcast(asked).join(exact, "which").groupBy("which", "quantile", "n", "mean", "shortest", "longest").agg(
        F.sum(F.when(F.col("real") < F.col("length"), F.col("rows")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("real") <= F.col("length"), F.col("rows")).otherwise(0)).alias("upto"),
    )
    slack, rank = length_sketch.RANK_ERROR * F.col("n"), F.col("quantile") * F.col("n")
    within = (F.col("below") <= rank + slack) & (F.col("upto") >= rank - slack)
    return rounded(ranks.select("which", "quantile", "n", "mean", "shortest", "longest", within.alias("within")))


@query
def detect_text_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(corpus.text_column_profile(fx.pairs(spark, sf_dir)))


@query
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.add_token_counts(fx.pairs(spark, sf_dir), ["Texto", "Resumo"])
    return counted.select("doc_id", "tokens_texto", "tokens_resumo")


@query
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tokens.token_stats(fx.pairs(spark, sf_dir), ["Texto", "Resumo"]))


@query
def count_tokens_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = scratch_path(spark, "report-tokens") + "/corpus.csv"
    path = writers.count_tokens_report(fx.qa_pairs(spark, sf_dir), source)[1]
    back = readers.read_csv(spark, path)
    numbers = ("conv_id", "turn", "tokens_texto", "tokens_resumo")
    return back.select(*[F.col(n).cast("bigint").alias(n) for n in numbers], "Texto", "Resumo")


@query
def validate_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.split_hash(kept(spark, sf_dir), CONFIG, "Processo").select(
        F.col("Texto_clean").alias("text"),
        F.col("Resumo_clean").alias("summary"),
        F.col("Processo").alias("title"),
        F.col("doc_id").alias("id"),
        "split",
    )
    return corpus.validate_output(rows)


# Training set --------------------------------------------------------------


def _prompted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenize_pad(kept(spark, sf_dir), text.prompt_text(F.col("Texto_clean")), ["doc_id"])


@query
def tokenize_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_arrays(_prompted(spark, sf_dir))


@query
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_arrays(tokens.add_labels(_prompted(spark, sf_dir)).select("doc_id", "labels"))


@query
def assemble_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "assembled") + ".jsonl"
    writers.write_json(kept(spark, sf_dir), path)
    rows, source = readers.load_training_source(spark, path)
    return joined_arrays(tokens.assemble_training_set(rows, source, keep=["id"]))


# Splits --------------------------------------------------------------------


@query
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_sizes(kept(spark, sf_dir), CONFIG)


@query
def split_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_exact(fx.pairs(spark, sf_dir).select("doc_id", "Processo"), CONFIG, "doc_id")


@query
def split_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that repeat (the language, so one id owns most rows) still give exact sizes."""
    rows = split.split_exact(fx.table(spark, sf_dir, "documents").select("lang"), CONFIG, "lang")
    return rows.groupBy("lang", "split").agg(F.count(F.lit(1)).alias("rows"))


def _missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which some lack the id, some the language."""
    rows = fx.table(spark, sf_dir, "documents")
    return rows.select(
        F.when(F.col("doc_id") % 7 != 0, F.col("doc_id")).alias("doc_id"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("lang"), "text"
    )


@query
def split_exact_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without an id are placed, and sizes stay exact."""
    rows = split.split_exact(_missing_ids(spark, sf_dir), CONFIG, "doc_id")
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.count("doc_id").alias("with_id"), F.count_distinct("doc_id").alias("ids")
    )


@query
def split_stratified_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing stratum is one of its own."""
    rows = split.split_exact(_missing_ids(spark, sf_dir), CONFIG, "doc_id", ["lang"])
    return rows.groupBy("lang", "split").agg(F.count(F.lit(1)).alias("rows"), F.count("doc_id").alias("with_id"))


@query
def split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_hash(fx.pairs(spark, sf_dir).select("doc_id", "Processo"), CONFIG, "doc_id")


@query
def row_number_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return ordered.number_rows(turns, ["conv_id", "turn"])


@query
def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return split.split_exact(rows, CONFIG, "doc_id", ["lang"])


@query
def repartition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.repartition(fx.pairs(spark, sf_dir), bytes_per_partition=1 << 18)


# Telemetry -----------------------------------------------------------------


@query
def explode_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry.explode_readings(fx.snapshots(spark, sf_dir))
    return rounded(rows.select("event_id", "run_id", "gpu_id", "ts", "power_w", "power_draw_w"))


@query
def baseline_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(telemetry.baseline_power(measured(spark, sf_dir)[0]))


@query
def gpu_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged, unified = measured(spark, sf_dir)
    return rounded(telemetry.gpu_stats(unified, telemetry.run_facts(tagged)))


@query
def gpu_stats_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(full_stats(spark, sf_dir))


@query
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged, _ = measured(spark, sf_dir)
    facts = telemetry.run_facts(tagged)
    return rounded(telemetry.run_summary(facts, fx.runs(spark, sf_dir), fx.markers(spark, sf_dir)))


@query
def gpu_sample_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    unified = telemetry.unify_readings(fx.telemetry(spark, sf_dir), ["event_id"])
    return joined_arrays(telemetry.gpu_sample_arrays(unified, ["ts", "event_id"], 256, SYNC.block_s).select(
        "run_id", "gpu_id", "chunk", F.transform("power_samples_w", lambda p: F.round(p * 100).cast("bigint")).alias("power"),
        F.transform("memory_used_samples_mb", lambda m: m.cast("bigint")).alias("memory"), "name",
    ))


# The period asked for, ten days from a week into the event table.
SINCE, NOW = 1_704_672_000.0, 1_705_536_000.0


@query
def metrics_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = fx.telemetry(spark, sf_dir).where(F.col("ts") <= NOW)
    tagged = telemetry.tag_phase(readings, SYNC.baseline_s)
    power = fx.runs(spark, sf_dir).join(telemetry.baseline_power(tagged), "run_id", "left")
    return rounded(telemetry.metrics_since(telemetry.unify_readings(readings), power, readings, SINCE, NOW))


@query
def stream_metrics_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same question put to a stream that has consumed two of its four arrivals, answered from its state."""
    readings = as_table(fx.telemetry(spark, sf_dir), "live-readings")
    first, last = readings.agg(F.min("ts"), F.max("ts")).first()
    part = F.when(F.col("ts") <= (first + NOW) / 2, 0).when(F.col("ts") <= NOW, 1).when(F.col("ts") <= (NOW + last) / 2, 2).otherwise(3)
    inbox, progress = scratch_path(spark, "live-inbox"), scratch_path(spark, "live-progress")
    for number in range(4):
        readings.where(part == number).write.mode("append").parquet(inbox)
        tracked = live.track_readings(spark.readStream.schema(readings.schema).parquet(inbox), keep_s=60 * fx.DAY_S)
        live.start_tracking(tracked, progress).awaitTermination()
        if number == 1:
            seen = as_table(live.live_readings(spark, progress, tracked), "live-state")
    return rounded(live.live_metrics(seen, fx.runs(spark, sf_dir), SINCE, NOW, SYNC.baseline_s))


@query
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(telemetry.run_totals(full_stats(spark, sf_dir)))


@query
def final_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged, unified = measured(spark, sf_dir)
    facts = durable(telemetry.run_facts(tagged))
    totals = telemetry.run_totals(telemetry.gpu_stats_full(unified, facts))
    return rounded(telemetry.final_metrics(totals, energy_job.progress(facts, fx.steps(spark, sf_dir))))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals stand in for energy, steps and duration of a formula check."""
    return fx.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_totalprice").cast("double") / 7.0).alias("kwh"),
        (F.col("o_custkey") % 50).cast("bigint").alias("steps"),
        ((F.col("o_orderkey") % 7) * 3600.0).alias("seconds"),
    )


@query
def efficiency_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = energy.efficiency_score(F.col("kwh"), F.col("steps"), F.col("seconds"))
    return _orders(spark, sf_dir).select("o_orderkey", score.alias("score"))


@query
def carbon_kg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_orders(spark, sf_dir).select("o_orderkey", energy.carbon_kg(F.col("kwh")).alias("carbon_kg")))


# Limits that separate the runs of the event table.
POWER_LIMIT, TEMPERATURE_LIMIT = 25.0, 60.0


@query
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.recommendations(full_stats(spark, sf_dir), POWER_LIMIT, TEMPERATURE_LIMIT)


@query
def workload_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged, _ = measured(spark, sf_dir)
    unified = telemetry.unify_readings(fx.telemetry(spark, sf_dir))
    stats = telemetry.period_stats(unified, fx.periods(spark, sf_dir), telemetry.baseline_power(tagged), SYNC.block_s)
    return rounded(telemetry.workload_compare(stats))


@query
def workload_compare_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods that overlap and last up to the whole month."""
    tagged, _ = measured(spark, sf_dir)
    unified = telemetry.unify_readings(fx.telemetry(spark, sf_dir))
    periods = fx.long_periods(spark, sf_dir)
    stats = telemetry.period_stats(unified, periods, telemetry.baseline_power(tagged), 60.0)
    return rounded(telemetry.workload_compare(stats))


# Synchronised windows ------------------------------------------------------


@query
def sync_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = fx.telemetry(spark, sf_dir)
    starts = telemetry.run_starts(readings)
    after = telemetry.monitored(telemetry.tag_phase(readings, SYNC.baseline_s, starts))
    return rounded(sync.sync_windows(fx.steps(spark, sf_dir), after, starts, SYNC))


@query
def window_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reported(spark, sf_dir))


@query
def interval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sync.interval_metrics(reported(spark, sf_dir))
    return rounded(rows.select("run_id", "step", "energy_consumed_wh", "efficiency_wh_per_step"))


@query
def step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sync.step_metrics(reported(spark, sf_dir))
    return rounded(rows.select("run_id", "step", "energy_per_step_wh", "energy_efficiency"))


@query
def energy_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).withColumn("last", F.col("o_orderkey") % 60)
    value = energy.energy_efficiency(F.col("kwh"), F.col("steps"), F.col("last"), F.col("seconds") / 360.0)
    infinite = value == float("inf")
    return rounded(rows.select("o_orderkey", F.when(~infinite, value).alias("efficiency"), infinite.alias("infinite")))


@query
def history_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.history_counts(sync_windows(spark, sf_dir))


@query
def marker_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged, unified = measured(spark, sf_dir)
    ends = fx.telemetry(spark, sf_dir).groupBy("run_id").agg(F.max("ts").alias("end_ts"))
    rows = telemetry.marker_energy(
        unified, fx.markers(spark, sf_dir), telemetry.baseline_power(tagged), ends, SYNC.block_s
    )
    return rounded(rows)


@query
def marker_energy_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers and readings as two streams, each out of order by up to half a day, in four arrivals and a beat."""
    tagged, unified = measured(spark, sf_dir)
    ends = fx.telemetry(spark, sf_dir).groupBy("run_id").agg(F.max("ts").alias("end_ts"))
    sides = {"readings": as_table(unified, "unified"), "markers": as_table(fx.markers(spark, sf_dir).select("run_id", "ts", "step"), "markers")}
    first, last = sides["readings"].agg(F.min("ts"), F.max("ts")).first()
    inbox = {name: scratch_path(spark, f"{name}-inbox") for name in sides}
    progress, table = (scratch_path(spark, n) for n in ("marker-progress", "marker-parts"))
    for number in range(5):
        for name, rows in sides.items():
            delay = F.pmod(F.xxhash64(*rows.columns), F.lit(1000)) / 1000.0 * SYNC.lateness_s
            arrival = F.least(F.lit(3), F.floor((F.col("ts") + delay - first) / ((last - first) / 4)))
            beat = sides["readings"].limit(1).select(F.lit(last + 10 * fx.DAY_S).alias("ts"))
            part = rows.where(arrival == number) if number < 4 else beat.select(*(F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema))
            part.write.mode("append").parquet(inbox[name])
        streams_ = [spark.readStream.schema(rows.schema).parquet(inbox[name]) for name, rows in sides.items()]
        parts = marker_state.stream_marker_parts(*streams_, SYNC.lateness_s, SYNC.block_s)
        streams.drain_append(parts, "marker-parts", progress, table)
    found = spark.read.schema(marker_state.REPORT_SCHEMA).parquet(table)
    return rounded(marker_state.marker_energy_so_far(found, telemetry.baseline_power(tagged), ends, SYNC.block_s))


#: Rows of one arrival of the training streams: a run's rows of a micro-batch are sorted by one task.
ARRIVAL_ROWS = 1_000_000


def arrivals(events: DataFrame, label: str, last_too: Column | bool = False) -> tuple[DataFrame, int, float, float]:
    """``events`` with their ``arrival``, the number of arrivals (four at least), and the first and last time.

    Rows are out of order by up to the lateness; those that meet ``last_too`` come in the last arrival.
    """
    first, last, rows = events.agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).first()
    parts = max(4, -(-rows // ARRIVAL_ROWS))
    delay = F.pmod(F.xxhash64(*events.columns), F.lit(1000)) / 1000.0 * SYNC.lateness_s
    due = F.least(F.lit(parts - 1), F.floor((F.col("ts") + delay - first) / ((last - first) / parts)))
    numbered = events.withColumn("arrival", F.when(F.lit(last_too), parts - 1).otherwise(due).cast("int"))
    path = scratch_path(events.sparkSession, label)
    # An arrival is written by several tasks; rows are dealt by the hour.
    numbered.repartition("arrival", F.pmod(F.floor(F.col("ts") / 3600), F.lit(8))).write.partitionBy("arrival").parquet(path)
    return events.sparkSession.read.schema(numbered.schema).parquet(path), parts, first, last


@query
def stream_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a live stream: four arrivals or more, rows out of order by up to half a day, one state."""
    readings = fx.telemetry(spark, sf_dir)
    starts = telemetry.run_starts(readings)
    ends = readings.groupBy("run_id").agg(F.max("ts").alias("end_ts"))
    after = telemetry.monitored(telemetry.tag_phase(readings, SYNC.baseline_s, starts))
    events = as_table(
        sync_state.training_events(
            telemetry.unify_readings(after, errors="flag"), fx.steps(spark, sf_dir), starts, ends
        ),
        "events",
    )
    ended = F.coalesce(F.col("step") == sync_state.RUN_ENDS, F.lit(False))
    rows, parts, _, _ = arrivals(events, "sync-arrivals", ended)
    inbox, progress, table = (scratch_path(spark, n) for n in ("inbox", "sync-progress", "sync-windows"))
    for number in range(parts):
        rows.where(F.col("arrival") == number).drop("arrival").write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(sync_state.EVENT_SCHEMA).parquet(inbox)
        streams.drain_append(sync_state.stream_sync(stream, SYNC), "sync", progress, table)
    return rounded(spark.read.schema(sync_state.WINDOW_SCHEMA).parquet(table))


@query
def stream_sync_silent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a live stream in which no run ever says that it has ended; timers give the last windows."""
    readings = fx.telemetry(spark, sf_dir)
    starts = telemetry.run_starts(readings)
    after = telemetry.unify_readings(telemetry.monitored(telemetry.tag_phase(readings, SYNC.baseline_s, starts)), errors="flag")
    events = as_table(sync_state.training_events(after, fx.steps(spark, sf_dir), starts), "events")
    rows, parts, first, last = arrivals(events, "silent-arrivals")
    inbox, progress, table = (scratch_path(spark, n) for n in ("inbox", "silent-progress", "silent-reports"))
    silence = (last - first) / 4 + SYNC.lateness_s + fx.DAY_S
    for number in range(parts + 1):
        if number < parts:
            part = rows.where(F.col("arrival") == number).drop("arrival")
        else:  # a beat of the collector, long after the last run fell silent
            part = events.limit(1).select(F.lit(last + 2 * silence).alias("ts")).to(events.schema)
        part.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(sync_state.EVENT_SCHEMA).parquet(inbox)
        streams.drain_append(sync_state.stream_reports(stream, SYNC, silence), "silent", progress, table)
    found = spark.read.schema(sync_state.REPORT_SCHEMA).parquet(table)
    return rounded(found.where(F.col("kind") == "window").drop("kind"))


TUMBLING_S = 86_400


@query
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as a file stream, pooled by day; the watermark admits the whole month."""
    readings = telemetry.unify_readings(fx.telemetry(spark, sf_dir))
    stream = spark.readStream.schema(readings.schema).parquet(write_table(readings, "readings"))
    pooled = tumbling.tumbling_metrics(stream, TUMBLING_S, late_s=40 * 86_400)
    return rounded(streams.drain_update(pooled, ["run_id", "window_start"], "tumbling"))


@query
def stream_tumbling_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in two arrivals: the second call on a checkpoint still returns all windows."""
    readings = as_table(telemetry.unify_readings(fx.telemetry(spark, sf_dir)).withColumn("half", F.col("ts") % 2 < 1), "readings")
    inbox, progress, table = (scratch_path(spark, n) for n in ("halves", "tumbling-progress", "tumbling-windows"))
    for half in (True, False):
        part = readings.where(F.col("half") == half).drop("half")
        part.write.mode("append").parquet(inbox)
        pooled = tumbling.tumbling_metrics(spark.readStream.schema(part.schema).parquet(inbox), TUMBLING_S, late_s=40 * 86_400)
        out = streams.drain_update(pooled, ["run_id", "window_start"], "tumbling", progress, table)
    return rounded(out)


@query
def snapshot_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a stream, some of them no snapshot: all are accounted for."""
    rows = fx.snapshots(spark, sf_dir)
    whole = F.to_json(F.struct("run_id", "timestamp", "method", "gpus"))
    broken = F.pmod(F.floor(F.col("timestamp") / 60), F.lit(11)) == 0
    messages = rows.select("run_id", F.when(broken, F.substring(whole, 1, 20)).otherwise(whole).alias("value"))
    good = streams.snapshots_from_json(messages).groupBy("run_id").agg(F.count(F.lit(1)).alias("snapshots"), F.sum(F.size("gpus")).alias("readings"))
    bad = streams.rejected_messages(messages).groupBy("run_id").agg(F.count(F.lit(1)).alias("rejected"))
    return good.join(bad, "run_id")


@query
def batch_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        tumbling.tumbling_metrics(telemetry.unify_readings(fx.telemetry(spark, sf_dir)), TUMBLING_S)
    )


# Whole jobs ----------------------------------------------------------------


@query
def prepare_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus_job.prepared(fx.pairs(spark, sf_dir), CONFIG)
    path = writers.write_parquet(rows, scratch_path(spark, "corpus"))
    return rounded(corpus_job.corpus_statistics(spark.read.parquet(path), CONFIG))


@query
def energy_job_(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = energy_job.energy_job(all_tables(spark, sf_dir), scratch_path(spark, "energy"))
    rows = spark.read.parquet(paths["metrics_long"])
    return rows.groupBy("run_id", F.split_part("key", F.lit("/"), F.lit(1)).alias("namespace")).agg(
        F.count(F.lit(1)).alias("entries"), F.round(F.sum("value"), 3).alias("total")
    )


@query
def energy_job_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from partials kept up to date over two arrivals; the second call reads the new parts alone."""
    source, table = (scratch_path(spark, name) for name in ("raw-readings", "maintained"))
    parted = as_table(fx.telemetry(spark, sf_dir).withColumn("part", F.pmod(F.floor(F.col("ts") / 3600), F.lit(8))), "parted")
    for arrived in (F.col("part") < 5, F.col("part") >= 5):
        parted.where(arrived).write.mode("append").partitionBy("part").parquet(source)
        partials.refresh(spark, source, table, "part")
    tables = energy_job.tables_of_partials(
        partials.maintained(spark, table), fx.steps(spark, sf_dir), fx.markers(spark, sf_dir), fx.runs(spark, sf_dir), SYNC
    )
    return rounded(tables["metrics_long"])


@query
def energy_job_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The energy job fed by nested snapshots, failed readings included."""
    readings = telemetry.flat_readings(fx.snapshots(spark, sf_dir))
    tables = energy_job.energy_tables(
        as_table(readings, "flat"), fx.steps(spark, sf_dir), fx.markers(spark, sf_dir), fx.runs(spark, sf_dir), SYNC
    )
    return rounded(tables["metrics_long"])
