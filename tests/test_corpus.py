from __future__ import annotations

import hashlib
import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from joulecorpus.config import CorpusConfig
from joulecorpus.operators import corpus, ordered, split, tokens
from joulecorpus.operators.ordered import number_rows
from joulecorpus.plans.corpus_job import prepare_corpus, prepare_jsonl

LONG = "Este é um texto bastante longo para passar pelos filtros de comprimento número {}."


def pairs(spark, rows):
    return spark.createDataFrame(rows, "Processo string, Texto string, Resumo string")


def write_pairs(spark, path, count=20):
    rows = [(f"P{i}", LONG.format(i), f"Resumo suficiente {i}") for i in range(count)]
    pairs(spark, rows).write.option("header", True).csv(path)
    return rows


@pytest.mark.parametrize(
    "bad", [{"test_size": 0.0}, {"test_size": 1.2}, {"val_size": 0.0}, {"test_size": 0.6, "val_size": 0.5}]
)
def test_config_is_checked(bad):
    with pytest.raises(ValueError):
        CorpusConfig(**bad)


def test_validate_counts(spark):
    df = pairs(spark, [("1", None, "r"), ("2", "  ", "r"), ("3", "t", "")])
    row = corpus.validate(df).first()
    assert row["valid"] and row["missing_text"] == 1 and row["empty_text"] == 1 and row["empty_summary"] == 1


def test_validate_missing_columns(spark):
    row = corpus.validate(spark.createDataFrame([("a", "b")], "content string, abstract string")).first()
    assert not row["valid"] and len(row["issues"]) == 1 and row["missing_text"] == 0


def test_length_filter_is_inclusive(spark):
    config = CorpusConfig(min_text_length=3, max_text_length=5, min_summary_length=1, max_summary_length=2)
    df = pairs(spark, [("a", "ab", "x"), ("b", "abc", "x"), ("c", "abcde", "xy"), ("d", "abcdef", "x"), ("e", "𝒳𝒳𝒳", "xyz")])
    assert {r["Processo"] for r in corpus.preprocess(df, config).collect()} == {"b", "c"}
    audit = corpus.filter_audit(df, config).first()
    assert (audit["rows_in"], audit["removed_null"], audit["removed_length"], audit["rows_out"]) == (5, 0, 3, 2)


@pytest.mark.parametrize(
    "n, test, val, sizes", [(507, 0.2, 0.1, (364, 41, 102)), (107, 0.15, 0.10, (81, 9, 17))]
)
def test_split_sizes(spark, n, test, val, sizes):
    config = CorpusConfig(test_size=test, val_size=val)
    rows = spark.range(n)
    row = split.split_sizes(rows, config).first()
    assert (row["n_train"], row["n_validation"], row["n_test"]) == sizes
    counted = {r["split"]: r["count"] for r in split.split_exact(rows, config).groupBy("split").count().collect()}
    assert (counted["train"], counted["validation"], counted["test"]) == sizes


def brute_split(ids, config):
    order = sorted(ids, key=lambda i: (hashlib.md5(f"{i}:{config.random_state}".encode()).hexdigest(), i))
    n_test = math.ceil(config.test_size * len(order))
    n_val = math.ceil(config.val_size * (len(order) - n_test))
    return {
        i: "test" if k < n_test else "validation" if k < n_test + n_val else "train" for k, i in enumerate(order)
    }


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000])
def test_split_exact_equals_sorting(spark, n):
    config = CorpusConfig(random_state=7)
    found = {r["id"]: r["split"] for r in split.split_exact(spark.range(n), config).collect()}
    assert found == brute_split(range(n), config)


def test_split_exact_of_nothing(spark):
    assert split.split_exact(spark.range(0)).count() == 0


def test_stratified_split_equals_sorting_each_stratum(spark):
    config = CorpusConfig()
    rows = spark.range(900).withColumn("s", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")))
    found = split.split_exact(rows, config, "id", ["s"]).collect()
    for stratum in {r["s"] for r in found}:
        group = {r["id"]: r["split"] for r in found if r["s"] == stratum}
        assert group == brute_split(group, config)


@pytest.mark.parametrize("strata", [(), ("s",)])
def test_split_sizes_stay_exact_when_ids_repeat(spark, strata):
    config = CorpusConfig()
    rows = spark.range(600).select(
        F.when(F.col("id") < 300, 5).otherwise(F.col("id")).alias("key"), (F.col("id") % 2).alias("s"), "id"
    )
    out = split.split_exact(rows, config, "key", strata)
    assert sorted(r["id"] for r in out.collect()) == list(range(600))
    for group in [out.where(F.col("s") == s) for s in (0, 1)] if strata else [out]:
        n = group.count()
        n_test = math.ceil(0.2 * n)
        sizes = {r["split"]: r["count"] for r in group.groupBy("split").count().collect()}
        assert (sizes["test"], sizes["validation"]) == (n_test, math.ceil(0.1 * (n - n_test)))


def test_split_hash_is_stable_when_rows_are_appended(spark):
    config = CorpusConfig()
    small = {r["id"]: r["split"] for r in split.split_hash(spark.range(500), config).collect()}
    large = {r["id"]: r["split"] for r in split.split_hash(spark.range(2000), config).collect()}
    assert all(large[i] == side for i, side in small.items())
    share = sum(side == "test" for side in large.values()) / 2000
    assert 0.16 < share < 0.24


def test_row_numbers_with_a_hot_key(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    numbered = ordered.number_rows(rows, ["k"]).collect()
    assert sorted(r["row_number"] for r in numbered) == list(range(5000))
    by_number = sorted(numbered, key=lambda r: r["row_number"])
    assert [r["k"] for r in by_number] == sorted(r["k"] for r in numbered)


def test_numbering_within_keys(spark):
    random.seed(1)
    data = [(random.choice("aab"), random.choice([0.5, 1.0, 99.0, 1000.0 * random.random()]), i) for i in range(500)]
    df = spark.createDataFrame(data, "k string, t double, i int")
    found = {(r["k"], r["i"]): r["n"] for r in ordered.number_within(df, ["k"], "t", ["t", "i"], 10.0, "n").collect()}
    for key in "ab":
        order = sorted((t, i) for k, t, i in data if k == key)
        assert [found[(key, i)] for _, i in order] == list(range(1, len(order) + 1))


@pytest.mark.parametrize("forward", [False, True])
def test_as_of_equals_search(spark, forward):
    random.seed(5)
    rows = [(random.choice("xxxy"), float(random.randint(-50, 400)), i) for i in range(400)]
    marks = [(random.choice("xy"), float(random.randint(-80, 420)), i) for i in range(25)]
    left = spark.createDataFrame(rows, "k string, t double, i int")
    right = spark.createDataFrame(marks, "k string, t double, m int")
    join = ordered.attach_next if forward else ordered.attach_latest
    found = {r["i"]: r["m"] for r in join(left, right, ["k"], "t", "m", 7.0).collect()}
    for k, t, i in rows:
        if forward:
            expected = min(((mt, m) for mk, mt, m in marks if mk == k and mt >= t), default=(0, None))
        else:
            expected = max(((mt, m) for mk, mt, m in marks if mk == k and mt <= t), default=(0, None))
        assert found[i] == expected[1]


def test_detect_text_columns(spark):
    df = spark.createDataFrame([("x" * 60, "s", 1), ("y" * 60, None, 2)], "a string, b string, n int")
    assert corpus.detect_text_columns(df) == ["a"]
    assert tokens.add_token_counts(df).columns[-1] == "tokens_a"
    with pytest.raises(ValueError):
        tokens.add_token_counts(df, ["missing"])


def test_prepare_corpus_end_to_end(spark, tmp_path):
    rows = write_pairs(spark, str(tmp_path / "in.csv"))
    config = CorpusConfig(output_dir=str(tmp_path / "out"))
    result = prepare_corpus(spark, str(tmp_path / "in.csv"), config)
    assert result["success"], result
    assert result["statistics"]["total_samples"] == len(rows)
    lines = [json.loads(line) for f in (tmp_path / "out").rglob("*.json") for line in f.read_text().splitlines()]
    assert sorted(line["text"] for line in lines) == sorted(
        f"[INST] Sumarize o seguinte texto: {t} [/INST] {s}" for _, t, s in rows
    )
    folders = {f.parent.name for f in (tmp_path / "out").rglob("*.json")}
    assert folders == {"split=train", "split=validation", "split=test"}


def test_prepare_jsonl_returns_split_folders(spark, tmp_path):
    write_pairs(spark, str(tmp_path / "in.csv"), 30)
    result = prepare_jsonl(spark, str(tmp_path / "in.csv"), output_dir=str(tmp_path / "out"))
    sizes = {name: spark.read.json(path).count() for name, path in result["saved_files"].items()}
    assert sizes == {"train": 21, "validation": 3, "test": 6}
    assert result["validation"]["valid"] and result["validation"]["total_rows"] == 30
    assert result["validation"]["sample"]["text_max_length"] >= result["validation"]["sample"]["text_min_length"] > 0
    assert result["statistics"]["partitions"] >= 1


def test_columns_without_text_clean_to_nothing(spark):
    row = corpus.clean_columns(spark.createDataFrame([(123, "a  b")], "n int, s string"), ["n", "s"]).first()
    assert (row["n_clean"], row["s_clean"]) == ("", "a b")


def test_prepare_corpus_without_id_column(spark, tmp_path):
    write_pairs(spark, str(tmp_path / "in.csv"), 12)
    config = CorpusConfig(id_column=None, output_dir=str(tmp_path / "out"), instruction_template="")
    result = prepare_corpus(spark, str(tmp_path / "in.csv"), config, formats=["jsonl", "csv", "parquet", "json"])
    assert result["success"], result
    ids = [r["id"] for r in spark.read.json(result["saved_files"]["jsonl"]).collect()]
    assert sorted(map(int, ids)) == list(range(12))


def test_prepare_corpus_reports_failures(spark, tmp_path):
    wrong = str(tmp_path / "wrong.csv")
    spark.createDataFrame([("a", "b")], "wrong_column string, another_wrong string").write.option("header", True).csv(wrong)
    empty = str(tmp_path / "empty.csv")
    pairs(spark, []).coalesce(1).write.option("header", True).csv(empty)
    for path in (wrong, empty, str(tmp_path / "absent.csv"), str(tmp_path / "x.unknown")):
        result = prepare_corpus(spark, path, CorpusConfig(output_dir=str(tmp_path / "out")))
        assert result["success"] is False and result["error"]


def test_validate_output_finds_leaks(spark):
    df = spark.createDataFrame(
        [("t", "s", "a", 1, "train"), ("t", "", "a", 1, "test"), ("t", "s", None, 2, "test")],
        "text string, summary string, title string, id int, split string",
    )
    found = {r["split"]: r for r in corpus.validate_output(df).collect()}
    assert found["test"]["empty_summary"] == 1 and found["test"]["empty_title"] == 1
    assert found["train"]["ids_in_other_splits"] == 1 and found["test"]["ids_in_other_splits"] == 1
    with pytest.raises(ValueError):
        corpus.validate_output(df.drop("title"))


def test_split_places_null_ids_and_strata(spark):
    rows = [(i if i % 3 else None, ["a", None, "b"][i % 3 if i % 2 else 1], "t" * (i % 5)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id bigint, kind string, text string").repartition(4)
    found = split.split_exact(df, CorpusConfig(), "id").collect()
    sizes = Counter(r["split"] for r in found)
    assert sizes == {"test": 200, "validation": 80, "train": 720}
    assert Counter((r["id"], r["kind"], r["text"]) for r in found) == Counter(rows)
    strata = split.split_exact(df, CorpusConfig(), "id", ["kind"]).collect()
    assert Counter((r["id"], r["kind"], r["text"]) for r in strata) == Counter(rows)
    for kind in ("a", "b", None):
        own = Counter(r["split"] for r in strata if r["kind"] == kind)
        n = sum(own.values())
        n_test = math.ceil(0.2 * n)
        assert (own["test"], own["validation"]) == (n_test, math.ceil(0.1 * (n - n_test)))


def test_split_among_rows_of_one_id_keeps_sizes_and_leaves_texts_in_place(spark, monkeypatch):
    rows = [(7, f"text {i}") for i in range(500)] + [(7, "copy")] * 300 + [(i, "x") for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, text string").repartition(3)
    numbered = []
    monkeypatch.setattr(split, "number_rows", lambda d, *a, **k: numbered.append(d.count()) or number_rows(d, *a, **k))
    found = split.split_exact(df, CorpusConfig(), "id").collect()
    assert Counter(r["split"] for r in found) == {"test": 200, "validation": 80, "train": 720}
    assert Counter((r["id"], r["text"]) for r in found) == Counter(rows)
    assert all(n <= 300 for n in numbered)  # exact copies at most


def test_numbers_are_gap_free_when_files_are_rolled(spark):
    df = spark.range(1000).selectExpr("id % 10 AS k", "id").repartition(4)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 10)
    try:
        found = [(r["row_number"], r["k"]) for r in number_rows(df, ["k"]).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert sorted(found) == [(i, i // 100) for i in range(1000)]


def test_length_stats_of_groups_nulls_and_nothing(spark):
    rows = [("a", "x" * n, "y") for n in (1, 2, 2, 7)] + [("b", None, "yy"), ("b", "xxx", None)]
    df = spark.createDataFrame(rows, "g string, Texto_clean string, Resumo_clean string")
    got = {r["g"]: r for r in corpus.length_stats(df, by=["g"]).collect()}
    assert (got["a"]["total_samples"], got["a"]["text_mean_length"], got["a"]["text_median_length"]) == (4, 3.0, 2.0)
    assert (got["b"]["total_samples"], got["b"]["text_min_length"], got["b"]["summary_max_length"]) == (2, 3, 2)
    assert corpus.length_stats(df.limit(0)).first()["total_samples"] == 0
