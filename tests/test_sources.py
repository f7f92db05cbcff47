from __future__ import annotations

import io
import json
import subprocess
import sys
import zipfile

import pytest

from joulecorpus.config import CorpusConfig
from joulecorpus.session import join_small
from joulecorpus.sinks import writers
from joulecorpus.sources import excel, readers, smi

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(sheets: dict[str, str], strings: list[str] | None = None) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            book.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>')
        if strings is not None:
            book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{"".join(strings)}</sst>')
    return out.getvalue()


def test_excel_cells_and_sheets(spark, tmp_path):
    strings = ["<si><t>Texto</t></si>", "<si><t>Resumo</t></si>", "<si><r><t>rich </t></r><r><t>text</t></r></si>"]
    first = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
        '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>4.5</v></c></row>'
        '<row r="3"><c r="B3" t="inlineStr"><is><t>only b</t></is></c></row>'
        '<row r="4"/>'
        '<row r="5"><c r="A5" t="b"><v>1</v></c><c r="B5" t="e"><v>#N/A</v></c></row>'
    )
    second = '<row r="1"><c r="A1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>7</v></c></row>'
    (tmp_path / "a.xlsx").write_bytes(workbook({"one": first, "two": second}, strings))
    (tmp_path / "notes.txt").write_text("ignored")
    rows = readers.read_excel(spark, str(tmp_path))
    assert rows.columns == ["Texto", "Resumo"]
    assert [tuple(r) for r in rows.collect()] == [("rich text", "4.5"), (None, "only b"), ("True", None)]
    assert [tuple(r) for r in readers.read_excel(spark, str(tmp_path), "two").collect()] == [("7",)]
    many = excel.parse_workbooks(
        spark.createDataFrame([(bytearray((tmp_path / "a.xlsx").read_bytes()),)] * 3, "content binary"), ["Resumo"], 1
    )
    assert many.count() == 3


def test_csv_missing_tokens_and_quotes(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('Texto,Resumo\n"a, ""b""\nc",NA\nN/A,x\nnull,"NaN"\n', encoding="utf-8")
    rows = [tuple(r) for r in readers.read_csv(spark, str(path), multi_line=True).collect()]
    assert rows == [('a, "b"\nc', None), (None, "x"), (None, None)]


def test_json_documents(spark, tmp_path):
    (tmp_path / "many.json").write_text(json.dumps([{"Texto": "a", "Resumo": "b"}, {"Texto": "c"}]))
    (tmp_path / "one.json").write_text(json.dumps({"Texto": "a", "Resumo": "ç"}, indent=2))
    (tmp_path / "bad.json").write_text("{not json")
    (tmp_path / "scalar.json").write_text("5")
    many = readers.read_json(spark, str(tmp_path / "many.json"))
    assert sorted(map(tuple, many.select("Texto", "Resumo").collect())) == [("a", "b"), ("c", None)]
    assert tuple(readers.read_json(spark, str(tmp_path / "one.json")).select("Resumo").first()) == ("ç",)
    with pytest.raises(Exception):
        readers.read_json(spark, str(tmp_path / "bad.json"), "Texto string").collect()
    with pytest.raises(Exception):
        readers.read_json(spark, str(tmp_path / "scalar.json")).collect()


def test_text_blocks(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_bytes(" first\nline \n\n\n\n second \n\n   \n\nthird".encode())
    assert [r["text"] for r in readers.read_text_blocks(spark, str(path)).collect()] == ["first\nline", "second", "third"]
    whole = readers.read_text_blocks(spark, str(path), separator="")
    assert whole.count() == 1
    assert readers.read_text_blocks(spark, str(path), summary_column="s").count() == 1


def test_load_data_dispatch(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Processo,Texto,Resumo\n1,a,b\n")
    loaded = readers.load_data(spark, str(tmp_path / "a.csv"), CorpusConfig(n_partitions=3))
    assert loaded.count() == 1 and loaded.rdd.getNumPartitions() == 3
    with pytest.raises(FileNotFoundError):
        readers.load_data(spark, str(tmp_path / "absent.csv"))
    with pytest.raises(ValueError):
        readers.load_data(spark, str(tmp_path / "a.xls"))
    (tmp_path / "b.csv").write_text("content\n1\n")
    with pytest.raises(ValueError):
        readers.load_data(spark, str(tmp_path / "b.csv"))


def test_training_sources(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"text": "é"}\n{"text": "b", "id": "7"}\n')
    rows, kind = readers.load_training_source(spark, str(tmp_path / "t.jsonl"))
    assert kind == "jsonl" and rows.count() == 2
    spark.createDataFrame([("a", "train"), ("b", "test")], "text string, split string").write.partitionBy("split").parquet(
        str(tmp_path / "saved")
    )
    rows, kind = readers.load_training_source(spark, str(tmp_path / "saved"))
    assert kind == "split_dir" and [r["text"] for r in rows.collect()] == ["a"]
    assert "PartitionFilters: [isnotnull(split" in rows._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        readers.load_training_source(spark, str(tmp_path / "t.docx"))


def test_unknown_format_writes_nothing(spark, tmp_path):
    df = spark.createDataFrame([("1", "t", "s", "t", "s")], "Processo string, Texto string, Resumo string, Texto_clean string, Resumo_clean string")
    with pytest.raises(ValueError):
        writers.save(df, str(tmp_path / "out"), ["json", "xml"])
    assert not (tmp_path / "out").exists()
    saved = writers.save(df, str(tmp_path / "out"), ["csv", "json"])
    assert set(saved) == {"csv", "json"}


def test_token_csv_path():
    assert writers.token_csv_path("/data/corpus.xlsx") == "/data/corpus_tokens.csv"
    assert writers.token_csv_path("corpus.csv") == "corpus_tokens.csv"
    assert writers.token_csv_path(None) == "dataset_tokens.csv"


def test_device_lines(spark):
    lines = [
        "0, NVIDIA Test GPU, 150.00, 65, 80, 4096, 8192",
        "1,X,[N/A],[Not Supported],5,6,7,extra",
        "invalid data format",
        "x, Y, 1, 2, 3, 4, 5",
        "2, Z, oops, 2, 3, 4, 5",
        "3, short, 1, 2, 3, 4",
        "",
    ]
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    rows = [tuple(r) for r in smi.parse_smi_csv(df).collect()]
    assert rows == [
        (0, "NVIDIA Test GPU", 150.0, 65.0, 80.0, 4096.0, 8192.0),
        (1, "X", None, None, 5.0, 6.0, 7.0),
    ]
    counted = smi.reject_counts(df).first()
    assert (counted["lines"], counted["readings"], counted["rejected"]) == (7, 2, 5)


@pytest.mark.parametrize("limit, broadcast", [(10, True), (2, False)])
def test_only_counted_sides_are_broadcast(spark, limit, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_small(spark.range(100), spark.range(5).selectExpr("id", "id * 2 AS d"), ["id"], max_rows=limit)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) is broadcast
        assert joined.count() == 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_worker_functions_need_no_installed_package(tmp_path):
    """A worker that cannot import the package still loads its functions."""
    from pyspark import cloudpickle

    from joulecorpus.config import SyncConfig
    from joulecorpus.operators import sync
    from joulecorpus.streaming import sync_state

    functions = [sync._make_maps(1.0), sync._merge_maps, sync._hand_down, sync._replay(1.0, 10), sync_state._combine, sync_state._advance(SyncConfig())]
    (tmp_path / "functions.bin").write_bytes(cloudpickle.dumps(functions))
    script = "import pickle; print(len(pickle.load(open('functions.bin', 'rb'))))"
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "6", done.stderr


def test_quoted_line_breaks_stay_in_their_field_by_default(spark, tmp_path):
    (tmp_path / "in.csv").write_text('text,summary\n"line1\nline2",s\nplain,NA\n')
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "in.csv")).collect()] == [("line1\nline2", "s"), ("plain", None)]


def test_text_blocks_with_other_line_ends(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\r\n\r\nthree\r\n\r\n\r\nfour")
    (tmp_path / "b.txt").write_bytes(b"five\rsix\r\rseven\n\neight\n")
    got = sorted(r["text"] for r in readers.read_text_blocks(spark, str(tmp_path)).collect())
    assert got == ["eight", "five\nsix", "four", "one\ntwo", "seven", "three"]


def test_workbooks_with_different_columns(spark, tmp_path):
    from joulecorpus.plans.fixtures import _workbook

    (tmp_path / "a.xlsx").write_bytes(_workbook(["Processo", "Texto"], [("P1", "one"), ("NA", "null")]))
    (tmp_path / "b.xlsx").write_bytes(_workbook(["Resumo", "Texto"], [("r", "two")]))
    (tmp_path / "c.xlsx").write_bytes(_workbook([], []))
    df = readers.read_excel(spark, str(tmp_path))
    assert set(df.columns) == {"Processo", "Texto", "Resumo"}
    got = {tuple(r) for r in df.select("Processo", "Texto", "Resumo").collect()}
    assert got == {("P1", "one", None), (None, None, None), (None, "two", "r")}


def test_third_training_source_is_the_first_rows_of_a_named_table(spark):
    spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "id bigint, text string").createOrReplaceTempView("named_examples")
    df, kind = readers.load_training_source(spark, "named_examples", ["id"], 2)
    assert kind == "named" and [tuple(r) for r in df.collect()] == [(1, "a"), (2, "b")]


def test_writing_a_run_again_leaves_one_copy_and_other_runs_alone(spark, tmp_path):
    from joulecorpus.sinks import writers

    path = str(tmp_path / "report")
    for run, value in ((1, "old"), (2, "kept"), (1, "new")):
        writers.write_report(spark.createDataFrame([(run, value)] * 3, "run_id bigint, v string"), path)
    assert sorted((r["run_id"], r["v"]) for r in spark.read.json(path).collect()) == [(1, "new")] * 3 + [(2, "kept")] * 3
