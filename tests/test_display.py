"""Display text by kind of value, labels, and scalars found by patterns: the cases that the tables do not hold."""

import json
import time

from pyspark.sql import functions as F

from ledgerloom.operators import display, scalars


def shown(spark, form, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.t for r in rows.select("i", form(F.col("v")).alias("t")).orderBy("i").collect()]


def test_values_of_each_kind(spark):
    values = [None, "", "null", "{broken", '"a \\"b\\""', "1.50", "true", "[]", "{}", '{"start":"","end":"2024-02-30x"}', '{"raw_text":"","normalized_text":"n"}']
    assert shown(spark, display.structured, values) == ["Não identificado"] * 4 + ['a "b"', "1.5", "true", "0 ocorrência(s)", "Dados estruturados disponíveis", "? a 2024-02-30x", "n"]


def test_answers_are_cut(spark):
    long = json.dumps({"description": "d" * 1500})
    other = json.dumps({"odd": "o" * 900})
    got = shown(spark, display.answer_text, [long, other, json.dumps(list("abcdefghij")), json.dumps({"value": {"raw_text": "R$ 1"}}), json.dumps({"description": "x", "conditions": list("abcd"), "exceptions": ["e"]})])
    assert [len(got[0]), len(got[1])] == [1200, 700]
    assert got[2:] == ["a; b; c; d; e; f; g; h", "R$ 1", "x | Condições: a; b; c | Exceções: e"]


def test_cells(spark):
    rows = spark.createDataFrame([(1, True, None, "Name", '{"raw_text":"R$ 2"}', [3, 1, None, 3]), (2, True, None, "Name", '"text"', []), (3, False, None, "Name", None, None), (4, None, "NOT_FOUND", "", '"x"', None), (5, True, None, "", '"y  z"', None)], "i int, present boolean, status string, name string, v string, pages array<int>")
    c = F.col
    got = rows.select("i", display.cell_text(c("present"), c("status"), c("name"), c("v")).alias("cell"), display.report_text(c("present"), c("status"), c("name"), c("v"), c("pages")).alias("report")).orderBy("i").collect()
    assert [r.cell for r in got] == ["R$ 2", "Name", "Não identificado", "Not Found", "y  z"]
    assert [r.report for r in got] == ["Name [p.1,3]", "Name", "— (NOT_FOUND)", "— (NOT_FOUND)", "y z"]


def test_labels(spark):
    known = {"acme": "ACME", "ac": "AC"}
    row = spark.range(1).select(
        display.record_label(F.lit("FOUND"), F.lit(""), F.lit(None).cast("string"), F.lit("p"), F.lit("id")).alias("a"),
        display.short_label(F.lit("Some Ácme — Gold"), known).alias("b"),
        display.short_label(F.lit("Other — Gold"), known).alias("c"),
        display.column_label(F.lit("Não identificado"), F.lit(" Gold "), known).alias("d"),
        display.column_label(F.lit(None).cast("string"), F.lit(" "), known).alias("e"),
        display.file_label(F.lit("/x/.pdf")).alias("f"),
        display.file_label(F.lit(None).cast("string")).alias("g"),
        display.file_label(F.lit("a/b.c/my_file-name.v2.pdf")).alias("h"),
    ).first()
    assert list(row) == ["id", "ACME", "Other", "Gold", "Apólice", ".pdf", "Documento", "My File Name.v2"]


def test_scalars_across_lines_pages_and_long_lines(spark):
    long = "Versao " * 30_000
    pages = [
        ("a", 2, "x\n Processo SUSEP nº:\n12345.678901/2024-05 tail\nnext"), ("a", 1, "12345.67890/2024-05 too short"), ("a", 3, "11111.111111/1111-11"),
        ("b", 9, "Versão maio/2024"), ("b", 8, "new VERSAO Dezembro /\n2021, end"), ("c", 1, long), ("c", 2, "Versão 2024-13"), ("d", 1, None), (None, 1, "Versão 2020-01"), ("e", None, "Versão 2020-01"),
    ]
    began = time.time()
    got = scalars.found_scalars(spark.createDataFrame(pages, "document_id string, page_number int, raw_text string")).collect()
    assert time.time() - began < 20
    assert {(r.document_id, r.name): (r.value, r.page_number, r.excerpt) for r in got} == {
        ("a", "susep_process"): ("12345.678901/2024-05", 2, "Processo SUSEP nº:\n12345.678901/2024-05 tail"),
        ("b", "document_version"): ("2021-12", 8, "new VERSAO Dezembro /\n2021, end"),
        ("c", "document_version"): ("2024-13", 2, "Versão 2024-13"),
        (None, "document_version"): ("2020-01", 1, "Versão 2020-01"),
    }
