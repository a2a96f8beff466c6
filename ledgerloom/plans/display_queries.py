"""Queries on display text, labels and the scalars that patterns find in raw pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.operators import display, scalars
from ledgerloom.plans.registry import query, table

STATUSES = {"NOT_FOUND": "Não localizado"}
#: part as values of all kinds, by p_partkey % 9
VALUES = """v AS (SELECT p_partkey, p_name n, p_size z, p_brand b, p_partkey % 9 k, string_split(p_name, ' ') ws FROM part)"""
JSON = """CASE k WHEN 6 THEN '{"description":"' || n || '","conditions":["' || array_to_string(ws, '","') || '"],"exceptions":[]}' WHEN 7 THEN '{"kind":"MONEY","numeric_value":' || z || ',"currency":"BRL","unit":null}' END"""


def values_of(spark, sf_dir) -> DataFrame:
    words = F.split("p_name", " ")
    size = F.col("p_size")
    no = F.lit(None).cast("string")
    value = (
        F.when(F.col("k") == 1, F.to_json(F.array("p_name")).substr(F.lit(2), F.length(F.to_json(F.array("p_name"))) - 2))
        .when(F.col("k") == 2, F.to_json(F.struct(F.lit("2024-01-05").alias("start"), no.alias("end")), {"ignoreNullFields": "false"}))
        .when(F.col("k") == 3, F.to_json(F.struct(F.concat(F.lit("R$ "), size.cast("string")).alias("raw_text"))))
        .when(F.col("k") == 4, F.to_json(F.struct(F.struct(F.concat(size.cast("string"), F.lit(" mil")).alias("normalized_text")).alias("value"), F.lit("x").alias("applies_to"))))
        .when(F.col("k") == 5, F.to_json(words))
        .when(F.col("k") == 6, F.to_json(F.struct(F.col("p_name").alias("description"), words.alias("conditions"), F.array().cast("array<string>").alias("exceptions"))))
        .when(F.col("k") == 7, F.to_json(F.struct(F.lit("MONEY").alias("kind"), size.alias("numeric_value"), F.lit("BRL").alias("currency"), no.alias("unit")), {"ignoreNullFields": "false"}))
        .when(F.col("k") == 8, size.cast("string"))
    )
    parts = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey") % 9)
    return parts.select("p_partkey", "p_brand", "p_size", value.alias("value"), (F.col("p_size") % 4 != 0).alias("present"), F.when(F.col("p_size") % 8 == 0, "NOT_FOUND").when(F.col("p_size") % 8 == 4, "NOT_APPLICABLE").alias("status"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("name"))


@query(f"""WITH {VALUES}, s AS (SELECT *, CASE k WHEN 0 THEN 'Não identificado' WHEN 1 THEN n WHEN 2 THEN '05/01/2024 a ?' WHEN 3 THEN 'R$ ' || z WHEN 4 THEN z || ' mil' WHEN 5 THEN len(ws) || ' ocorrência(s)' WHEN 6 THEN 'Dados estruturados disponíveis' WHEN 7 THEN 'MONEY · ' || z || ' · BRL' ELSE z::VARCHAR END t FROM v)
SELECT p_partkey, CASE WHEN z % 8 = 0 THEN 'Não localizado' WHEN z % 8 = 4 THEN 'Not Applicable' WHEN k IN (2, 3, 4) THEN t WHEN z % 3 = 0 THEN b ELSE t END AS shown FROM s""")
def cell_display(spark, sf_dir):
    col = F.col
    return values_of(spark, sf_dir).select("p_partkey", display.cell_text(col("present"), col("status"), col("name"), col("value"), STATUSES).alias("shown"))


@query(f"""WITH {VALUES}, s AS (SELECT *, CASE k WHEN 0 THEN 'Não identificado' WHEN 1 THEN n WHEN 2 THEN '2024-01-05 → ?' WHEN 3 THEN 'R$ ' || z WHEN 4 THEN '{{"value":{{"normalized_text":"' || z || ' mil"}},"applies_to":"x"}}' WHEN 5 THEN len(ws) || ' ocorrência(s)' WHEN 8 THEN z::VARCHAR ELSE {JSON} END t FROM v)
SELECT p_partkey, CASE WHEN z % 8 = 0 THEN '— (NOT_FOUND)' WHEN z % 8 = 4 THEN '— (NOT_APPLICABLE)' ELSE (CASE WHEN length(x) > 40 THEN substr(x, 1, 39) || '…' ELSE x END) || ' [p.' || CASE WHEN z < 7 THEN z || ',7' WHEN z = 7 THEN '7' ELSE '7,' || z END || ']' END AS shown FROM (SELECT *, CASE WHEN z % 3 = 0 THEN b ELSE t END x FROM s)""")
def report_display(spark, sf_dir):
    col = F.col
    pages = F.array(col("p_size").cast("int"), F.lit(7), col("p_size").cast("int"))
    return values_of(spark, sf_dir).select("p_partkey", display.report_text(col("present"), col("status"), col("name"), col("value"), pages, 40).alias("shown"))


@query(f"""WITH {VALUES} SELECT p_partkey, CASE k WHEN 0 THEN 'Não identificado' WHEN 1 THEN n WHEN 2 THEN '2024-01-05 a ?' WHEN 3 THEN 'R$ ' || z WHEN 4 THEN z || ' mil' WHEN 5 THEN array_to_string(ws[1:8], '; ') WHEN 6 THEN n || ' | Condições: ' || array_to_string(ws[1:3], '; ') WHEN 7 THEN {JSON} ELSE z::VARCHAR END AS shown FROM v""")
def answer_display(spark, sf_dir):
    return values_of(spark, sf_dir).select("p_partkey", display.answer_text(F.col("value")).alias("shown"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_custkey % 3 > 0 THEN o_orderpriority || ' — product ' || o_custkey WHEN o_orderstatus = 'F' THEN o_orderpriority WHEN o_custkey % 3 > 0 THEN 'product ' || o_custkey ELSE o_orderkey::VARCHAR END AS label,
CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 'Now' ELSE substr(o_orderpriority, 1, 6) END AS head, 'Order ' || o_orderkey || ' Final' AS file FROM orders""")
def record_labels(spark, sf_dir):
    known = {"urgent": "Now"}
    status = lambda test: F.when(test, "FOUND").otherwise("NOT_FOUND")
    product = F.concat(F.lit("product "), F.col("o_custkey").cast("string"))
    label = display.record_label(status(F.col("o_orderstatus") == "F"), F.col("o_orderpriority"), status(F.col("o_custkey") % 3 > 0), product, F.col("o_orderkey").cast("string"))
    file = display.file_label(F.concat(F.lit("/in/acme_order-"), F.col("o_orderkey").cast("string"), F.lit("__final.pdf")), r"acme[_\- ]*")
    return table(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"), display.column_label(F.col("o_orderpriority"), product, known, 6).alias("head"), file.alias("file"))


#: lines of orders as pages: a number on every third page, a version on every fifth, by month and year on the even ones; pages go on beyond the eighth
SCALAR_PAGES = """page AS (SELECT l_orderkey d, 3 * l_linenumber - 2 p, l_partkey k, lpad((l_partkey % 100000)::VARCHAR, 5, '0') || '.' || lpad(l_suppkey::VARCHAR, 6, '0') || '/2024-07' num, CASE WHEN l_partkey % 2 = 0 THEN 'Março / 2023' ELSE '2023-11' END ver FROM lineitem)"""


def scalar_pages(spark, sf_dir) -> DataFrame:
    key = F.col("l_partkey")
    number = F.concat(F.lpad((key % 100000).cast("string"), 5, "0"), F.lit("."), F.lpad(F.col("l_suppkey").cast("string"), 6, "0"), F.lit("/2024-07"))
    named = F.when(key % 2 == 0, "Março / 2023").otherwise("2023-11")
    line = lambda test, text: F.when(test, text).otherwise("nothing here")
    text = F.concat_ws("\n", F.lit("first line"), line(key % 3 == 0, F.concat(F.lit("  processo SUSEP nº: "), number, F.lit(" end"))), line(key % 5 == 0, F.concat(F.lit("doc VERSÃO "), named, F.lit(" rev."))))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), (3 * F.col("l_linenumber") - 2).alias("page_number"), text.alias("raw_text"))


@query(f"""WITH {SCALAR_PAGES}, hit AS (SELECT d, p, 'susep_process' AS name, num value, num raw, 'processo SUSEP nº: ' || num || ' end' line FROM page WHERE k % 3 = 0 UNION ALL
SELECT d, p, 'document_version', CASE WHEN k % 2 = 0 THEN '2023-03' ELSE '2023-11' END, ver, 'doc VERSÃO ' || ver || ' rev.' FROM page WHERE k % 5 = 0 AND p <= 8)
SELECT d AS document_id, name, value, raw AS raw_value, p::BIGINT AS page_number, line AS excerpt FROM (SELECT *, row_number() OVER (PARTITION BY d, name ORDER BY p, raw) r FROM hit) WHERE r = 1""")
def document_scalars(spark, sf_dir):
    got = scalars.found_scalars(scalar_pages(spark, sf_dir))
    return got.withColumn("page_number", F.col("page_number").cast("long")).drop("section")
