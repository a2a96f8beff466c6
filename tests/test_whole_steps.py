"""Whole records in one exchange, stages by length of document, bits of members, ids guarded over runs, chunk ids."""

import re

from pyspark.sql import functions as F

from ledgerloom.operators import assembly, compare, pages, routing
from ledgerloom.sources import records
from ledgerloom.streaming import incremental


def test_records_from_facts_take_one_exchange(spark):
    facts = spark.createDataFrame([("d1", "insurer", 1, "FOUND", " X "), ("d1", "insurer", 2, "FOUND", "Y"), ("d1", "insured", 1, "AMBIGUOUS", "Z"), ("d1", "policy_start", 1, "FOUND", "2024-01-01"), ("d1", "policy_end", 1, "FOUND", "2025-01-01"), ("d1", "retroactive_date", 1, "FOUND", "soon"), ("d1", "extended_reporting_period", 1, "FOUND", "por 12,5 meses"), ("d1", "jurisdiction", 1, "FOUND", "Brasil"), ("d1", "no such field", 1, "FOUND", "q"), ("d2", "policy_number", 1, "FOUND", "77")], "document_id string, field_id string, pos int, status string, raw string")
    items = spark.createDataFrame([("d1", "coverages", 1, "c1", "A", 0.9), ("d1", "coverages", 2, None, "B", 0.9), ("d1", "exclusions", 3, "e", "C", None), ("d1", "unknown", 4, "e", "C", None)], "document_id string, field_id string, pos int, canonical_id string, raw string, given_confidence double")
    money = spark.createDataFrame([("d1", "premium", 2, None, 5.0), ("d1", "premium", 1, None, 4.0), ("d1", "deductible", 3, None, 1.0), ("d1", "aggregate_limit", 4, None, 9.0), ("d1", "sub", 2, 1, 7.0), ("d1", "sub", 2, 0, 6.0), ("d3", "other", 1, None, 1.0)], "document_id string, field_id string, pos int, inner_pos int, amount double")
    clauses = spark.createDataFrame([("d1", 2, "k2", "two"), ("d1", 1, None, "one")], "document_id string, pos int, canonical_id string, raw string")
    every = assembly.put_together(*(assembly.tagged(k, x) for k, x in (("fact", facts), ("item", items), ("money", money), ("clause", clauses))))
    got = assembly.assembled(every)
    rows = {r["document_id"]: r.asDict(True) for r in got.collect()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan.split("== Initial Plan ==")[-1])) == 1 and "Join" not in plan
    one = rows["d1"]
    assert one["identification"]["insurer"] == {"status": "FOUND", "value": "Y", "note": None} and one["identification"]["insured"]["status"] == "NOT_FOUND"
    terms = one["contractual_terms"]
    assert str(terms["policy_period"]["end"]) == "2025-01-01" and terms["retroactive_date"] == {"status": "NOT_FOUND", "value": None}
    assert terms["extended_reporting_period"]["value"]["unit"] == "months" and float(terms["extended_reporting_period"]["value"]["number"]) == 12.5
    assert terms["jurisdiction_canonical"] == "BR" and float(terms["premium"]["value"]) == 4.0
    assert [float(x["amount"]) for x in one["policy_limits"]] == [9.0] and [x["canonical_id"] for x in one["policy_deductibles"]] == ["deductible"]
    a, b = one["coverages"]
    assert (a["normalization_confidence"], a["category"], a["limits"]) == (0.9, "MAIN_COVERAGE", []) and b["normalization_confidence"] == 0.0
    assert [(float(x["amount"]), x["applies_to"]) for x in b["limits"]] == [(6.0, []), (7.0, [])]
    assert [x["original_name"] for x in one["exclusions"]] == ["C"] and one["extensions"] == [] and [x["name"] for x in one["clauses"]] == ["one", "two"]
    assert rows["d2"]["policy_id"] == "77" and rows["d3"]["policy_id"] == "d3" and rows["d3"]["coverages"] == []


def test_stages_by_length_of_document(spark):
    """A document of 24 pages has three stages, one of 25 has five; a stage without any hit reads a short document's first chunks."""
    rows = [(f"{d}-{p}", d, p, 0, f"pagina {p}\n{p}. Segurado: quem\nexclusao de multas" if d != "plain" else "nada") for d, n in (("short", 24), ("long", 25), ("plain", 2)) for p in range(1, n + 1)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, page_number int, chunk_index int, text string")
    dictionary = spark.createDataFrame([("definitions", "segurado", "segurado", None), ("exclusions", "multas", "multas", None)], "category string, item string, term string, plain string")
    words = spark.createDataFrame([(p, w) for p in ("core", "risk", "semantic", "coverages_extensions", "exclusions", "definitions", "clauses") for w in ("multas",)], "profile string, term string")
    heads = spark.createDataFrame([("risk", "exclusao de")], "profile string, term string")
    terms = routing.stage_terms(dictionary, words, heads, spark.createDataFrame([], "profile string, term string"))
    got = routing.planned(chunks, chunks.select("document_id", "page_number", F.col("text").alias("raw_text")), terms, "^condicoes").collect()
    stages = {d: sorted({r["stage"] for r in got if r["document_id"] == d}) for d in ("short", "long", "plain")}
    assert stages["long"] == sorted(routing.LONG_STAGES) and stages["short"] == stages["plain"] == sorted(routing.SHORT_STAGES)
    of = lambda d, s: sorted((r["reading_order"], r["chunk_id"], r["score"]) for r in got if r["document_id"] == d and r["stage"] == s)
    assert of("plain", "core") == [(1, "plain-1", 0), (2, "plain-2", 0)]
    assert of("short", "risk") == [(i, f"short-{i}", 53) for i in range(1, 5)]
    best = [x for x in of("long", "definitions") if x[2] > 5000]
    assert best == [(1, "long-1", 5000 + 8 + 1 + 12 + 180 + 270)]
    assert len(of("long", "risk_exclusions")) == 14 and len(of("long", "core")) == 14


def test_members_are_bits(spark):
    """More members than a word has bits, positions with gaps, fields that some do not have."""
    members = spark.createDataFrame([(1, f"e{i:03d}", i * 3) for i in range(150)] + [(2, "x", 0)], "portfolio_id int, entity_id string, position int")
    cells = [(1, f"e{i:03d}", "s", "even" if i % 2 == 0 else "odd", "L", "FOUND", "k", "n") for i in range(150)] + [(1, "e000", "s", "none", "L", "NOT_FOUND", None, None), (2, "x", "s", "even", "L", "AMBIGUOUS", None, None)]
    cells = spark.createDataFrame(cells, "portfolio_id int, entity_id string, section string, field_id string, label string, state string, key string, name string")
    got = {(r["portfolio_id"], r["field_id"]): (r["present_ids"], r["missing_ids"]) for r in compare.presence(cells, members).collect()}
    names = [f"e{i:03d}" for i in range(150)]
    assert got == {(1, "even"): (names[::2], names[1::2]), (1, "odd"): (names[1::2], names[::2]), (1, "none"): ([], names), (2, "even"): ([], ["x"])}
    concepts = spark.createDataFrame([("c", "C", "s", "even"), ("c", "C", "s", "odd"), ("d", "D", "s", "odd"), ("z", "Z", "s", "zero")], "concept_id string, concept_label string, section string, field_id string")
    got = {(r["portfolio_id"], r["concept_id"]): (r["present_count"], r["status"]) for r in compare.harmonized(cells, members, concepts).collect()}
    assert got[1, "c"] == (150, "PRESENT_IN_ALL") and got[1, "d"] == (75, "PRESENT_IN_SOME") and got[1, "z"] == (0, "ABSENT_IN_ALL") and got[2, "c"] == (0, "NEEDS_REVIEW")


def test_ids_are_refused_in_later_runs(spark, tmp_path):
    base = f"file://{tmp_path}"
    schema = "id string, n int, note string"
    runs = [[("a", 2, "second"), ("a", 10, "third"), ("b", 1, None), (None, 1, "x")], [("a", 1, "late"), ("c", 1, "new"), (None, 0, "y")], [("c", 5, "again")]]
    for rows in runs:
        df = spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("append").parquet(f"{base}/in")
        incremental.run_guarded(spark, f"{base}/in", df.schema, "id", "n", f"{base}/out", f"{base}/checkpoint")
    read = lambda name: sorted(((r["id"], r["n"], r["note"]) for r in spark.read.parquet(f"{base}/out/{name}").collect()), key=str)
    assert read("taken") == sorted([("a", 2, "second"), ("b", 1, None), (None, 1, "x"), ("c", 1, "new")], key=str)
    assert read("refused") == sorted([("a", 10, "third"), ("a", 1, "late"), (None, 0, "y"), ("c", 5, "again")], key=str)


def test_chunk_ids_are_never_cut(spark):
    text = " ".join(["word"] * 3000)
    got = pages.chunks(spark.createDataFrame([("d", 1000, text), ("d", 10000, text)], "document_id string, page_number int, clean_text string"), size=12, overlap=2, back=5)
    ids = [r["chunk_id"] for r in got.select("chunk_id").collect()]
    assert len(ids) > 2200 and len(set(ids)) == len(ids) and "d:p10000:c1001" in ids and "d:p1000:c007" in ids


def test_dictionaries_of_many_categories(spark, tmp_path):
    items = spark.createDataFrame([(f"kind {i}/x", 0, "id", "Label", ["a", "b"], None) for i in range(1100)], "category string, item_order int, id string, label string, aliases array<string>, description string")
    records.write_dictionary(items.repartition(4), f"file://{tmp_path}/d")
    got, aliases = records.read_dictionary(spark, f"file://{tmp_path}/d")
    assert got.select("category").distinct().count() == 1100 and aliases.count() == 2200
