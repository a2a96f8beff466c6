import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import assemble, compare, evaluate, evidence, pages, retrieve, scoring, serve, taxonomy
from ledgerloom.sources import records
from ledgerloom.streaming import incremental

CELL = "portfolio_id int, entity_id string, section string, field_id string, label string, state string, key string, name string"


def members(spark, *ids):
    return spark.createDataFrame([(1, e, i) for i, e in enumerate(ids)], "portfolio_id int, entity_id string, position int")


def cell(entity, field, key, state="FOUND", name="n"):
    return (1, entity, "terms", field, field, state, key, name)


def test_statuses(spark):
    cells = spark.createDataFrame([cell("a", "same", "x"), cell("b", "same", "x"), cell("c", "same", "x"), cell("a", "other", "x"), cell("b", "other", "y"), cell("c", "other", "x"), cell("b", "some", "x"), cell("a", "twice", "x"), cell("a", "twice", "y"), cell("a", "odd", "x", "AMBIGUOUS"), cell("a", "none", "x", "NOT_FOUND")], CELL)
    rows = compare.comparison_rows(cells, members(spark, "a", "b", "c"))
    got = {r["field_id"]: (r["status"], r["presence"]) for r in rows.collect()}
    assert got == {"same": ("EQUAL", "3/3"), "other": ("DIFFERENT", "3/3"), "some": ("ONLY_IN_SOME", "1/3"), "twice": ("NEEDS_REVIEW", "1/3"), "odd": ("NEEDS_REVIEW", "0/3"), "none": ("ALL_MISSING", "0/3")}
    one = compare.summary(rows).first()
    assert one["row_count"] == sum(one[k] for k in ("equal", "different", "only_in_some", "all_missing", "needs_review")) == 6
    assert compare.matrix(cells, members(spark, "a", "b", "c")).count() == 18
    lists = {r["field_id"]: (r["present_ids"], r["missing_ids"]) for r in compare.presence(cells, members(spark, "c", "b", "a")).collect()}
    assert lists["some"] == (["b"], ["c", "a"])
    assert [(r["entity_id"], r["items"]) for r in compare.duplicates(cells).collect()] == [("a", 2)]
    top = [r["field_id"] for r in compare.key_differences(rows, ["terms"], 3).orderBy("rank").collect()]
    assert top == ["odd", "twice", "some"]


def test_empty_portfolio(spark):
    cells = spark.createDataFrame([], CELL)
    assert compare.comparison_rows(cells, members(spark, "a")).count() == 0


def test_families(spark):
    concepts = spark.createDataFrame([("k", "K", "terms", "f1"), ("k", "K", "terms", "f2"), ("z", "Z", "terms", "f9")], "concept_id string, concept_label string, section string, field_id string")
    cells = spark.createDataFrame([cell("a", "f1", "x"), cell("b", "f2", "y")], CELL)
    got = {r["concept_id"]: r["status"] for r in compare.harmonized(cells, members(spark, "a", "b"), concepts).collect()}
    assert got == {"k": "PRESENT_IN_ALL", "z": "ABSENT_IN_ALL"}


def test_margins_are_removed_and_bodies_kept(spark):
    texts = [(1, p, f"HEADER X\nbody line {p} a\nbody b{p}\nbody c{p}\nbody d{p}\nbody e{p}\nPágina {p}") for p in range(1, 6)]
    df = spark.createDataFrame(texts, "document_id long, page_number int, raw_text string")
    lines = pages.page_lines(df)
    margins = pages.repeated_margins(lines, df)
    assert {r["key"] for r in margins.collect()} == {"header x", "<PAGE_NUMBER>"}
    got = pages.without_margins(lines, margins).orderBy("page_number").first()
    assert got["clean_text"] == "body line 1 a\nbody b1\nbody c1\nbody d1\nbody e1" and got["removed_lines"] == ["HEADER X", "Página 1"]


def test_chunks_have_exact_offsets(spark):
    text = " ".join(f"palavra{i:03d}" for i in range(400))
    df = spark.createDataFrame([("doc", 1, text), ("none", 1, None), ("blank", 1, "  ")], "document_id string, page_number int, clean_text string")
    got = pages.chunks(df, size=600, overlap=100).orderBy("chunk_index").collect()
    assert all(text[r["char_start"] : r["char_end"]] == r["text"] and len(r["text"]) <= 600 for r in got)
    assert got[0]["chunk_id"] == "doc:p0001:c000" and got[-1]["char_end"] == len(text)
    with pytest.raises(ValueError):
        pages.chunks(df, size=10, overlap=10)


def test_second_reading_only_replaces_poor_pages(spark):
    df = spark.createDataFrame([(1, 1, "x" * 100), (1, 2, ""), (1, 3, "short")], "document_id int, page_number int, raw_text string")
    readings = spark.createDataFrame([(1, 1, "other"), (1, 2, "read again"), (1, 3, "  ")], "document_id int, page_number int, reading string")
    got = [(r["raw_text"][:10], r["text_origin"]) for r in pages.second_reading(df, readings).orderBy("page_number").collect()]
    assert got == [("x" * 10, "NATIVE"), ("read again", "SECOND_READING"), ("short", "NATIVE")]
    assert pages.unusable(df).count() == 0


def test_taxonomy(spark):
    items = spark.createDataFrame([("c", "fire", "Fire"), ("c", "fire", "Fire"), ("c", "flood", "Flood")], "category string, id string, label string")
    aliases = spark.createDataFrame([("c", "fire", "Incêndio"), ("c", "flood", "incendio"), ("c", "fire", "--")], "category string, id string, alias string")
    assert {(r["rule"], r["subject"]) for r in taxonomy.checks(items, aliases).collect()} == {("duplicate_id", "fire"), ("empty_alias", "fire"), ("alias_collision", "incendio")}
    facts = spark.createDataFrame([(1, "c", "flood", "x"), (2, "c", None, "FIRE!"), (3, "c", "bad", "Wind"), (4, "c", None, None)], "n int, category string, given_id string, name string")
    got = {r["n"]: (r["item_key"], r["normalization_confidence"]) for r in taxonomy.resolved(facts, items, taxonomy.alias_table(items, aliases)).collect()}
    assert got == {1: ("flood", 1.0), 2: ("fire", 0.9), 3: ("unmapped:wind", 0.0), 4: ("unmapped:unnamed", 0.0)}
    terms = spark.range(1).select(taxonomy.recovery_terms(F.lit("Responsabilidade Civil"), F.array(F.lit("RC"), F.lit("resp civil")), F.lit("RESPONSABILIDADE CIVIL")).alias("t")).first()["t"]
    assert terms == ["responsabilidade civil", "resp civil"]


def test_alias_scores_prefer_headings(spark):
    chunks = spark.createDataFrame([("a", "d", 1, 0, "4.1 Limite\ntexto"), ("b", "d", 2, 0, "o limite e o limite"), ("c", "d", 3, 0, "limites")], "chunk_id string, document_id string, page_number int, chunk_index int, text string")
    terms = spark.createDataFrame([("limit", "limite")], "item string, term string")
    scores = scoring.alias_scores(scoring.folded(chunks), terms)
    got = {r["chunk_id"]: r["score"] for r in scores.collect()}
    assert got == {"a": 8 + 1 + 320 + 180 + 12, "b": 8 + 2 + 12}
    assert scoring.best_chunk(scores, chunks, ["document_id", "item"]).first()["chunk_id"] == "a"
    top = scoring.routed([scores.withColumnRenamed("item", "profile")], chunks, 1).collect()
    assert [r["chunk_id"] for r in top] == ["a"]


def test_evidence(spark):
    chunks = spark.createDataFrame([("d", "k", 2, "O limite  máximo de\ngarantia é este aqui, e não outro.")], "document_id string, chunk_id string, page_number int, text string")
    claims = spark.createDataFrame([("d", 1, "k", 2, "limite máximo de garantia"), ("d", 2, "k", 1, "limite"), ("d", 3, "z", 2, "limite"), ("d", 4, "k", 2, "O limite máximo de\ngarantia é este aqui, e nao outro.")], "document_id string, claim_id int, chunk_id string, page_number int, excerpt string")
    got = evidence.validated(claims, chunks)
    assert {r["claim_id"]: r["reason"] for r in got.collect()} == {1: "VALID", 2: "PAGE_MISMATCH", 3: "UNKNOWN_CHUNK", 4: "NOT_FOUND"}
    fixed = evidence.repaired(claims.where("claim_id = 4"), chunks).collect()
    assert len(fixed) == 1 and fixed[0]["similarity"] >= 0.97
    rate = evidence.report(got, "document_id").first()
    assert (rate["total"], rate["valid"], rate["validity_rate"]) == (4, 1, 0.25)
    needles = spark.createDataFrame([(1, "limite máximo de garantia"), (2, "este aqui"), (3, "absent words of an item")], "claim_id int, excerpt string")
    assert {r["claim_id"] for r in evidence.containing(needles, chunks).collect()} == {1, 2}


def test_metrics(spark):
    e = spark.createDataFrame([("a", 1), ("a", 2), ("a", None), ("b", 1)], "g string, x int")
    x = spark.createDataFrame([("a", 2), ("a", 3), ("a", 3), ("c", 9)], "g string, x int")
    got = {r["g"]: (r["precision"], r["recall"], r["f1"]) for r in evaluate.set_metrics(e, x, "g", "x").collect()}
    assert got == {"a": (0.5, 0.5, 0.5), "b": (0.0, 0.0, 0.0), "c": (0.0, 1.0, 0.0)}
    one = evaluate.overlap(e, e).first()
    assert one["accuracy"] == 1.0 and one["missing"] == one["extra"] == 0
    gold = spark.createDataFrame([("bad_kind",), ("field_status",)], "kind string")
    assert evaluate.unknown_kinds(gold).count() == 1


def test_retrieval(spark):
    q = spark.createDataFrame([(1, "limite de garantia"), (2, "  "), (3, "x" * 1201)], "question_id int, question string")
    assert {r["question_id"]: r["verdict"] for r in retrieve.accepted(q).collect()} == {1: "OK", 2: "EMPTY", 3: "TOO_LONG"}
    rows = spark.createDataFrame([(1, "Garantia e limite"), (2, "limite"), (3, "nada")], "row_id int, search_text string")
    got = retrieve.top(retrieve.shared_tokens(q, rows, stop=["de"]), 7).orderBy("rank").collect()
    assert [(r["row_id"], r["score"]) for r in got] == [(1, 10), (2, 5)]
    answers = spark.createDataFrame([(1, "See [E2] and [E9].", ["E1"]), (2, "none", None)], "answer_id int, answer string, cited array<string>")
    ids = spark.createDataFrame([(1, ["E1", "E2"])], "answer_id int, ids array<string>")
    got = {r["answer_id"]: (r["valid_ids"], r["invalid_ids"]) for r in retrieve.citations(answers, ids).collect()}
    assert got == {1: (["E1", "E2"], ["E9"]), 2: ([], [])}


def test_assembly(spark):
    df = spark.createDataFrame([("FOUND", None, None, None), ("FOUND", "n", "r", None), ("AMBIGUOUS", "n", None, None), ("NOT_FOUND", None, None, "f")], "s string, n string, r string, f string")
    got = [tuple(r["v"]) for r in df.select(assemble.field(F.col("s"), F.col("n"), F.col("r"), F.col("f")).alias("v")).collect()]
    assert got == [("NOT_FOUND", None, None), ("FOUND", "n", None), ("NOT_FOUND", None, "was ambiguous"), ("FOUND", "f", None)]


def test_labels_are_told_apart(spark):
    df = spark.createDataFrame([(1, "A", "x"), (2, "A", "y"), (3, "A", "y"), (4, "B", "x")], "entity_id int, label string, suffix string")
    got = [r["unique_label"] for r in compare.unique_labels(df, "label", "suffix").orderBy("entity_id").collect()]
    assert got == ["A - x", "A - y (1)", "A - y (2)", "B"]
    assert serve.sections_in_order(spark.createDataFrame([("s", 3), ("s", 1)], "section string, p int"), "p").first()["first_pos"] == 1


def test_record_files(spark, tmp_path):
    bare = {"policy_id": "p1", "source_documents": [{"document_id": "d"}], "identification": {"insurer": {"status": "FOUND", "value": "X"}}, "contractual_terms": {"currency": {"status": "NOT_FOUND"}}, "extraction": {"schema_version": "1"}}
    for name, body in (("a", bare), ("b", {"policy_json": bare | {"policy_id": "p2"}}), ("c", {"policy": bare | {"policy_id": "p3"}}), ("d", {"other": 1})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    (tmp_path / "e.json").write_text("{broken")
    good, bad = records.read_records(spark, str(tmp_path))
    assert [r["policy_id"] for r in good.orderBy("policy_id").collect()] == ["p1", "p2", "p3"]
    assert {r["path"][-6:]: r["reason"] for r in bad.collect()} == {"d.json": "no record under a known name", "e.json": "not JSON"}
    assert [(r["entity_id"], r["position"]) for r in records.portfolio(good, "all").orderBy("position").collect()] == [("p1", 1), ("p2", 2), ("p3", 3)]
    assert records.portfolio(good.limit(1), "one").count() == 0
    assert records.identified_files(spark, str(tmp_path)).where("document_id like 'a-%'").count() == 1


def test_dictionaries(spark, tmp_path):
    (tmp_path / "perils.json").write_text(json.dumps({"items": [{"id": "fire", "label": "Fire", "aliases": ["blaze"]}, {"id": "flood", "label": "Flood"}]}))
    items, aliases = records.read_dictionary(spark, str(tmp_path))
    assert [(r["category"], r["id"], r["item_order"]) for r in items.orderBy("id").collect()] == [("perils", "fire", 0), ("perils", "flood", 1)]
    assert [r["alias"] for r in aliases.collect()] == ["blaze"]


def test_responses(spark):
    df = spark.createDataFrame([(1, 'Sure:\n```json\n{"k": 4}\n```'), (2, "no value"), (3, '{"x": 1}')], "i int, t string")
    got = {r["i"]: (r["parsed"]["k"] if r["parsed"] else None, r["reason"]) for r in records.parsed_responses(df, "t", "k long").collect()}
    assert got == {1: (4, None), 2: (None, "no JSON value"), 3: (None, "schema mismatch")}


def test_stream_takes_each_file_once(spark, tmp_path):
    df = spark.range(10).withColumnRenamed("id", "x")
    run = lambda: incremental.run_available(spark, f"{tmp_path}/in", df.schema, lambda d: d, f"{tmp_path}/out", f"{tmp_path}/cp")
    df.write.parquet(f"{tmp_path}/in")
    run()
    df.write.mode("append").parquet(f"{tmp_path}/in")
    run()
    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20
