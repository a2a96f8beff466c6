"""Whole records: the outcomes that comparison, assembly, routing and support have to give on small cases."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import vocabulary
from ledgerloom.operators import evidence, nested, questions, record_cells, routing, taxonomy
from ledgerloom.sources import records as R
from ledgerloom.sources.shared import shared_folder


def record(policy, **more):
    text = lambda v, status="FOUND": {"status": status, "value": v}
    money = lambda n, raw: {"status": "FOUND", "value": {"kind": "MONEY", "numeric_value": n, "currency": "brl", "raw_text": raw}}
    terms = {"coverage_trigger": text(more.get("trigger", "claims made")), "premium": money(more.get("premium", "10000000"), more.get("raw", "x")), "currency": text("R$", more.get("currency", "FOUND"))}
    return {"policy_id": policy, "identification": {"insurer": text(more.get("insurer", "Acme"))}, "contractual_terms": terms, **{k: v for k, v in more.items() if k in R.RECORD.fieldNames()}}


@pytest.fixture(scope="module")
def compared(spark):
    import json

    limit = lambda scopes, n, name="Franquia": {"canonical_id": "deductible", "original_name": name, "value": {"kind": "MONEY", "numeric_value": n}, "applies_to": scopes}
    definition = lambda text: [{"original_term": "Perda", "definition_text": text}]
    rows = [
        record("a", trigger="À base de reclamações", premium="10000000", raw="dez milhões", coverages=[{"original_name": "Lado A", "category": "X", "conditions": ["b", "A"]}], definitions=definition("Toda  perda!"), policy_deductibles=[limit(["side_a"], "1"), limit(["Lado B"], "2"), limit(["side_b"], "3")]),
        record("b", premium="10000000.0", coverages=[{"canonical_id": "side_a", "original_name": "other name", "category": "x", "conditions": ["a", "B"]}], definitions=definition("toda perda"), policy_deductibles=[limit(["side_a"], "1.00")]),
        record("c", insurer="Other", currency="AMBIGUOUS", coverages=[{"original_name": "SIDE A", "category": "x", "conditions": ["a", "b"], "limits": [limit([], "5", "sub")]}], definitions=definition("other text"), policy_deductibles=[limit(["side_a"], "1"), limit(["nowhere"], "9")]),
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", R.RECORD).alias("r")).select("r.*")
    items = spark.createDataFrame([("coverages", "side_a", "Side A", 0), ("coverages", "side_b", "Side B", 1), ("definitions", "loss", "Loss", 0)], "category string, id string, label string, item_order int")
    aliases = spark.createDataFrame([("coverages", "side_a", "lado a"), ("coverages", "side_b", "lado b"), ("definitions", "loss", "perda")], "category string, id string, alias string")
    members = spark.createDataFrame([("p", x, i) for i, x in enumerate("abc")], "portfolio_id string, entity_id string, position int")
    got = record_cells.compare_records(df, members, items, taxonomy.alias_table(items, aliases)).collect()
    return {(r["section"], r["field_id"]): (r["status"], r["presence"]) for r in got}


def test_scalars(compared):
    assert compared["contractual_terms", "coverage_trigger"] == ("EQUAL", "3/3")  # other words, one code
    assert compared["contractual_terms", "premium"] == ("EQUAL", "3/3")  # other scale, other raw text
    assert compared["contractual_terms", "currency"] == ("NEEDS_REVIEW", "2/3")
    assert compared["identification", "insurer"] == ("DIFFERENT", "3/3")
    assert compared["identification", "insured"] == ("ALL_MISSING", "0/3")
    assert len([k for k in compared if k[0] in ("identification", "contractual_terms")]) == 15


def test_collections(compared):
    assert compared["coverages", "side_a"] == ("DIFFERENT", "3/3")  # the third has a limit of its own
    assert compared["definitions", "loss"] == ("DIFFERENT", "3/3")
    assert compared["policy_deductibles", "deductible::scope=side_a"] == ("EQUAL", "3/3")
    assert compared["policy_deductibles", "deductible::scope=side_b"] == ("NEEDS_REVIEW", "1/3")
    assert compared["policy_deductibles", "deductible::scope=unmapped:nowhere"] == ("ONLY_IN_SOME", "1/3")


def test_codes_and_ids(spark):
    rows = [("contractual_terms.geographic_scope", " Qualquer lugar do MUNDO "), ("contractual_terms.geographic_scope", "Brasil e Chile"), ("contractual_terms.jurisdiction", "Leis do Brasil"), ("contractual_terms.coverage_trigger", "Occurrence"), ("contractual_terms.coverage_trigger", "Reclamação com notificação, claims made"), ("identification.insurer", "Brasil"), ("contractual_terms.jurisdiction", "--"), ("contractual_terms.jurisdiction", None)]
    df = spark.createDataFrame(rows, "p string, v string")
    assert [r[0] for r in df.select(nested.contractual_code(F.col("p"), F.col("v"))).collect()] == ["WORLDWIDE", "BRASIL_E_CHILE", "BR", "OCCURRENCE", "CLAIMS_MADE_WITH_NOTIFICATION", None, None, None]
    ids = spark.createDataFrame([(" h ", "n", "d"), ("", " n", "d"), (None, " ", "d")], "h string, n string, d string")
    assert [r[0] for r in ids.select(nested.policy_id(F.col("h"), F.col("n"), F.col("d"))).collect()] == ["h", "n", "d"]
    assert spark.range(1).select(nested.stable(b=F.lit(None).cast("int"), a=F.lit("x"))).first()[0] == '{"a":"x","b":null}'


def test_issuer_and_modes(spark):
    text = "1.2 Seguradora:\nAcme Seguros S.A.\nsede\nCOBERTURA: garantia\n"
    rows = [(1, "d", 1, 0, text), (2, "d", 2, 0, "Refere-se a Acme Seguros S/A, S.A."), (3, "d", 3, 0, "seguradora de seguros s.a.")]
    chunks = routing.folded(spark.createDataFrame(rows, "chunk_id long, document_id string, page_number int, chunk_index int, text string"))
    assert {r["chunk_id"]: r["score"] for r in routing.identity_scores(chunks).collect()} == {1: 600, 2: 500}
    terms = spark.createDataFrame([("c", "definition", "cobertura", "cobertura"), ("g", "risk", "garantia", "garantia"), ("s", "clause", "sede", "sede")], "item string, mode string, term string, plain string")
    got = {(r["chunk_id"], r["item"]): r["score"] for r in routing.alias_scores(chunks, terms).collect()}
    assert got == {(1, "c"): 9 + 180 + 160 + 45 + 12, (1, "g"): 9 + 90 + 12, (1, "s"): 9 + 180 + 220 + 12}


def test_short_documents_without_a_score_keep_their_first_chunks(spark):
    rows = [(i, "d" if i < 6 else "e", i, 0, "nada" if i < 6 else "cobertura e exclusao" if i == 8 else "x") for i in range(10)]
    chunks = routing.folded(spark.createDataFrame(rows, "chunk_id long, document_id string, page_number int, chunk_index int, text string"))
    scores = routing.short_scores(chunks, vocabulary.terms(spark, vocabulary.KEYWORDS), vocabulary.terms(spark, vocabulary.HEADINGS))
    got = routing.short_routes(chunks, scores, "risk", 4).collect()
    assert sorted((r["document_id"], r["chunk_id"], r["score"]) for r in got) == [("d", 0, 0), ("d", 1, 0), ("d", 2, 0), ("d", 3, 0), ("e", 8, 6)]


def test_support_prefers_strong_headings_and_the_claimed_page(spark):
    pages = spark.createDataFrame([("d", 1, "Ver clausula de alocacao\nfim"), ("d", 2, "texto\nalocacao\nlinha"), ("d", 3, "21. Alocacao\nlinha um\nlinha dois")], "document_id string, page_number int, raw_text string")
    chunks = pages.select("document_id", "page_number", F.lit(0).alias("chunk_index"), F.concat(F.lit("c"), F.col("page_number").cast("string")).alias("chunk_id"), F.col("raw_text").alias("text"))
    wanted = spark.createDataFrame([(1, "d", 2, ["Alocação"]), (2, "d", None, ["alocacao"]), (3, "d", 9, ["nowhere"])], "claim_id int, document_id string, preferred_page int, terms array<string>")
    head = {r["claim_id"]: (r["page_number"], r["chunk_id"], r["excerpt"]) for r in evidence.find_support(wanted, chunks, pages, True).collect()}
    assert head == {1: (3, "c3", "21. Alocacao\nlinha um\nlinha dois"), 2: (3, "c3", "21. Alocacao\nlinha um\nlinha dois")}
    plain = {r["claim_id"]: (r["page_number"], r["excerpt"]) for r in evidence.find_support(wanted, chunks, pages, False).collect()}
    assert plain == {1: (2, "alocacao"), 2: (1, "Ver clausula de alocacao")}


def test_questions_fill_up_with_key_differences(spark):
    rows = spark.createDataFrame([("p", i, i, "s", f"f{i}", f"label {i}", "EQUAL" if i < 3 else "DIFFERENT", f"word{i}", i - 2 if i >= 3 else None) for i in range(12)], "portfolio_id string, row_id long, row_order long, section string, field_id string, label string, status string, search_text string, key_rank long")
    asked = spark.createDataFrame([(1, "p", "O que é comum?"), (2, "p", "word5 label 7"), (3, "p", "nothing known")], "question_id int, portfolio_id string, question string")
    got = {}
    for r in sorted(questions.question_rows(asked, rows).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["question_id"], []).append(r["row_id"])
    assert got == {1: [0, 1, 2, 3, 4, 5, 6], 2: [7, 5, 3, 4, 6, 8, 9], 3: [3, 4, 5, 6, 7, 8, 9]}


def test_runs_and_manifest_come_back(spark):
    path = shared_folder(spark, "manifest")
    jobs = spark.createDataFrame([("j", "d1", "f", "h", 2, "DONE"), ("j", "d2", "f", "h", None, "FAILED")], "job_id string, document_id string, source_file string, sha256 string, pages int, status string")
    R.add_to_manifest(jobs, path)
    R.add_to_manifest(jobs.where("document_id = 'd1'"), path)
    assert sorted(map(tuple, R.read_manifest(spark, path).collect())) == sorted(map(tuple, jobs.collect()))
    kept = spark.sql("select map('title', 't', 'x', 'y') m union all select null").select(R.kept_metadata(F.col("m"))).collect()
    assert sorted(str(r[0]) for r in kept) == ["{'title': 't'}", "{}"]
    assert Decimal("1.5") == spark.sql("select cast(1.5 as decimal(38,6)) d").first()[0]
