"""The store of ingested documents: rows, plans without exchange, one bucket for one document, skew, rejects."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import evidence
from ledgerloom.sources import ingest
from ledgerloom.sources.shared import shared_folder

LONG = "palavra " * 30


@pytest.fixture(scope="module")
def store(spark):
    rows = [(f"d{i}", p, f"Header line\n{LONG}{i} {p}\nmiddle\nother\n" if p < 4 else "", "NATIVE" if p < 3 else "SECOND_READING", ["old", "old"]) for i in range(12) for p in range(1, 5)]
    rows += [(None, 1, "no document", None, None), ("d0", None, "no page", None, None)]
    pages = spark.createDataFrame(rows, "document_id string, page_number int, raw_text string, text_origin string, document_warnings array<string>")
    path = shared_folder(spark, "store-test")
    return path, ingest.ingest(pages, path, buckets=8, spread=2, size=100, overlap=10, back=20)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    ingest.join_by_buckets(spark)
    yield
    spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_headers(store):
    got = {r.document_id: r for r in store[1]["documents"].collect()}
    assert len(got) == 12
    one = got["d3"]
    assert (one.page_count, one.native_pages, one.recovered_pages, one.low_pages, one.empty_pages) == (4, 2, 1, 0, 1)
    assert one.warnings == ["old", "1 page(s) taken from a second reading", "1 page(s) with little or no text"]
    assert one.margin_lines == ["Header line", "middle", "other"]
    assert one.chunk_count == store[1]["chunks"].where("document_id = 'd3'").count() > 3


def test_rejects_are_kept_apart(store):
    assert sorted(r.raw_text for r in store[1]["rejects"].collect()) == ["no document", "no page"]
    assert store[1]["pages"].count() == 48


def test_joins_and_groups_by_document_have_no_exchange(spark, store, no_broadcast):
    tables = store[1]
    for df in (ingest.chunks_by_page(tables), tables["documents"].join(tables["pages"], "document_id").join(tables["chunks"], "document_id"), tables["pages"].groupBy("document_id").count(), ingest.headers(tables["pages"], tables["chunks"])):
        assert "Exchange" not in plan_of(df), plan_of(df)


def test_claims_go_to_the_chunks(spark, store, no_broadcast):
    """Only the claims are exchanged; the store's chunks stay where they are."""
    chunk = store[1]["chunks"].orderBy("document_id", "page_number", "chunk_index").first()
    claims = spark.createDataFrame([(chunk.document_id, 1, chunk.chunk_id, 1, chunk.text[:20]), (chunk.document_id, 2, chunk.chunk_id, 1, "absent")], "document_id string, claim_id int, chunk_id string, page_number int, excerpt string")
    by_document = claims.repartition(8, "document_id")
    got = evidence.validated(by_document, store[1]["chunks"])
    assert plan_of(got).count("Exchange hashpartitioning") == 1, plan_of(got)
    assert {r.claim_id: r.reason for r in got.collect()} == {1: "VALID", 2: "NOT_FOUND"}


def test_one_document_is_read_from_one_bucket(spark, store):
    assert ingest.page(store[1], "d5", 2).count() == 1
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # only so is the number of buckets in the plan
    try:
        assert "SelectedBucketsCount: 1 out of 8" in plan_of(ingest.page(store[1], "d5", 2))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_opened_again_without_the_catalog(spark, store):
    path, made = store
    want = {name: sorted(map(str, made[name].collect())) for name in ("documents", "pages", "chunks")}
    for name in want:
        spark.sql(f"DROP TABLE {ingest.table_name(path, name)}")
    again = ingest.opened(spark, path)
    assert {name: sorted(map(str, again[name].collect())) for name in want} == want
    assert "Exchange" not in plan_of(again["pages"].groupBy("document_id").count())
    plain = ingest.opened(spark, path, skew=0.0, task_rows=0)
    assert {name: sorted(map(str, plain[name].collect())) for name in want} == want
    assert "SelectedBuckets" not in plan_of(ingest.page(plain, "d5", 2))


def test_no_pages_at_all(spark):
    pages = spark.createDataFrame([], "document_id string, page_number int, raw_text string")
    got = ingest.ingest(pages, shared_folder(spark, "store-empty"), buckets=4)
    assert [got[x].count() for x in ("documents", "pages", "chunks", "rejects")] == [0, 0, 0, 0]


def test_warnings_of_documents_once_in_order(spark):
    row = spark.range(1).select(
        ingest.document_warnings(F.array(F.lit("b"), F.lit(None), F.lit("a"), F.lit("b")), F.lit(0), F.lit(2)).alias("x"),
        ingest.document_warnings(F.lit(None).cast("array<string>"), F.lit(0), F.lit(0)).alias("y"),
    ).first()
    assert row.x == ["b", "a", "2 page(s) with little or no text"] and row.y == []
