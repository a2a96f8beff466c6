"""Queries on the store of ingested documents: its headers, its warnings, and chunks beside their pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.plans.registry import query
from ledgerloom.plans.text_queries import CLEAN, MARGINS, doc_pages
from ledgerloom.sources import ingest
from ledgerloom.sources.shared import shared_folder

TRIMMED = "length(trim(t, ' ' || chr(10) || chr(9) || chr(13)))"
STORED = rf"""{MARGINS}, kept AS (SELECT keyed.d, p, string_agg(l, chr(10) ORDER BY pos) FILTER (n IS NULL OR (a > 3 AND b > 3)) text, list(l) FILTER (n IS NOT NULL AND (a <= 3 OR b <= 3)) gone FROM keyed LEFT JOIN repeated USING (d, k) GROUP BY 1, 2),
cleaned AS (SELECT page.d, page.p, page.t raw, coalesce({CLEAN.replace("text", "kept.text")}, '') t, gone FROM page LEFT JOIN kept ON page.d = kept.d AND page.p = kept.p),
stored AS (SELECT *, CASE WHEN {TRIMMED} = 0 THEN 'EMPTY' WHEN {TRIMMED} < 80 THEN 'LOW_TEXT' ELSE 'NATIVE_TEXT' END status FROM cleaned)"""
LONGEST = 100_000  # characters of a chunk: no page of the tables is longer, so that SQL counts chunks by pages (chunk_rows cuts them)


def store_of(spark, sf_dir) -> dict[str, DataFrame]:
    """Pages of four lines of all documents, those of every fifth document with two warnings of their own, one of them twice."""
    own = F.when(F.col("document_id") % 5 == 0, F.array(*map(F.lit, ["scanned", "rotated", "scanned"])))
    pages = doc_pages(spark, sf_dir).withColumn("document_warnings", own)
    return ingest.ingest(pages, shared_folder(spark, "store"), buckets=16, size=LONGEST, ratio=0.25, least=2)


@query(f"""WITH {STORED}, lines AS (SELECT d, list(DISTINCT l) ls FROM (SELECT d, unnest(gone) l FROM stored) GROUP BY 1)
SELECT s.d AS document_id, page_count, native_pages, low_pages, empty_pages, raw_chars, clean_chars, chunk_count, coalesce(len(ls), 0)::BIGINT AS margin_lines, concat_ws(';', CASE WHEN s.d % 5 = 0 THEN 'scanned;rotated' END, CASE WHEN low_pages + empty_pages > 0 THEN (low_pages + empty_pages) || ' page(s) with little or no text' END) AS warnings
FROM (SELECT d, count(*) page_count, count(*) FILTER (status = 'NATIVE_TEXT') native_pages, count(*) FILTER (status = 'LOW_TEXT') low_pages, count(*) FILTER (status = 'EMPTY') empty_pages, sum(length(raw))::BIGINT raw_chars, sum(length(t))::BIGINT clean_chars, count(*) FILTER (t <> '') chunk_count FROM stored GROUP BY 1) s LEFT JOIN lines ON s.d = lines.d""")
def stored_documents(spark, sf_dir):
    got = store_of(spark, sf_dir)["documents"].drop("recovered_pages")
    return got.withColumns({"margin_lines": F.size("margin_lines").cast("long"), "warnings": F.array_join("warnings", ";")})


@query(f"WITH {STORED} SELECT d AS document_id, p AS page_number, status, CASE status WHEN 'EMPTY' THEN 'no text on this page' WHEN 'LOW_TEXT' THEN 'very little text on this page' ELSE '' END AS warnings, sha256(t) AS sha256 FROM stored")
def stored_page_warnings(spark, sf_dir):
    return store_of(spark, sf_dir)["pages"].select("document_id", F.col("page_number").cast("long").alias("page_number"), "status", F.array_join("warnings", ";").alias("warnings"), "sha256")


@query(f"WITH {STORED} SELECT d AS document_id, p AS page_number, status, sha256(t) AS sha256, length(t)::BIGINT AS n FROM stored WHERE t <> '' AND p % 2 = 1")
def stored_chunks_by_page(spark, sf_dir):
    """Chunks of the odd pages, beside their page."""
    store = store_of(spark, sf_dir)
    wanted = store["pages"].where(F.col("page_number") % 2 == 1)
    got = ingest.chunks_by_page(store, wanted)
    return got.select("document_id", F.col("page_number").cast("long").alias("page_number"), "status", "sha256", F.length("text").cast("long").alias("n"))
