"""Queries that write records, runs, dictionaries, pages and manifests in their file formats and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import pages as P
from ledgerloom.operators import taxonomy
from ledgerloom.plans.registry import query, table
from ledgerloom.plans.text_queries import PAGES, doc_pages, documents, sql_fold
from ledgerloom.sources import records
from ledgerloom.sources.shared import shared_folder


def one_file_each(rows: DataFrame, name: str, value: str, path: str) -> None:
    """Rows (name, value) as files of one JSON value each, in folders by name."""
    rows.select(name, F.col(value).alias("value")).write.partitionBy(name).option("maxRecordsPerFile", 1).text(path)


@query("SELECT o_orderkey, 'author=' || o_orderpriority || CASE WHEN o_orderstatus = 'F' THEN ',title=' || o_custkey ELSE '' END AS kept FROM orders")
def metadata_kept(spark, sf_dir):
    given = F.map_from_arrays(F.array(F.lit("author"), F.when(F.col("o_orderstatus") == "F", "title").otherwise("tmp"), F.lit("pages")), F.array("o_orderpriority", F.col("o_custkey").cast("string"), F.lit("3")))
    kept = F.array_sort(F.transform(F.map_entries(records.kept_metadata(given)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(kept, ",").alias("kept"))


@query("""SELECT o_orderkey::VARCHAR AS document_id, coalesce(n, 0) AS facts, coalesce(valid, 0) AS valid_claims, coalesce(chunks, '') AS core_chunks, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE '' END AS warnings FROM orders LEFT JOIN
(SELECT l_orderkey k, count(*) n, count(*) FILTER (l_returnflag = 'R') valid, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) chunks FROM lineitem GROUP BY 1) ON k = o_orderkey""")
def runs_roundtrip(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("facts"), F.count_if(F.col("l_returnflag") == "R").alias("valid_claims"),
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")).alias("chunks"),
    )
    runs = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").cast("string").alias("document_id"), F.lit("1").alias("schema_version"), F.create_map(F.lit("core"), F.coalesce("chunks", F.array().cast("array<string>"))).alias("selected_chunks"),
        F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("valid_claims", F.lit(0)).alias("valid_claims"), F.coalesce("facts", F.lit(0)).alias("total_claims"),
        F.to_json(F.struct("o_custkey")).alias("policy_json"), F.when(F.col("o_orderstatus") == "F", F.array(F.lit("closed"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )
    path = shared_folder(spark, "runs")
    records.write_json(runs, path, records.RUN)
    back, _ = records.read_json(spark, path, records.RUN)
    return back.select("document_id", "facts", "valid_claims", F.array_join(F.col("selected_chunks")["core"], ",").alias("core_chunks"), F.array_join("warnings", ",").alias("warnings"))


@query("SELECT user_id::VARCHAR AS policy_id, count(*) AS scalar_total, count(*) FILTER (event_type = 'view') AS scalar_correct, count(*) FILTER (event_type = 'view') / count(*) AS macro_f1, 1 AS rejects FROM events GROUP BY 1")
def evaluation_roundtrip(spark, sf_dir):
    """One line that is no JSON lies among the evaluations and comes back as a reject."""
    good = F.count_if(F.col("event_type") == "view")
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("policy_id")).agg(good.alias("scalar_correct"), F.count(F.lit(1)).alias("scalar_total"), (good / F.count(F.lit(1))).alias("macro_f1"))
    rows = rows.select("*", F.lit(0).alias("financial_correct"), F.lit(0).alias("financial_total"), F.array(F.lit("n")).alias("notes"))
    path = shared_folder(spark, "evaluations")
    records.write_json(rows, path, records.EVALUATION)
    table(spark, sf_dir, "nation").where("n_nationkey = 0").select(F.concat(F.lit("{broken "), "n_name").alias("value")).write.mode("append").text(path)
    back, rejects = records.read_json(spark, path, records.EVALUATION)
    counted = rejects.agg(F.count(F.lit(1)).cast("int").alias("rejects"))
    return back.select("policy_id", "scalar_total", "scalar_correct", "macro_f1").crossJoin(F.broadcast(counted))  # one row


@query("SELECT CASE WHEN o_totalprice > 100000 THEN 'DONE' ELSE 'FAILED' END AS status, count(*) AS documents, count(DISTINCT o_custkey)::BIGINT AS jobs, sum(o_orderkey % 9)::BIGINT AS pages FROM orders GROUP BY 1")
def job_manifest(spark, sf_dir):
    """Orders as processed documents; those of even customers are appended a second time, as after a lost job."""
    status = F.when(F.col("o_totalprice") > 100000, "DONE").otherwise("FAILED")
    jobs = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("job_id"), F.col("o_orderkey").cast("string").alias("document_id"), F.lit("x.pdf").alias("source_file"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"), (F.col("o_orderkey") % 9).cast("int").alias("pages"), status.alias("status"))
    path = shared_folder(spark, "manifest")
    records.add_to_manifest(jobs, path)
    records.add_to_manifest(jobs.where(F.col("job_id").cast("long") % 2 == 0), path)
    return records.read_manifest(spark, path).groupBy("status").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("job_id").alias("jobs"), F.sum("pages").alias("pages"))


@query("SELECT p_type AS concept_id, lower(p_type) AS concept_label, count(*) AS members, min(p_partkey)::VARCHAR AS first_field, max(p_partkey)::VARCHAR AS last_field FROM part GROUP BY p_type")
def concepts_source(spark, sf_dir):
    members = F.array_sort(F.collect_list(F.struct(F.lit("parts").alias("section"), F.col("p_partkey").cast("string").alias("field_id"))))
    concepts = table(spark, sf_dir, "part").groupBy("p_type").agg(members.alias("members"))
    body = F.to_json(F.struct(F.array(F.struct(F.col("p_type").alias("id"), F.lower("p_type").alias("label"), "members")).alias("concepts")))
    path = shared_folder(spark, "concepts")
    one_file_each(concepts.select(F.col("p_type").alias("kind"), body.alias("body")), "kind", "body", path)
    got = records.read_concepts(spark, path)
    number = F.col("field_id").cast("long")
    return got.groupBy("concept_id", "concept_label").agg(F.count(F.lit(1)).alias("members"), F.min(number).cast("string").alias("first_field"), F.max(number).cast("string").alias("last_field"))


@query(f"WITH {PAGES} SELECT d AS document_id, count(*) AS pages, sum(length(t))::BIGINT AS chars, max(p)::INT AS last_page FROM page GROUP BY 1")
def pages_roundtrip(spark, sf_dir):
    path = shared_folder(spark, "pages")
    records.write_pages(doc_pages(spark, sf_dir), path, buckets=8)
    back = spark.read.parquet(path)
    return back.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("raw_text")).alias("chars"), F.max("page_number").alias("last_page"))


@query("SELECT o_orderpriority AS source_id, o_orderstatus AS kind, count(*) AS facts, sum(len(list_distinct([o_orderkey % 5, o_custkey % 5])))::BIGINT AS pages FROM orders GROUP BY 1, 2")
def gold_source(spark, sf_dir):
    pages = F.array_distinct(F.array((F.col("o_orderkey") % 5).cast("int"), (F.col("o_custkey") % 5).cast("int")))
    fact = F.struct(F.col("o_orderkey").cast("string").alias("fact_id"), F.col("o_orderstatus").alias("kind"), pages.alias("evidence_pages"))
    gold = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.collect_list(fact).alias("facts"))
    path = shared_folder(spark, "gold")
    one_file_each(gold.select(F.col("o_orderpriority").alias("name"), F.to_json(F.struct(F.col("o_orderpriority").alias("source_id"), "facts")).alias("body")), "name", "body", path)
    return records.read_gold(spark, path).groupBy("source_id", "kind").agg(F.count(F.lit(1)).alias("facts"), F.sum(F.size("evidence_pages")).alias("pages"))


@query("""SELECT 'nations' AS portfolio_id, n_name AS entity_id, row_number() OVER (ORDER BY n_name) AS position, (SELECT count(*) FROM nation WHERE n_regionkey = 4) AS rejects FROM nation WHERE n_regionkey <> 4""")
def records_source(spark, sf_dir):
    """Nations as record files: bare, in each known wrapper, and those of region 4 under a name that no one knows."""
    one = F.struct(F.col("n_name").alias("policy_id"), F.array(F.struct(F.col("n_name").alias("document_id"))).alias("source_documents"), F.struct(F.struct(F.lit("FOUND").alias("status")).alias("insurer")).alias("identification"), F.struct(F.struct(F.lit("NOT_FOUND").alias("status")).alias("currency")).alias("contractual_terms"), F.struct(F.lit("1").alias("schema_version")).alias("extraction"))
    wrap = lambda name: F.to_json(F.struct(one.alias(name)))
    region = F.col("n_regionkey")
    body = F.when(region == 0, F.to_json(one)).when(region == 1, wrap("policy_json")).when(region == 2, wrap("policy")).when(region == 3, wrap("policy_record")).otherwise(wrap("unknown"))
    path = shared_folder(spark, "records")
    one_file_each(table(spark, sf_dir, "nation").select("n_name", body.alias("body")), "n_name", "body", path)
    found, rejects = records.read_records(spark, path)
    counted = rejects.agg(F.count(F.lit(1)).alias("rejects"))
    members = records.portfolio(found, "nations").select("portfolio_id", "entity_id", F.col("position").cast("long").alias("position"))
    return members.crossJoin(F.broadcast(counted))  # one row


@query("SELECT p_type AS category, split_part(p_name, ' ', 2) AS id, count(DISTINCT p_name) AS aliases FROM part GROUP BY 1, 2")
def dictionary_source(spark, sf_dir):
    thing = F.split_part("p_name", F.lit(" "), F.lit(2))
    items = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("category"), thing.alias("id")).agg(F.sort_array(F.collect_set("p_name")).alias("aliases"))
    path = shared_folder(spark, "dictionary")
    records.write_dictionary(items.withColumns({"item_order": F.lit(0), "label": F.initcap("id"), "description": F.lit(None).cast("string")}), path)
    _, aliases = records.read_dictionary(spark, path)
    return aliases.groupBy("category", "id").agg(F.count(F.lit(1)).alias("aliases"))


@query(r"SELECT doc_id, trim(regexp_replace(strip_accents(replace(lower(text), 'ß', 'ss')), '\s+', ' ', 'g')) AS folded FROM documents")
def fold_squeezed(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.fold_squeeze(F.col("text")).alias("folded"))


@query("SELECT doc_id, strip_accents(replace(lower(text), 'ß', 'ss')) AS folded FROM documents")
def fold_marks(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.fold_marks(F.col("text")).alias("folded"))


@query(f"""WITH l AS (SELECT doc_id, [l for l in string_split(text, chr(10))] ls FROM documents), k AS (SELECT doc_id, list_distinct(list_transform(ls, lambda x: {sql_fold('x')})) ks FROM l)
SELECT doc_id, coalesce(list_aggregate(list_sort(list_filter(ks, lambda t: length(t) >= greatest(6, floor(list_max(list_transform(ks, lambda u: length(u))) * 0.4)))), 'string_agg', '|'), '') AS terms FROM k""")
def recovery_terms(spark, sf_dir):
    lines = F.split("text", "\n")
    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0)))
    got = taxonomy.recovery_terms(F.element_at(lines, 1), rest, F.element_at(lines, -1))
    return documents(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(got), "|").alias("terms"))


@query("SELECT 'order ' || o_orderkey AS document_id FROM orders WHERE o_orderstatus = 'P'")
def unusable_documents(spark, sf_dir):
    """Orders as pages: those in process hold blanks only."""
    orders = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderstatus") == "P", " \n\t ").when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")).otherwise(F.concat(F.lit("\n"), "o_orderstatus"))
    pages = orders.select(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("document_id"), F.explode(F.array(text, F.lit(None).cast("string"))).alias("raw_text"))
    return P.unusable(pages)
