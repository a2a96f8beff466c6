"""Record assembly, sources, sinks and incremental queries over orders, lines, events, conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import text as X
from ledgerloom.operators import assemble, assembly, serve
from ledgerloom.plans.registry import query, table
from ledgerloom.sources import records
from ledgerloom.sources.shared import shared_folder
from ledgerloom.streaming import incremental


@query("SELECT o_custkey AS policy_id, count(DISTINCT o_orderkey) AS n_orders, count(l_orderkey) AS n_lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def overview_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("policy_id"), "o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    per = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
    return serve.sizes(per, "policy_id", {"n_orders": F.count_distinct("o_orderkey"), "n_lines": F.count("l_linenumber")})


@query("""WITH l AS (SELECT l_orderkey k, string_agg(l_partkey || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) items, count(*) n FROM lineitem GROUP BY 1)
SELECT o_orderkey AS policy_id, o_orderstatus AS status, CASE WHEN o_totalprice > 100000 THEN 'FOUND' ELSE 'NOT_FOUND' END AS price_status, coalesce(n, 0) AS n_items, coalesce(items, '') AS items FROM orders LEFT JOIN l ON k = o_orderkey""")
def assemble_record(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    price = assemble.field(F.when(F.col("o_totalprice") > 100000, "FOUND").otherwise("AMBIGUOUS"), F.col("o_totalprice"), F.lit(None), F.lit(None).cast("double"))
    head = orders.select(F.col("o_orderkey").alias("policy_id"), F.col("o_orderstatus").alias("status"), price.alias("price"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("policy_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    record = head.join(assemble.nested(lines, "policy_id", "l_linenumber", "items"), "policy_id", "left")
    shown = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["l_partkey"].cast("string"), x["l_returnflag"])), ",")
    return record.select("policy_id", "status", F.col("price.status").alias("price_status"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce(shown, F.lit("")).alias("items"))


@query("SELECT user_id, event_type AS field_id, arg_max(value, (ts, event_id)) AS last_value, arg_min(value, (ts, event_id)) AS first_value FROM events GROUP BY 1, 2")
def scalar_map(spark, sf_dir):
    facts = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("field_id"), F.struct("ts", "event_id").alias("pos"), "value")
    last = assemble.last_by(facts, ["user_id", "field_id"], "pos").select("user_id", "field_id", F.col("value").alias("last_value"))
    first = assemble.first_by(facts, ["user_id", "field_id"], "pos").select("user_id", "field_id", F.col("value").alias("first_value"))
    return last.join(first, ["user_id", "field_id"])


@query("SELECT o_custkey AS policy_id, CASE WHEN min(o_orderdate) < max(o_orderdate) THEN 'FOUND' ELSE 'NOT_FOUND' END AS status, CASE WHEN min(o_orderdate) < max(o_orderdate) THEN strftime(min(o_orderdate), '%d/%m/%Y') || ' - ' || strftime(max(o_orderdate), '%d/%m/%Y') ELSE '-' END AS shown FROM orders GROUP BY 1")
def policy_period(spark, sf_dir):
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("policy_id")).agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    got = days.withColumn("period", assemble.period(F.col("a"), F.when(F.col("b") > F.col("a"), F.col("b"))))
    shown = serve.value_text(F.lit("PERIOD"), F.col("period.start"), F.col("period.end"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("double"))
    return got.select("policy_id", "period.status", shown.alias("shown"))


@query("SELECT doc_id, CASE WHEN contains(text, chr(10)) AND length(text) < 1000 THEN 'HYBRID' WHEN length(text) < 1000 THEN 'SECOND_READING' ELSE 'NATIVE' END AS method FROM documents")
def method_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    native = F.when(F.contains("text", F.lit("\n")), 1).otherwise(0)
    second = F.when(F.length("text") < 1000, 1).otherwise(0)
    return docs.select("doc_id", assemble.method(native, second).alias("method"))


@query("""WITH f AS (SELECT event_id, event_type s, CASE WHEN event_type IN ('click', 'error') THEN NULL ELSE value END v, value / 100 c FROM events), r AS (SELECT event_id, CASE s WHEN 'view' THEN 'FOUND' WHEN 'click' THEN 'FOUND' WHEN 'purchase' THEN 'NOT_FOUND' ELSE 'AMBIGUOUS' END s, v, c FROM f)
SELECT rule, count(*) AS n FROM (SELECT 'found_without_value' rule FROM r WHERE s = 'FOUND' AND v IS NULL UNION ALL SELECT 'value_without_found' FROM r WHERE s = 'NOT_FOUND' AND v IS NOT NULL UNION ALL SELECT 'review_without_candidates' FROM r WHERE s = 'AMBIGUOUS' UNION ALL SELECT 'confidence_range' FROM r WHERE c < 0 OR c > 1) GROUP BY 1""")
def state_rules(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind.isin("view", "click"), "FOUND").when(kind == "purchase", "NOT_FOUND").otherwise("AMBIGUOUS")
    facts = table(spark, sf_dir, "events").select("event_id", status.alias("status"), F.when(~kind.isin("click", "error"), F.col("value")).alias("value"), (F.col("value") / 100).alias("confidence"))
    rules = assemble.state_rules(F.col("status"), F.col("value"), F.lit(0), F.col("confidence"))
    return assemble.violations(facts, "event_id", rules).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey AS policy_id, string_agg(w, ';' ORDER BY w) AS warnings FROM (SELECT o_orderkey, 'open' w FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'unmapped priority' FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED' UNION ALL SELECT l_orderkey, 'returned:' || count(*) FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) GROUP BY 1""")
def run_warnings(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    parts = [
        orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("policy_id"), F.lit("open").alias("w")),
        orders.where("o_orderpriority = '4-NOT SPECIFIED'").select(F.col("o_orderkey").alias("policy_id"), F.lit("unmapped priority").alias("w")),
        table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("policy_id")).agg(F.concat(F.lit("returned:"), F.count(F.lit(1)).cast("string")).alias("w")),
    ]
    return assemble.merged(parts).groupBy("policy_id").agg(F.array_join(F.array_sort(F.collect_list("w")), ";").alias("warnings"))


@query("""SELECT o_orderkey AS policy_id, 'ingested:true,priced:' || (o_totalprice > 100000)::VARCHAR || ',shipped:' || (coalesce(n, 0) > 0)::VARCHAR AS stages, coalesce(pages, '') AS pages FROM orders LEFT JOIN (SELECT l_orderkey k, count(*) n, array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') pages FROM lineitem GROUP BY 1) ON k = o_orderkey""")
def stage_flags(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("policy_id")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("page"))).alias("evidence"))
    got = table(spark, sf_dir, "orders").withColumn("policy_id", F.col("o_orderkey")).join(lines, "policy_id", "left")
    flags = serve.stages({"ingested": F.lit(True), "priced": F.col("o_totalprice") > 100000, "shipped": F.coalesce(F.size("evidence"), F.lit(0)) > 0})
    text = F.array_join(F.transform(flags, lambda s: F.concat_ws(":", s["stage"], s["done"].cast("string"))), ",")
    return got.select("policy_id", text.alias("stages"), F.coalesce(serve.pages(F.col("evidence")), F.lit("")).alias("pages"))


@query("SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS total, count(*) FILTER (props->>'$.k' IS NULL) AS missing, count(*) AS n FROM events GROUP BY 1")
def json_roundtrip(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select("event_type", F.concat(F.lit("Here it is: ```json\n"), "props", F.lit("\n```")).alias("response"))
    parsed = records.parsed_responses(raw, "response", "k long")
    return parsed.groupBy("event_type").agg(F.sum("parsed.k").alias("total"), F.count_if(F.col("reason").isNotNull()).alias("missing"), F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT source, count(*) docs, bool_or(contains(lower(text), 'licensed under')) a, bool_or(contains(lower(text), 'zzz')) b FROM documents GROUP BY 1)
SELECT 'src' || i AS source, coalesce(docs, 0) AS docs, CASE WHEN docs IS NULL THEN 'licensed under,zzz' ELSE concat_ws(',', CASE WHEN a THEN NULL ELSE 'licensed under' END, CASE WHEN b THEN NULL ELSE 'zzz' END) END AS missing, false AS ok FROM range(0, 22) t(i) LEFT JOIN c ON source = 'src' || i""")
def source_checks(spark, sf_dir):
    manifest = spark.range(22).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source"), F.lit(50).alias("expected_docs"))
    markers = manifest.select("source", F.explode(F.array(F.lit("licensed under"), F.lit("zzz"))).alias("marker"))
    return records.source_checks(manifest, table(spark, sf_dir, "documents"), markers).select("source", "docs", "missing", "ok")


@query("""WITH f AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'Scan One.PDF' WHEN 'click' THEN 'scan one.pdf' WHEN 'error' THEN 'x.exe' ELSE 'p.png' END n, event_id % 7 s FROM events) SELECT n AS name, count(*) FILTER (s > 0 AND n <> 'x.exe') AS accepted, count(*) FILTER (s = 0) AS empty, count(*) FILTER (s > 0 AND n = 'x.exe') AS unsupported FROM f GROUP BY 1""")
def file_acceptance(spark, sf_dir):
    kind = F.col("event_type")
    name = F.when(kind == "view", "Scan One.PDF").when(kind == "click", "scan one.pdf").when(kind == "error", "x.exe").otherwise("p.png")
    files = table(spark, sf_dir, "events").select("event_id", name.alias("name"), (F.col("event_id") % 7).alias("bytes"))
    got = records.accepted_files(files, F.col("name"), F.col("bytes"))
    return got.groupBy("name").agg(F.count_if(F.col("reject").isNull()).alias("accepted"), F.count_if(F.col("reject") == "EMPTY").alias("empty"), F.count_if(F.col("reject") == "UNSUPPORTED").alias("unsupported"))


@query("""SELECT source, substr(sha256(string_agg(head || ':' || digest, chr(0) ORDER BY head)), 1, 16) AS job_id FROM (SELECT source, substr(h, 1, 3) head, sha256(string_agg(h, chr(0) ORDER BY h)) digest FROM (SELECT source, sha256(text) h FROM documents) GROUP BY ALL) GROUP BY 1""")
def job_ids(spark, sf_dir):
    return incremental.job_ids(table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("sha256")), "source", "sha256")


@query("SELECT o_orderkey AS document_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def pending_work(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"))
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("document_id"))
    return incremental.pending(wanted, done, ["document_id"])


@query("SELECT conv_id AS document_id FROM conversations GROUP BY 1 HAVING max(text) FILTER (turn = 1) IS DISTINCT FROM max(text) FILTER (turn = 0)")
def changed_files(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    at = lambda turn: talk.where(F.col("turn") == turn).groupBy(F.col("conv_id").alias("document_id")).agg(F.sha2(F.max("text"), 256).alias("sha256"))
    every = talk.select(F.col("conv_id").alias("document_id")).distinct().join(at(1), "document_id", "left")
    return incremental.changed(at(0), every, "document_id", "sha256").select("document_id")


@query("SELECT o_custkey AS policy_id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return incremental.duplicate_ids(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("policy_id")), "policy_id")


@query("SELECT o_orderpriority AS portfolio_id, count(*) AS rows, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1")
def sources_sinks_roundtrip(spark, sf_dir):
    """Written as JSON by portfolio and as text, and read again."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("portfolio_id"), "o_orderkey")
    path = shared_folder(spark, "roundtrip")
    report = rows.groupBy("portfolio_id").agg(F.count(F.lit(1)).cast("string").alias("report"))
    records.write_comparison(rows, report, path)
    back = spark.read.schema("o_orderkey long, portfolio_id string").json(f"{path}/rows")
    text = spark.read.schema("value string, portfolio_id string").text(f"{path}/report")
    got = back.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys"))
    return got.join(text, "portfolio_id").where(F.col("value") == F.col("rows").cast("string")).drop("value")


@query("SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def incremental_files(spark, sf_dir):
    """Events arrive in two deliveries; the stream job takes each file once."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    base = shared_folder(spark, "stream")
    job = lambda df: df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
    half = F.col("event_id") % 2
    for part in (0, 1, None):
        if part is not None:
            events.where(half == part).write.mode("append").parquet(f"{base}/in")
        incremental.run_available(spark, f"{base}/in", events.schema, job, f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))


@query("""WITH d AS (SELECT *, o_orderkey % 3 part, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3, o_orderkey) r FROM orders)
SELECT o_custkey AS policy_id, min(o_orderkey) FILTER (r = 1) AS taken, count(*) FILTER (r > 1) AS refused, coalesce(sum(o_orderkey) FILTER (r > 1), 0)::BIGINT AS refused_keys FROM d GROUP BY 1""")
def guarded_deliveries(spark, sf_dir):
    """Orders as records of their customers, in three deliveries, each a run of its own: the first record of a customer is taken, those that come later, in
    the same delivery or another, are refused."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    base = shared_folder(spark, "guarded")
    for part in range(3):
        orders.where(F.col("o_orderkey") % 3 == part).write.mode("append").parquet(f"{base}/in")
        incremental.run_guarded(spark, f"{base}/in", orders.schema, "o_custkey", "o_orderkey", f"{base}/out", f"{base}/checkpoint")
    taken = spark.read.schema(orders.schema).parquet(f"{base}/out/taken").groupBy(F.col("o_custkey").alias("policy_id")).agg(F.min("o_orderkey").alias("taken"))
    refused = spark.read.schema(orders.schema).parquet(f"{base}/out/refused").groupBy(F.col("o_custkey").alias("policy_id")).agg(F.count(F.lit(1)).alias("refused"), F.sum("o_orderkey").alias("refused_keys"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return taken.join(refused, "policy_id", "left").select("policy_id", "taken", none("refused"), none("refused_keys"))


@query("""WITH l AS (SELECT l_orderkey d, l_linenumber pos, min((l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus)) m FROM lineitem GROUP BY ALL),
i AS (SELECT d, pos, CASE m[4] WHEN 'A' THEN 'coverages' WHEN 'N' THEN 'extensions' ELSE 'exclusions' END s, CASE WHEN m[1] % 2 = 0 THEN 'p' || m[1] % 7 END id, 'part ' || m[1] nm, m[3]::DECIMAL(18,2) q, m[5] ls FROM l),
t AS (SELECT d, s, string_agg(coalesce(id, '?') || ':' || nm || ':' || CASE WHEN id IS NULL THEN '0.0' ELSE '0.95' END || ':' || CASE WHEN s = 'coverages' THEN 'MAIN_COVERAGE' ELSE '' END || '[' || CASE WHEN q > 25 THEN 'limit=' || q || CASE WHEN ls = 'O' THEN '+extra=' || q ELSE '' END ELSE '' END || ']', ';' ORDER BY pos) x FROM i GROUP BY ALL),
o AS (SELECT *, o_orderdate::DATE od FROM orders)
SELECT o_orderkey AS document_id, CASE WHEN o_custkey % 5 = 0 THEN 'hint ' || o_orderkey WHEN o_orderstatus = 'F' THEN o_orderkey::VARCHAR ELSE 'n' || o_custkey END AS policy_id, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS insurer, strftime(od, '%Y-%m') AS version,
CASE WHEN o_orderstatus = 'O' THEN strftime(od, '%Y-%m-%d') || '/' || strftime(od + 365, '%Y-%m-%d') ELSE 'NOT_FOUND' END AS period, o_totalprice::DECIMAL(18,2)::VARCHAR AS premium, CASE WHEN o_orderstatus = 'P' THEN 'NOT_FOUND' ELSE 'FOUND' END AS retroactive, (1 + o_custkey % 3) || ' years' AS reporting, CASE WHEN o_orderstatus = 'O' THEN 'CLAIMS_MADE' END AS trigger_code,
'aggregate_limit=' || (o_totalprice::DECIMAL(18,2) * 2)::DECIMAL(18,2) AS limits, 'deductible=' || o_totalprice::DECIMAL(18,2) AS deductibles, coalesce(c.x, '') AS coverages, coalesce(e.x, '') AS extensions, coalesce(u.x, '') AS exclusions, 'term ' || o_orderstatus || '=' || o_orderpriority AS definitions
FROM o LEFT JOIN t c ON c.d = o_orderkey AND c.s = 'coverages' LEFT JOIN t e ON e.d = o_orderkey AND e.s = 'extensions' LEFT JOIN t u ON u.d = o_orderkey AND u.s = 'exclusions'""")
def whole_records(spark, sf_dir):
    """Orders as documents, from raw facts to records by one call: their own columns are facts, definitions and money, their lines items with limits."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), "o_custkey", "o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    day, show = F.col("day"), lambda c: F.date_format(c, "yyyy-MM-dd")
    fact = lambda name, value, status=F.lit("FOUND"), pos=1: F.struct(F.lit(name).alias("field_id"), F.lit(pos).cast("long").alias("pos"), status.alias("status"), value.cast("string").alias("raw"))
    month = F.concat(F.element_at(F.array(*map(F.lit, X.MONTHS)), F.month(day)), F.lit("/"), F.year(day).cast("string"))
    said = F.array(
        fact("insurer", F.lit("old")),
        fact("insurer", F.col("o_orderpriority"), F.when(F.col("o_custkey") % 3 == 0, "AMBIGUOUS").otherwise("FOUND"), 2),
        fact("policy_number", F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("n"), F.col("o_custkey").cast("string")))),
        fact("document_version", month),
        fact("policy_start", show(day)),
        fact("policy_end", F.when(F.col("o_orderstatus") == "O", show(F.date_add(day, 365))).otherwise("open")),
        fact("retroactive_date", F.when(F.col("o_orderstatus") == "P", "none").otherwise(show(day))),
        fact("extended_reporting_period", F.concat((1 + F.col("o_custkey") % 3).cast("string"), F.lit(" anos"))),
        fact("coverage_trigger", F.when(F.col("o_orderstatus") == "O", "Claims Made")),
    )
    money = lambda name, pos, amount: F.struct(F.lit(name).alias("field_id"), F.lit(pos).cast("long").alias("pos"), amount.cast("decimal(38,6)").alias("amount"), F.lit("BRL").alias("currency"))
    sums = F.array(money("premium", 1, F.col("price")), money("premium", 2, F.col("price") + 1), money("aggregate_limit", 3, F.col("price") * 2), money("deductible", 4, F.col("price")), money("other", 5, F.col("price")))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("long").alias("pos")).agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")).alias("m")).select("document_id", "pos", "m.*")
    known = F.col("l_partkey") % 2 == 0
    items = lines.select("document_id", "pos", F.when(F.col("l_returnflag") == "A", "coverages").when(F.col("l_returnflag") == "N", "extensions").otherwise("exclusions").alias("field_id"), F.when(known, F.concat(F.lit("p"), (F.col("l_partkey") % 7).cast("string"))).alias("canonical_id"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("raw"), F.lit(0.95).alias("given_confidence"))
    held = F.when(F.col("l_linestatus") == "O", F.array(F.lit("limit"), F.lit("extra"))).otherwise(F.array(F.lit("limit")))
    inner = lines.where("l_quantity > 25").select("document_id", "pos", F.posexplode(held).alias("inner_pos", "field_id"), F.col("l_quantity").alias("amount"))
    facts = assembly.put_together(
        assembly.tagged("fact", orders.select("document_id", F.explode(said).alias("f")).select("document_id", "f.*")),
        assembly.tagged("money", orders.select("document_id", F.explode(sums).alias("f")).select("document_id", "f.*")),
        assembly.tagged("item", items),
        assembly.tagged("money", inner),
        assembly.tagged("definition", orders.select("document_id", F.lit(1).alias("pos"), F.concat(F.lit("term "), "o_orderstatus").alias("raw"), F.col("o_orderpriority").alias("text"))),
        assembly.tagged("document", orders.select("document_id", F.when(F.col("o_custkey") % 5 == 0, F.concat(F.lit("hint "), F.col("document_id").cast("string"))).alias("raw"), F.lit("NATIVE").alias("status"))),
    )
    got = assembly.assembled(facts).join(orders.select("document_id"), "document_id")
    plain = lambda x: x.cast("decimal(18,2)").cast("string")
    limits = lambda c: F.array_join(F.transform(c, lambda m: F.concat_ws("=", m["canonical_id"], plain(m["amount"]))), "+")
    item = lambda x: F.concat(F.coalesce(x["canonical_id"], F.lit("?")), F.lit(":"), x["original_name"], F.lit(":"), x["normalization_confidence"].cast("string"), F.lit(":"), F.coalesce(x["category"], F.lit("")), F.lit("["), limits(x["limits"]), F.lit("]"))
    terms = F.col("contractual_terms")
    return got.select(
        "document_id", "policy_id", F.col("identification.insurer.value").alias("insurer"), F.col("identification.document_version.value").alias("version"),
        F.when(terms["policy_period"]["status"] == "FOUND", F.concat_ws("/", show(terms["policy_period"]["start"]), show(terms["policy_period"]["end"]))).otherwise("NOT_FOUND").alias("period"),
        plain(terms["premium"]["value"]).alias("premium"), terms["retroactive_date"]["status"].alias("retroactive"), F.concat_ws(" ", terms["extended_reporting_period"]["value"]["number"].cast("int").cast("string"), terms["extended_reporting_period"]["value"]["unit"]).alias("reporting"), terms["coverage_trigger_canonical"].alias("trigger_code"),
        limits(F.col("policy_limits")).alias("limits"), limits(F.col("policy_deductibles")).alias("deductibles"), *(F.array_join(F.transform(s, item), ";").alias(s) for s in ("coverages", "extensions", "exclusions")),
        F.array_join(F.transform("definitions", lambda x: F.concat_ws("=", x["original_term"], x["definition_text"])), ";").alias("definitions"),
    )
