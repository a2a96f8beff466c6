"""Text, page, dictionary and scoring queries over documents, pages of lines and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from ledgerloom.functions import text as X
from ledgerloom.operators import pages as P
from ledgerloom.operators import scoring, taxonomy
from ledgerloom.plans.registry import query, table

LINES_A_PAGE = 4


def sql_fold(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(replace(lower({x}), 'ß', 'ss')), '[^a-z0-9]+', ' ', 'g'))"


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def doc_pages(spark, sf_dir) -> DataFrame:
    """Documents cut into pages of four lines."""
    return P.pages_of(documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), "text"), LINES_A_PAGE)


def doc_chunks(spark, sf_dir) -> DataFrame:
    """A document's text as its only chunk."""
    docs = documents(spark, sf_dir)
    return docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), F.lit(0).alias("chunk_index"), "text")


PAGES = f"""line AS (SELECT doc_id d, unnest(string_split(text, chr(10))) l, generate_subscripts(string_split(text, chr(10)), 1) - 1 pos FROM documents),
page AS (SELECT d, pos // {LINES_A_PAGE} + 1 p, string_agg(l, chr(10) ORDER BY pos) t FROM line GROUP BY ALL)"""


@query(f"SELECT doc_id, {sql_fold('text')} AS folded FROM documents")
def fold_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.fold(F.col("text")).alias("folded"))


@query(f"SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split({sql_fold('text')}, ' ')) w FROM documents) GROUP BY 1")
def fold_words(spark, sf_dir):
    return documents(spark, sf_dir).select(F.explode(F.split(X.fold(F.col("text")), " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\x{00a0}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '')) AS clean_hash FROM documents""")
def clean_page_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2(X.clean_text(F.col("text")), 256).alias("clean_hash"))


@query("SELECT doc_id, sha256(text) AS hash, CASE WHEN s = '' THEN 'document' ELSE s END || '-' || substr(sha256(text), 1, 10) AS document_id FROM (SELECT *, regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') s FROM documents)")
def text_hash(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("hash"), X.document_id(F.concat("source", F.lit(".txt")), F.col("text")).alias("document_id"))


@query("SELECT o_orderkey, rtrim(rtrim((o_totalprice::DECIMAL(38,6))::VARCHAR, '0'), '.') AS price_key FROM orders")
def decimal_key(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.decimal_key(F.col("o_totalprice")).alias("price_key"))


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'small') AND contains(p_name, 'ring') THEN 'SMALL_RING' WHEN contains(p_name, 'small') THEN 'SMALL' WHEN contains(p_name, 'widget') THEN 'WIDGET' ELSE upper(replace(p_name, ' ', '_')) END AS code FROM part")
def rule_canonical(spark, sf_dir):
    rules = [(["small", "ring"], "SMALL_RING"), (["small"], "SMALL"), (["widget"], "WIDGET")]
    return table(spark, sf_dir, "part").select("p_partkey", X.canonical(F.col("p_name"), rules).alias("code"))


@query("""SELECT o_orderkey, strftime(d, '%d/%m/%Y') AS shown, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE strftime(d, '%Y-%m-%d') END AS parsed, strftime(d, '%Y-%m') AS version FROM (SELECT *, o_orderdate::DATE d FROM orders)""")
def date_parse(spark, sf_dir):
    months = F.array(*map(F.lit, X.MONTHS))
    day = F.to_date("o_orderdate")
    text = F.when(F.col("o_orderstatus") == "F", "no date").otherwise(F.date_format(day, "yyyy-MM-dd"))
    named = F.concat(F.element_at(months, F.month(day)), F.lit("/"), F.year(day).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(day, "dd/MM/yyyy").alias("shown"), X.date_or_null(text).cast("string").alias("parsed"), X.version(named).alias("version"))


@query("SELECT p_partkey, p_size + 0.5::DOUBLE AS number, CASE p_size % 3 WHEN 0 THEN 'months' WHEN 1 THEN 'years' ELSE 'days' END AS unit FROM part")
def duration_parse(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, ["meses", "Anos", "dias"])), F.col("p_size") % 3 + 1)
    got = X.duration(F.concat(F.lit("por "), F.col("p_size").cast("string"), F.lit(",5 "), unit))
    return table(spark, sf_dir, "part").select("p_partkey", got["number"].cast("double").alias("number"), got["unit"].alias("unit"))


@query(f"SELECT doc_id, len(list_filter(string_split({sql_fold('text')}, ' '), lambda x: x = 'the'))::BIGINT AS the_n, ((length(text) - length(replace(text, 'en', ''))) // 2)::BIGINT AS en_n FROM documents")
def term_count(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.term_count(X.fold(F.col("text")), F.lit("the")).alias("the_n"), X.substring_count(F.col("text"), F.lit("en")).alias("en_n"))


@query(f"SELECT token, count(*) AS docs FROM (SELECT DISTINCT doc_id, unnest(string_split({sql_fold('text')}, ' ')) token FROM documents) WHERE length(token) >= 2 AND token NOT IN ('the', 'de', 'la', 'der') GROUP BY 1 ORDER BY docs DESC, token LIMIT 100")
def tokens_topk(spark, sf_dir):
    words = documents(spark, sf_dir).select(F.explode(X.tokens(F.col("text"), ["the", "de", "la", "der"])).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("docs")).orderBy(F.desc("docs"), "token").limit(100)


@query(f"""WITH line AS (SELECT doc_id, {sql_fold('unnest(string_split(text, chr(10)))')} k FROM documents)
SELECT doc_id, max(CASE WHEN regexp_matches(k, '^([0-9]+ )+the$') THEN 320 WHEN regexp_matches(k, '^([0-9]+ )+the ') THEN 270 WHEN k = 'the' THEN 220 WHEN starts_with(k, 'the ') THEN 160 ELSE 0 END) AS best FROM line GROUP BY 1""")
def heading_score(spark, sf_dir):
    lines = documents(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.max(X.heading_score(F.col("line"), F.lit("the"))).alias("best"))


@query("""SELECT p_partkey, CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN p_type ELSE 'OTHER' END AS kind, CASE WHEN length(p_name) > 8 THEN substr(p_name, 1, 7) || '…' ELSE p_name END AS short, regexp_replace(p_name, '^([^ ]+)', '\\1 (part)') AS marked, 'see ' || p_name || '.' AS stripped FROM part""")
def text_rules(spark, sf_dir):
    name, first = F.col("p_name"), F.split_part("p_name", F.lit(" "), F.lit(1))
    note = F.concat(F.lit("see "), name, F.lit(" (regra "), F.col("p_size").cast("string"), F.lit(")."))
    return table(spark, sf_dir, "part").select("p_partkey", X.in_domain(F.col("p_type"), ["PROMO", "ECONOMY"], "OTHER").alias("kind"), X.shortened(name, 8).alias("short"), X.first_mention_marked(name, first, " (part)").alias("marked"), X.without_rule_references(note).alias("stripped"))


@query(f"WITH {PAGES} SELECT d AS document_id, p AS page_number, CASE WHEN length(trim(t, ' ' || chr(10) || chr(9) || chr(13))) = 0 THEN 'EMPTY' WHEN length(trim(t, ' ' || chr(10) || chr(9) || chr(13))) < 80 THEN 'LOW_TEXT' ELSE 'NATIVE_TEXT' END AS status FROM page")
def page_status(spark, sf_dir):
    return doc_pages(spark, sf_dir).select("document_id", "page_number", P.page_status(F.col("raw_text")).alias("status"))


@query(f"WITH {PAGES} SELECT d AS document_id, count(*) AS page_count, count(*) FILTER (n >= 80) AS native_pages, count(*) FILTER (n BETWEEN 1 AND 79) AS low_pages, count(*) FILTER (n = 0) AS empty_pages, sum(length(t))::BIGINT AS raw_chars FROM (SELECT *, length(trim(t, ' ' || chr(10) || chr(9) || chr(13))) n FROM page) GROUP BY 1")
def ingest_stats(spark, sf_dir):
    return P.stats(doc_pages(spark, sf_dir))


MARGINS = f"""{PAGES}, ranked AS (SELECT d, pos // {LINES_A_PAGE} + 1 p, trim(l) l, pos, row_number() OVER (PARTITION BY d, pos // {LINES_A_PAGE} ORDER BY pos) a, row_number() OVER (PARTITION BY d, pos // {LINES_A_PAGE} ORDER BY pos DESC) b FROM line WHERE trim(l) <> ''),
keyed AS (SELECT *, CASE WHEN regexp_matches(l, '(?i)^(?:p[aá]g(?:ina)?\\.?\\s*)?[0-9]+(?:\\s*/\\s*[0-9]+)?$') THEN '<PAGE_NUMBER>' ELSE lower(l) END k FROM ranked),
margin AS (SELECT d, k, count(DISTINCT p) n FROM keyed WHERE (a <= 3 OR b <= 3) AND length(l) <= 140 GROUP BY ALL),
filled AS (SELECT d, count(*) f FROM page WHERE length(trim(t, ' ' || chr(10) || chr(9) || chr(13))) > 0 GROUP BY 1),
repeated AS (SELECT d, k, n FROM margin JOIN filled USING (d) WHERE n >= greatest(2, floor(f * 0.25 + 0.999999)))"""


@query(f"WITH {MARGINS} SELECT d AS document_id, k AS key, n AS pages FROM repeated")
def repeated_margins(spark, sf_dir):
    pages = doc_pages(spark, sf_dir)
    return P.repeated_margins(P.page_lines(pages), pages, ratio=0.25, least=2).select("document_id", "key", "pages")


@query(f"WITH {MARGINS} SELECT keyed.d AS document_id, p AS page_number, count(*) FILTER (n IS NULL OR (a > 3 AND b > 3)) AS kept, count(*) FILTER (n IS NOT NULL AND (a <= 3 OR b <= 3)) AS gone FROM keyed LEFT JOIN repeated USING (d, k) GROUP BY 1, 2")
def margin_removed(spark, sf_dir):
    pages = doc_pages(spark, sf_dir)
    lines = P.page_lines(pages)
    got = P.without_margins(lines, P.repeated_margins(lines, pages, ratio=0.25, least=2))
    kept = F.when(F.col("clean_text") == "", 0).otherwise(F.size(F.split("clean_text", "\n"))).cast("long")
    return got.select("document_id", "page_number", kept.alias("kept"), F.size("removed_lines").cast("long").alias("gone"))


@query("SELECT doc_id AS document_id, true AS offsets_match, true AS bounded, true AS covers FROM documents WHERE trim(text) <> ''")
def chunk_invariants(spark, sf_dir):
    pages = documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), X.clean_text(F.col("text")).alias("clean_text"))
    got = P.chunks(pages, size=3000, overlap=250).join(pages.select("document_id", "clean_text"), "document_id")
    exact = F.substring("clean_text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col("text")
    return got.groupBy("document_id").agg(F.bool_and(exact).alias("offsets_match"), F.bool_and(F.length("text") <= 3000).alias("bounded"), ((F.min("char_start") == 0) & (F.max("char_end") == F.max(F.length("clean_text")))).alias("covers"))


CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\x{00a0}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '')"


def sql_stop(size: int, back: int, s: str = "s") -> str:
    """End of a chunk that begins at s of text t with n characters: after the last best mark of the characters before the limit."""
    lo, hi = f"greatest({s} + 1, {s} + {size} - {back})", f"{s} + {size}"
    near = f"reverse(substr(t, {lo} + 1, {hi} - {lo}))"
    ends = [f"WHEN contains({near}, reverse({m})) THEN {hi} - strpos({near}, reverse({m})) + 1" for m in ("chr(10) || chr(10)", "chr(10)", "'. '", "'; '", "', '", "' '")]
    return f"CASE WHEN {s} + {size} >= n THEN n {' '.join(ends)} ELSE {hi} END"


def sql_next(overlap: int) -> str:
    """Begin of the next chunk: back by the overlap from e, then to the place after the next white space."""
    at = f"greatest(e - {overlap}, s + 1)"
    return rf"least(e, {at} + length(regexp_extract(substr(t, {at}, e - {at} + 1), '^\S*')))"


@query(rf"""WITH RECURSIVE clean AS (SELECT doc_id d, {CLEAN} t FROM documents), page AS (SELECT d, t, length(t) n FROM clean WHERE t <> ''),
walk(d, s, e) AS (SELECT d, 0::BIGINT, ({sql_stop(800, 200, "0")})::BIGINT FROM page UNION ALL SELECT d, s, {sql_stop(800, 200)} FROM (SELECT walk.d, t, n, {sql_next(100)} AS s FROM walk JOIN page USING (d) WHERE e < n)),
inked AS (SELECT d, s + length(x) - length(regexp_replace(x, '^\s+', '')) a, e - length(x) + length(regexp_replace(x, '\s+$', '')) b, t FROM (SELECT *, substr(t, s + 1, e - s) x FROM walk JOIN page USING (d)))
SELECT d AS document_id, (row_number() OVER (PARTITION BY d ORDER BY a) - 1)::INT AS chunk_index, a::INT AS char_start, b::INT AS char_end, sha256(substr(t, a + 1, b - a)) AS hash FROM inked WHERE a < b""")
def chunk_rows(spark, sf_dir):
    pages = documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), X.clean_text(F.col("text")).alias("clean_text"))
    return P.chunks(pages, size=800, overlap=100, back=200).select("document_id", "chunk_index", "char_start", "char_end", F.sha2("text", 256).alias("hash"))


READING = "reading AS (SELECT conv_id d, turn + 1 p, max(text) r FROM conversations GROUP BY ALL)"


@query(f"WITH {PAGES}, {READING} SELECT d AS document_id, p AS page_number, CASE WHEN poor AND trim(r) <> '' THEN 'SECOND_READING' ELSE 'NATIVE' END AS text_origin, length(CASE WHEN poor AND trim(r) <> '' THEN r ELSE t END)::BIGINT AS n FROM (SELECT *, length(trim(t, ' ' || chr(10) || chr(9) || chr(13))) < 80 poor FROM page) LEFT JOIN reading USING (d, p)")
def page_source_merge(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("document_id"), (F.col("turn") + 1).cast("int").alias("page_number")).agg(F.max("text").alias("reading"))
    return P.second_reading(doc_pages(spark, sf_dir), talk).select("document_id", "page_number", "text_origin", F.length("raw_text").cast("long").alias("n"))


@query(f"WITH {PAGES}, {READING} SELECT d AS document_id, p AS page_number, true AS known FROM page SEMI JOIN reading USING (d, p) UNION ALL SELECT d, p, false FROM reading ANTI JOIN page USING (d, p)")
def page_lookup(spark, sf_dir):
    pages = doc_pages(spark, sf_dir).select("document_id", "page_number")
    talk = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), (F.col("turn") + 1).cast("int").alias("page_number")).distinct()
    return pages.join(talk, P.PAGE, "left_semi").withColumn("known", F.lit(True)).unionByName(talk.join(pages, P.PAGE, "left_anti").withColumn("known", F.lit(False)))


@query("SELECT doc_id AS document_id, 1 AS page_number, 'single' AS kind FROM documents WHERE NOT contains(text, chr(10)) UNION ALL SELECT doc_id, len(string_split(text, chr(10)))::INT, 'lines' FROM documents WHERE contains(text, chr(10))")
def single_page_docs(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), "text")
    lines = docs.where(F.contains("text", F.lit("\n"))).select("document_id", F.size(F.split("text", "\n")).alias("page_number"), F.lit("lines").alias("kind"))
    single = docs.join(lines.select("document_id"), "document_id", "left_anti").select("document_id", F.lit(1).alias("page_number"), F.lit("single").alias("kind"))
    return single.unionByName(lines)


@query(f"""WITH {PAGES}, e AS (SELECT d, coalesce(min(p - 1) FILTER (p > 10 AND regexp_matches(substr({sql_fold('t')}, 1, 600), '^(the|de|la) ')), max(p)) e, max(p) n FROM page GROUP BY 1)
SELECT d AS document_id, count(*) AS kept, min(e)::BIGINT AS end_page FROM page JOIN e USING (d) WHERE n < 25 OR (p <= e AND NOT contains(substr({sql_fold('t')}, 1, 500), 'sumario')) GROUP BY 1""")
def page_range_filter(spark, sf_dir):
    pages = doc_pages(spark, sf_dir)
    ranged = pages.join(scoring.page_range(pages, "^(the|de|la) "), "document_id")
    kept = ranged.where((F.col("page_count") < 25) | ((F.col("page_number") <= F.col("end_page")) & ~scoring.looks_like_contents(F.col("raw_text"))))
    return kept.groupBy("document_id").agg(F.count(F.lit(1)).alias("kept"), F.min("end_page").alias("end_page"))


def part_dictionary(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Part names as a dictionary: an item for each kind of thing, the names as aliases."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    thing = F.split_part("p_name", F.lit(" "), F.lit(2))
    items = names.select(F.lit("thing").alias("category"), thing.alias("id"), F.initcap(thing).alias("label"), F.lit(0).alias("item_order")).distinct()
    return items, names.select(F.lit("thing").alias("category"), thing.alias("id"), F.upper("p_name").alias("alias"))


@query("""SELECT p_partkey AS part, CASE WHEN p_size % 2 = 0 THEN lower(p_type) ELSE p_name END AS name, CASE WHEN p_size % 2 = 0 THEN NULL ELSE split_part(p_name, ' ', 2) END AS canonical_id, CASE WHEN p_size % 2 = 0 THEN 0.0 ELSE 0.9 END::DOUBLE AS normalization_confidence, CASE WHEN p_size % 2 = 0 THEN 'unmapped:' || lower(p_type) ELSE split_part(p_name, ' ', 2) END AS item_key FROM part""")
def taxonomy_resolve(spark, sf_dir):
    items, aliases = part_dictionary(spark, sf_dir)
    name = F.when(F.col("p_size") % 2 == 0, F.lower("p_type")).otherwise(F.col("p_name"))
    facts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.lit("thing").alias("category"), F.col("p_brand").alias("given_id"), name.alias("name"))
    return taxonomy.resolved(facts, items, taxonomy.alias_table(items, aliases)).select("part", "name", "canonical_id", "normalization_confidence", "item_key")


@query("SELECT p_brand AS brand, string_agg(DISTINCT 'thing:' || lower(p_type), ';' ORDER BY 'thing:' || lower(p_type)) AS gaps FROM part WHERE p_size % 2 = 0 GROUP BY 1")
def taxonomy_gaps(spark, sf_dir):
    items, aliases = part_dictionary(spark, sf_dir)
    name = F.when(F.col("p_size") % 2 == 0, F.lower("p_type")).otherwise(F.col("p_name"))
    facts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.lit("thing").alias("category"), F.lit("none").alias("given_id"), name.alias("name"))
    return taxonomy.gaps(taxonomy.resolved(facts, items, taxonomy.alias_table(items, aliases)), "brand")


@query("SELECT 'alias_collision' AS rule, 'brand' AS category, lower(p_type) AS subject FROM part GROUP BY p_type HAVING count(DISTINCT p_brand) > 1 UNION ALL SELECT 'duplicate_id', 'brand', p_brand FROM (SELECT DISTINCT p_brand, p_type FROM part) GROUP BY 3 HAVING count(*) > 1")
def taxonomy_checks(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    items = parts.select(F.lit("brand").alias("category"), F.col("p_brand").alias("id"), F.col("p_brand").alias("label"))
    return taxonomy.checks(items, parts.select(F.lit("brand").alias("category"), F.col("p_brand").alias("id"), F.col("p_type").alias("alias")))


@query("SELECT n_regionkey::VARCHAR AS category, string_agg(n_name || ': ' || lower(n_name), chr(10) ORDER BY n_name) AS listing FROM nation GROUP BY 1")
def dictionary_text(spark, sf_dir):
    return taxonomy.listing(table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("category"), F.col("n_name").alias("id"), F.lower("n_name").alias("label")))


TERMS = [("articles", "the"), ("articles", "der"), ("articles", "la"), ("links", "and"), ("links", "und"), ("links", "de la")]
TERM_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in TERMS)
COUNTED = f"k(profile, term) AS (VALUES {TERM_ROWS}), doc AS (SELECT doc_id, text, {sql_fold('text')} t FROM documents)"
WHOLE = "CASE WHEN contains(term, ' ') THEN (length(' ' || replace(t, ' ', '  ') || ' ') - length(replace(' ' || replace(t, ' ', '  ') || ' ', ' ' || replace(term, ' ', '  ') || ' ', ''))) // (length(replace(term, ' ', '  ')) + 2) ELSE len(list_filter(string_split(t, ' '), lambda x: x = term)) END"


@query(f"WITH {COUNTED} SELECT doc_id AS chunk_id, profile, sum(3 + least(n - 1, 4))::BIGINT AS score FROM (SELECT doc_id, profile, term, (length(t) - length(replace(t, term, ''))) // length(term) n, t FROM doc, k) WHERE n > 0 GROUP BY 1, 2")
def chunk_scores(spark, sf_dir):
    terms = spark.createDataFrame(TERMS, "profile string, term string")
    return scoring.keyword_scores(scoring.folded(doc_chunks(spark, sf_dir)), terms)


HEADS = f"list_max(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN regexp_matches({sql_fold('l')}, '^([0-9]+ )+' || term || '$') THEN 500 WHEN regexp_matches({sql_fold('l')}, '^([0-9]+ )+' || term || ' ') THEN 450 WHEN {sql_fold('l')} = term THEN 400 WHEN starts_with({sql_fold('l')}, term || ' ') THEN 340 ELSE 0 END))"
ALIASED = f"{COUNTED}, scored AS (SELECT doc_id, profile, max(8 + least(n, 6) + h + CASE WHEN contains(substr(t, 1, 1200), term) THEN 12 ELSE 0 END)::BIGINT s FROM (SELECT doc_id, profile, term, t, {WHOLE} n, {HEADS} h FROM doc, k) WHERE n > 0 GROUP BY ALL)"


def item_terms(spark) -> DataFrame:
    return spark.createDataFrame(TERMS, "item string, term string")


@query(f"WITH {ALIASED} SELECT doc_id AS chunk_id, profile AS item, s AS score FROM scored")
def alias_best(spark, sf_dir):
    return scoring.alias_scores(scoring.folded(doc_chunks(spark, sf_dir)), item_terms(spark))


@query(f"WITH {ALIASED} SELECT doc_id AS document_id, string_agg(profile, ',' ORDER BY profile) AS items, count(*) AS n_items FROM scored WHERE s >= 180 GROUP BY 1")
def items_detected(spark, sf_dir):
    scores = scoring.alias_scores(scoring.folded(doc_chunks(spark, sf_dir)), item_terms(spark))
    return scoring.detected(scores.withColumnRenamed("chunk_id", "document_id"), 180)


@query(f"WITH {ALIASED} SELECT * FROM (SELECT source AS document_id, profile, doc_id AS chunk_id, s AS score, row_number() OVER (PARTITION BY source, profile ORDER BY s DESC, doc_id) AS rank FROM scored JOIN documents USING (doc_id)) WHERE rank <= 14")
def route_topk(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.lit(1).alias("page_number"), F.col("doc_id").alias("chunk_index"), "text")
    folded = scoring.folded(docs)
    scores = scoring.alias_scores(folded, item_terms(spark)).withColumnRenamed("item", "profile")
    return scoring.routed([scores, scores], docs, 14).select("document_id", "profile", "chunk_id", "score", "rank")


@query(f"WITH {COUNTED} SELECT source AS document_id, term AS item, arg_min(doc_id, (-s, doc_id)) AS chunk_id, max(s) AS score FROM (SELECT source, doc_id, term, 80 + CASE WHEN contains(substr(t, 1, 1000), term) THEN 20 ELSE 0 END AS s FROM doc JOIN documents USING (doc_id), k WHERE contains(t, term)) GROUP BY 1, 2")
def identity_phrase_score(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.lit(1).alias("page_number"), F.col("doc_id").alias("chunk_index"), "text")
    phrases = spark.createDataFrame([(t, t) for _, t in TERMS], "item string, term string")
    got = scoring.best_chunk(scoring.phrase_scores(scoring.folded(docs), phrases), docs, ["document_id", "item"])
    return got.select("document_id", "item", "chunk_id", "score")


@query(f"WITH {ALIASED}, top AS (SELECT * FROM (SELECT source d, profile, doc_id c, row_number() OVER (PARTITION BY source, profile ORDER BY s DESC, doc_id) r FROM scored JOIN documents USING (doc_id)) WHERE r <= 5) SELECT d AS document_id, string_agg(profile || '=' || ids, ';' ORDER BY profile) AS routes FROM (SELECT d, profile, string_agg(c::VARCHAR, ',' ORDER BY c) ids FROM top GROUP BY ALL) GROUP BY 1")
def stage_routes(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.lit(1).alias("page_number"), F.col("doc_id").alias("chunk_index"), "text")
    scores = scoring.alias_scores(scoring.folded(docs), item_terms(spark)).withColumnRenamed("item", "profile")
    routes = scoring.stage_routes(scoring.routed([scores], docs, 5))
    shown = F.transform(F.map_entries("routes"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.transform(e["value"], lambda c: c.cast("string")), ",")))
    return routes.select("document_id", F.array_join(shown, ";").alias("routes"))


@query(f"WITH {COUNTED} SELECT doc_id AS chunk_id, profile, sum(3 + least(n - 1, 4))::BIGINT AS score FROM (SELECT doc_id, profile, term, (length(t) - length(replace(t, term, ''))) // length(term) n FROM doc, k) WHERE n > 0 GROUP BY 1, 2")
def chunk_scores_inside(spark, sf_dir):
    """Keywords count inside longer words, too."""
    terms = spark.createDataFrame(TERMS, "profile string, term string")
    return scoring.keyword_scores(scoring.folded(doc_chunks(spark, sf_dir)), terms)


@query(f"WITH {COUNTED} SELECT doc_id AS chunk_id, profile, sum(3 + least(n - 1, 4))::BIGINT AS score FROM (SELECT doc_id, profile, term, (length(t) - length(replace(t, term, ''))) // length(term) n FROM doc, k) WHERE n > 0 GROUP BY 1, 2")
def chunk_scores_joined(spark, sf_dir):
    """As chunk_scores_inside, with a dictionary of several automata."""
    terms = spark.createDataFrame(TERMS, "profile string, term string")
    return scoring.keyword_scores(scoring.folded(doc_chunks(spark, sf_dir)), terms, letters=8)


@query(f"WITH {COUNTED} SELECT source AS document_id, term AS item, arg_min(doc_id, (-s, doc_id)) AS chunk_id, max(s) AS score FROM (SELECT source, doc_id, term, 80 + CASE WHEN contains(substr(t, 1, 1000), term) THEN 20 ELSE 0 END AS s FROM doc JOIN documents USING (doc_id), k WHERE contains(t, term)) GROUP BY 1, 2")
def phrase_scores_inside(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.lit(1).alias("page_number"), F.col("doc_id").alias("chunk_index"), "text")
    phrases = spark.createDataFrame([(t, t) for _, t in TERMS], "item string, term string")
    got = scoring.best_chunk(scoring.phrase_scores(scoring.folded(docs), phrases), docs, ["document_id", "item"])
    return got.select("document_id", "item", "chunk_id", "score")
