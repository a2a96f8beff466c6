"""One query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import capfilter, conversation, decontaminate, html_text, jaccard, langid, negatives, packing, quality, records, sharding, substring, suffix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(divisor: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor))


def op1_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2("text", 256).alias("key"))
    out = sharding.pack_shards(rows, "key", "size", shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(fold(4) != 2))
    return langid.identify(docs.select("doc_id", (fold(4) == 2).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.with_words(docs))


def op5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = records.write_records(table(spark, sf_dir, "documents").select("doc_id", "text"), records.tokenizer_path())
    return records.read_records(manifest)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op7_capfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilter.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(3) != 1)
    scored = quality.score_quality(docs, labels)
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.drop("hamming")  # SQL has no fingerprints


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), "embedding")
    return negatives.hard_negatives(vectors, "vec_id % 50 = 0")


def op12_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


def op13_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.digests(conversation.damaged(table(spark, sf_dir, "conversations")))


def queries() -> dict:
    return {
        "op1_suffix": op1_suffix,
        "op2_sharding": op2_sharding,
        "op3_language": op3_language,
        "op4_packing": op4_packing,
        "op5_records": op5_records,
        "op6_html": op6_html,
        "op7_capfilter": op7_capfilter,
        "op8_quality": op8_quality,
        "op9_decontaminate": op9_decontaminate,
        "op10_jaccard": op10_jaccard,
        "op11_negatives": op11_negatives,
        "op12_substring": op12_substring,
        "op13_conversation": op13_conversation,
    }


OP1_SQL = """WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS k FROM d WHERE doc_id IS NOT NULL AND n >= 50)),
hit AS (SELECT doc_id, k FROM w JOIN (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(*) > 1) USING (s) WHERE least < doc_id),
run AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS r FROM (SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= 50 THEN 0 ELSE 1 END AS fresh FROM hit)) GROUP BY doc_id, r),
piece AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM run),
gone AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM piece JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id"""

OP7_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(i, k) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.i, link.j FROM reach JOIN link ON reach.k = link.i)
SELECT reach.i AS vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(k) AS component_id, min(k) = reach.i AS kept FROM reach LEFT JOIN (SELECT i, count(*) AS n FROM link GROUP BY 1) c ON c.i = reach.i GROUP BY reach.i"""

OP9_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(lower(min(text)), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id),
i AS MATERIALIZED (SELECT item_id, len(w) AS m, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS g FROM b WHERE len(w) >= 5),
g AS MATERIALIZED (SELECT doc_id, n, x.pos AS pos, x.g AS g FROM (SELECT doc_id, len(w) AS n, unnest(list_transform(range(0, len(w) - 4), lambda k: {'pos': k, 'g': array_to_string(w[k + 1:k + 5], ' ')})) AS x FROM d WHERE len(w) >= 5)),
s AS (SELECT DISTINCT doc_id, n, m, greatest(least(pos, n - m), 0) AS start FROM g JOIN (SELECT DISTINCT m, g FROM i) USING (g)),
c AS (SELECT s.doc_id, s.n, s.m, s.start, g.g, count(*) AS cw FROM s JOIN g ON g.doc_id = s.doc_id AND g.pos BETWEEN s.start AND s.start + s.m - 5 GROUP BY ALL),
o AS (SELECT doc_id, n, m, start, item_id, sum(least(cw, ci)) AS o FROM c JOIN (SELECT item_id, m, g, count(*) AS ci FROM i GROUP BY ALL) USING (m, g) GROUP BY ALL),
f AS (SELECT doc_id, item_id, start, least(m, n - start) AS n_words, o / (least(m, n - start) - 4 + m - 4 - o) AS similarity FROM o WHERE o * 180 >= 80 * (least(m, n - start) - 4 + m - 4))
SELECT doc_id, item_id, start::INT AS start, n_words::INT AS n_words, similarity FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1"""

OP10_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
link AS MATERIALIZED (SELECT i, j FROM (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL) JOIN n x ON x.doc_id = i JOIN n y ON y.doc_id = j WHERE 100 * o >= 90 * (x.n + y.n - o)),
reach(i, k) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.i, link.j FROM reach JOIN link ON reach.k = link.i)
SELECT i AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(k) AS component_id FROM reach LEFT JOIN n ON n.doc_id = i GROUP BY i"""


OP11_SQL = """WITH v AS (SELECT row_number() OVER () AS u, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS MATERIALIZED (SELECT a.u, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.e, b.e)::BIGINT AS s FROM v a JOIN v b ON len(a.e) = len(b.e) AND a.u <> b.u WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY s DESC, vec_id) AS k FROM s WHERE same QUALIFY k <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.u, k ORDER BY n.s DESC, n.vec_id)::INT AS rank, n.vec_id AS negative_id, p.s AS positive_score, n.s AS negative_score FROM p JOIN s n ON n.u = p.u AND NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s QUALIFY rank <= 3"""

OP12_SQL = r"""WITH d AS (SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT u, doc_id, k, array_to_string(w[k:k + 49], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 48)) AS k FROM d WHERE doc_id IS NOT NULL AND len(w) >= 50)),
hit AS (SELECT u, k FROM g JOIN (SELECT s, min(doc_id) AS least FROM g GROUP BY s HAVING count(*) > 1) USING (s) WHERE least < doc_id),
gone AS (SELECT DISTINCT u, k + j AS i FROM hit, range(0, 50) t(j)),
kept AS (SELECT u, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM (SELECT u, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d) ANTI JOIN gone USING (u, i) GROUP BY u)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (u)"""


def repair_sql() -> str:
    """The dynamic program as a recursion over rows from the last to the first: four (cost, edits, rows) a conversation, of which
    the least is the cheapest with the ASCII-least edits."""
    edit = lambda letter, cost, after, row: f"{{'c': {cost} + {after}.c, 'a': '{letter}' || {after}.a, 't': {row} || {after}.t}}"  # noqa: E731
    keeps, follows, roles = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}], [2, 2, 3, 2], ["user", "user", "assistant", "user"]
    row = "chr(10) || role || ':' || text"
    base = []
    for q in range(4):
        keep = "".join(f" WHEN '{c}' THEN {edit('K', 'more', f's{to}', row)}" for c, to in keeps[q].items())
        fresh = "chr(10) || '" + roles[q] + ":' || text"
        base.append(f"least({edit('D', 4, f's{q}', chr(39) * 2)}, CASE WHEN f IN (0, 3) THEN CASE initial{keep} END END, CASE WHEN f IN (0, 3) THEN {edit('R', '3 + more', f's{follows[q]}', fresh)} END) AS b{q}")
    put = lambda q: edit("I", 3, f"b{follows[q]}", f"chr(10) || '{roles[q]}:'")  # noqa: E731
    two = [f"least(b{q}, {put(q)}) AS n{q}" for q in (2, 3)]
    one = [f"least(b{q}, {put(q).replace('b2', 'n2')}) AS s{q}" for q in (0, 1)]
    end = lambda c, roles_: f"{{'c': {c}::BIGINT, 'a': '{'I' * len(roles_)}', 't': {' || '.join(['chr(10) || ' + repr(r + ':') for r in roles_]) or chr(39) * 2}}}"  # noqa: E731
    return rf"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda c: list_reduce(list_prepend(c, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
key AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
coded AS (SELECT key.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS m FROM key, crc),
hurt AS (SELECT conv_id, turn, CASE m WHEN 4 THEN 'user' ELSE role END AS role, CASE m WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM coded WHERE m <> 0 UNION ALL SELECT conv_id, turn, role, text FROM coded WHERE m = 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_replace(text, '[ 	-]+$', '') AS ink FROM hurt),
fault AS MATERIALIZED (SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, CASE WHEN ink = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(ink, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM fault GROUP BY conv_id),
walk(conv_id, i, s0, s1, s2, s3) AS (SELECT conv_id, n + 1, {end(0, [])}, {end(6, ['user', 'assistant'])}, {end(3, ['assistant'])}, {end(0, [])} FROM told
UNION ALL SELECT conv_id, i, s0, s1, n2, n3 FROM (SELECT conv_id, i, n2, n3, {', '.join(one)} FROM (SELECT conv_id, i, b0, b1, b2, b3, {', '.join(two)} FROM (SELECT conv_id, i, {', '.join(base)} FROM (SELECT fault.conv_id, fault.i, role, text, initial, f, CASE WHEN f = 3 THEN 3 ELSE 0 END AS more, s0, s1, s2, s3 FROM walk JOIN fault ON fault.conv_id IS NOT DISTINCT FROM walk.conv_id AND fault.i = walk.i - 1)))))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s0.c, 0) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(substr(s0.t, 2), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN walk ON walk.conv_id IS NOT DISTINCT FROM c.conv_id AND walk.i = 1"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix": OP1_SQL, "op7_capfilter": OP7_SQL, "op9_decontaminate": OP9_SQL, "op10_jaccard": OP10_SQL, "op11_negatives": OP11_SQL, "op12_substring": OP12_SQL, "op13_conversation": repair_sql()}
