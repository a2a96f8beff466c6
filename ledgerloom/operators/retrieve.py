"""Lexical retrieval of rows for a table of questions, evidence numbering and citation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ledgerloom.functions.text import fold, squeeze, tokens
from ledgerloom.operators.automaton import LETTERS, contained, occurrences
from ledgerloom.sources.shared import stored


def accepted(questions: DataFrame, longest: int = 1200) -> DataFrame:
    """Questions with a verdict: EMPTY, TOO_LONG or OK."""
    text = squeeze(F.coalesce("question", F.lit("")))
    return questions.withColumn("question", text).withColumn("verdict", F.when(text == "", "EMPTY").when(F.length(text) > longest, "TOO_LONG").otherwise("OK"))


def shared_tokens(questions: DataFrame, rows: DataFrame, weight: int = 5, stop: list[str] = []) -> DataFrame:
    """(question_id, row_id, score): weight x number of shared tokens, by an inverted index of both sides; inside a
    portfolio where both sides have a portfolio_id."""
    place = [c for c in ("portfolio_id",) if c in questions.columns and c in rows.columns]
    # dealt by question before tokens are cut: where the rows are few enough to be broadcast, pairs are counted and ranked where they are made
    asked = questions.select(*place, "question_id", "question").repartition("question_id")
    q = asked.select(*place, "question_id", F.explode(tokens(F.col("question"), stop)).alias("token"))
    r = rows.select(*place, "row_id", F.explode(tokens(F.col("search_text"), stop)).alias("token"))
    return q.join(r, [*place, "token"]).groupBy("question_id", "row_id").agg((F.count(F.lit(1)) * weight).alias("score"))


SIDES = {f"side {x}": f"side_{x}" for x in "abc"}
ASKED = {"NEEDS_REVIEW": (30, ["revis", "ambigu", "conflit"]), "EQUAL": (16, ["igual", "comum", "todas", "todos"]), "ONLY_IN_SOME": (16, ["algumas", "apenas", "parcial", "so em"]), "DIFFERENT": (12, ["difer", "compar"])}


PACK, DEALT = 1_000_000, 16  # rows of one list, parts into which a portfolio's lists are dealt


def named_fields(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """(portfolio_id, question_id, field_id): the fields of rows whose folded id a question contains. Written, so that rows meet them where they are."""
    fields = stored(rows.select("field_id").distinct().withColumn("term", fold(F.col("field_id"))).where("term <> ''"), "fields")
    hits = contained(questions.select(F.struct("portfolio_id", "question_id").alias("chunk_id"), fold(F.col("question")).alias("norm")), fields)
    return stored(hits.join(fields, "term").select("chunk_id.portfolio_id", "chunk_id.question_id", "field_id"), "named")


def boosted(questions: DataFrame, rows: DataFrame, weight: int = 5, stop: list[str] = [], pairs: DataFrame | None = None) -> DataFrame:
    """(question_id, row_id, status, score) of comparison rows (portfolio_id, row_id, label, field_id, status, search_text)
    for the questions (portfolio_id, question_id, question) of their portfolio: weight x shared tokens, 25 for the label and
    18 for the field id in the question, 50 for the row of a side it names and the boost of a status it asks for. Rows
    without a score are left out; rank by score, then rows that are not ALL_MISSING. `pairs` (question_id, row_id): score these alone.
    Without them rows of a portfolio that are alike in status, label and search text meet a question as one list; only rows whose field
    a question names (sides are such fields) are scored by themselves."""
    key = fold(F.col("question"))
    asks = [F.when(F.rlike(key, F.lit("|".join(markers))), boost).otherwise(0).alias(f"__{status}") for status, (boost, markers) in ASKED.items()]  # folded words
    q = questions.select("portfolio_id", "question_id", key.alias("__asked"), tokens(F.col("question"), stop).alias("__tokens"), *asks)
    texts = [fold(F.col("label")).alias("__label"), F.split(fold(F.col("search_text")), " ").alias("__words")]
    r = rows.select("portfolio_id", "row_id", "field_id", "status", fold(F.col("field_id")).alias("__field"), *texts)
    has = lambda x: F.contains("__asked", x)
    held = lambda x: F.coalesce((x != "") & has(x), F.lit(False))
    alike = F.coalesce(F.size(F.array_intersect("__tokens", "__words")), F.lit(0)) * weight + F.when(held(F.col("__label")), 25).otherwise(0)
    for status in ASKED:
        alike = alike + F.when(F.col("status") == status, F.col(f"__{status}")).otherwise(0)
    score = alike + F.when(held(F.col("__field")), 18).otherwise(0)
    for words, field in SIDES.items():
        score = score + F.when(has(F.lit(words)) & (F.col("field_id") == field), 50).otherwise(0)
    scored = lambda met: met.select("question_id", "row_id", "status", score.cast("long").alias("score")).where("score > 0")
    if pairs is not None:
        return scored(pairs.join(q, "question_id").join(r.drop("portfolio_id"), "row_id"))
    # rows are listed where they are before they are exchanged; a list holds at most PACK rows on average, were all rows alike
    nth = F.pmod(F.xxhash64("row_id"), F.lit(-(-rows.count() // PACK) or 1)).alias("nth")
    at = F.xxhash64("status", "label", "search_text", "nth").alias("list")
    own = named_fields(questions, rows).join(rows, ["portfolio_id", "field_id"]).select("*", nth).select("*", at)
    mine = own.groupBy("portfolio_id", "question_id").agg(F.collect_set(F.struct("list", "row_id")).alias("__own"))
    own = own.select("portfolio_id", "question_id", "row_id", "field_id", "status", fold(F.col("field_id")).alias("__field"), *texts)
    packs = rows.groupBy("portfolio_id", "status", "label", "search_text", nth).agg(F.collect_list("row_id").alias("ids"))
    # of questions and lists the questions are copied, as lists are as many as the rows
    packs = packs.select("portfolio_id", "status", *texts, "ids", at).withColumn("deal", F.pmod("list", F.lit(DEALT)))
    dealt = q.join(mine, ["portfolio_id", "question_id"], "left").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    met = dealt.join(packs, ["portfolio_id", "deal"]).withColumn("score", alike.cast("long")).where("score > 0")
    # a list is looked through only where a row of it is scored by itself
    gone = F.transform(F.filter(F.coalesce("__own", F.array()), lambda x: x["list"] == F.col("list")), lambda x: x["row_id"])
    met = met.select("question_id", "status", "score", "ids", gone.alias("gone")).withColumn("ids", F.when(F.size("gone") == 0, F.col("ids")).otherwise(F.array_except("ids", "gone")))
    plain = met.select("question_id", F.explode("ids").alias("row_id"), "status", "score")
    return plain.unionByName(scored(q.join(own, ["portfolio_id", "question_id"])))


def top(scores: DataFrame, limit: int, tie: list = ["row_id"]) -> DataFrame:
    order = W.partitionBy("question_id").orderBy(F.desc("score"), *tie)
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


def merged(sources: list[DataFrame], limit: int) -> DataFrame:
    """Ordered union without repeats of (question_id, row_id, inner_rank) candidates; earlier sources come first."""
    every = None
    for k, one in enumerate(sources):
        one = one.select("question_id", "row_id", F.struct(F.lit(k).alias("source"), F.col("inner_rank").cast("long").alias("inner")).alias("at"))
        every = one if every is None else every.unionByName(one)
    first = every.groupBy("question_id", "row_id").agg(F.min("at").alias("at"))
    order = W.partitionBy("question_id").orderBy("at", "row_id")
    return first.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


def intent(question: Column, rules: list[tuple[str, list[str]]], default: str = "FREE") -> Column:
    """First intent of ordered rules one of whose phrases the folded question contains."""
    key, out = fold(question), F.lit(default)
    for name, phrases in reversed(rules):
        test = F.lit(False)
        for p in phrases:
            test = test | F.contains(key, F.lit(p))
        out = F.when(test, name).otherwise(out)
    return out


def numbered_evidence(evidence: DataFrame, by: str, key: list[str], order: list, limit: int = 12) -> DataFrame:
    """Distinct evidence of each question in order, named E1, E2, ..."""
    first = evidence.groupBy(by, *key).agg(F.min(F.struct(*order)).alias("at"))
    n = F.row_number().over(W.partitionBy(by).orderBy("at", *key))
    return first.withColumn("n", n.cast("long")).where(F.col("n") <= limit).withColumn("evidence_id", F.concat(F.lit("E"), F.col("n").cast("string"))).drop("at")


def evidence_of_rows(scores: DataFrame, held: DataFrame, limit: int = 12) -> DataFrame:
    """(question_id, document_id, n, evidence_id): the documents of held (row_id, document_id) that hold a question's rows, in the order of score, row and
    document. Of a row only its first `limit` documents can be among a question's first, and rows after which `limit` documents are certain are
    not opened: each document counts for one row of all, so sums of these counts are never more than the documents there are."""
    first = held.select("row_id", "document_id").distinct().withColumn("nth", F.row_number().over(W.partitionBy("row_id").orderBy("document_id"))).where(F.col("nth") <= limit)
    owner = F.min("row_id").over(W.partitionBy("document_id"))
    packs = first.withColumn("own", (owner == F.col("row_id")).cast("long")).groupBy("row_id").agg(F.collect_list("document_id").alias("documents"), F.sum("own").alias("own"))
    order = W.partitionBy("question_id").orderBy(F.desc("score"), "row_id").rowsBetween(W.unboundedPreceding, -1)
    opened = scores.join(packs, "row_id").withColumn("certain", F.coalesce(F.sum("own").over(order), F.lit(0))).where(F.col("certain") < limit)
    found = opened.select("question_id", "row_id", (-F.col("score")).alias("order"), F.explode("documents").alias("document_id"))
    return numbered_evidence(found, "question_id", ["document_id"], ["order", "row_id"], limit)


def citations(answers: DataFrame, available: DataFrame) -> DataFrame:
    """answers(answer_id, answer, cited) with the cited ids in order that exist in available(answer_id, ids), and the invalid ones."""
    inline = F.regexp_extract_all("answer", F.lit(r"\[(E\d+)\]"), F.lit(1))
    every = F.array_distinct(F.concat(F.coalesce("cited", F.array().cast("array<string>")), F.coalesce(inline, F.array().cast("array<string>"))))
    out = answers.withColumn("every", every).join(available, "answer_id", "left")
    known = F.coalesce("ids", F.array().cast("array<string>"))
    return out.withColumn("valid_ids", F.array_intersect("every", known)).withColumn("invalid_ids", F.array_except("every", known)).drop("every", "ids")


def cached(questions: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions whose folded form was answered before, questions still to answer)."""
    key = fold(F.col("question"))
    known = answers.select(key.alias("key"), "answer_id").groupBy("key").agg(F.min("answer_id").alias("answer_id"))
    asked = questions.withColumn("key", key)
    return asked.join(known, "key"), asked.join(known, "key", "left_anti")


def matched_item(questions: DataFrame, phrases: DataFrame, letters: int = LETTERS) -> DataFrame:
    """(question_id, item, term): the item with the longest phrase (item, term) contained in the question, inside words too."""
    hits = occurrences(questions.select(F.col("question_id").alias("chunk_id"), fold(F.col("question")).alias("norm")), phrases.select("item", "term"), letters=letters)
    order = W.partitionBy("chunk_id").orderBy(F.desc(F.length("term")), "item", "term")
    return hits.withColumn("rank", F.row_number().over(order)).where("rank = 1").select(F.col("chunk_id").alias("question_id"), "item", "term")


def label_map(items: DataFrame) -> DataFrame:
    """(id, label) of the ids that have one label only."""
    return items.groupBy("id").agg(F.count_distinct("label").alias("n"), F.min("label").alias("label")).where("n = 1").select("id", "label")


def humanized(texts: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """texts(text_id, text) with `[id]` and `` `id` `` replaced by labels; ids without a label stay. The ids of a text meet
    the labels in a join and are folded back, the longest first."""
    found = texts.select("text_id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\[`]([A-Za-z][A-Za-z0-9_]*)[\]`]"), F.lit(1)))).alias("id"))
    pairs = found.join(labels, "id").groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct((-F.length("id")).alias("n"), "id", "label"))).alias("pairs"))
    put = lambda t, p: F.replace(F.replace(t, F.concat(F.lit("["), p["id"], F.lit("]")), p["label"]), F.concat(F.lit("`"), p["id"], F.lit("`")), p["label"])
    out = texts.join(pairs, "text_id", "left")
    return out.withColumn(text, F.when(F.col("pairs").isNull(), F.col(text)).otherwise(F.aggregate("pairs", F.col(text), put))).drop("pairs")


def local_answers(questions: DataFrame, rows: DataFrame, caps: dict[str, tuple[str, int]]) -> DataFrame:
    """Answers that need no model: questions(question_id, portfolio_id, intent) and rows(portfolio_id, status, label, field_id);
    caps names for each intent the status it lists and how many rows. Bullets are built once a portfolio and intent."""
    plan = F.create_map(*(F.lit(x) for intent, (status, _) in caps.items() for x in (status, intent)))
    most = F.create_map(*(F.lit(x) for intent, (_, n) in caps.items() for x in (intent, n)))
    listed = rows.withColumn("intent", F.try_element_at(plan, F.col("status"))).where("intent is not null")
    rank = F.row_number().over(W.partitionBy("portfolio_id", "intent").orderBy("label", "field_id"))
    listed = listed.withColumn("rank", rank).where(F.col("rank") <= F.element_at(most, F.col("intent")))
    line = F.concat(F.lit("- "), F.col("label"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n")
    bullets = listed.groupBy("portfolio_id", "intent").agg(text.alias("answer"))
    return questions.join(bullets, ["portfolio_id", "intent"], "left")


def guarded(answer: Column, is_request: Column, refusal: str, markers: list[str], support: str) -> Column:
    """Answers to requests for a recommendation: without a refusal they become the fixed text; the support text is added once."""
    key, refuses = fold(answer), F.lit(False)
    for m in markers:
        refuses = refuses | F.contains(key, F.lit(m))
    text = F.when(refuses, answer).otherwise(F.lit(refusal))
    text = F.when(F.contains(text, F.lit(support)), text).otherwise(F.concat(text, F.lit(" "), F.lit(support)))
    return F.when(is_request, text).otherwise(answer)
