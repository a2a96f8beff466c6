"""Scores of chunks against keywords and aliases, and top-k routing of chunks to stages.

Terms meet chunks in one pass of an automaton over each text (operators.automaton), so a chunk's text is neither tokenised nor
shuffled, and only (chunk, term) hits are. Parts that a table of words must hold are found by equi-joins instead (`holding`, `inside`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from ledgerloom.functions.text import fold, fold_marks, substring_count
from ledgerloom.operators.automaton import LETTERS, line_occurrences, occurrences


def folded(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("norm", fold(F.col("text")))


def first_token(term) -> F:
    return F.split_part(term, F.lit(" "), F.lit(1))


def holding(words: DataFrame, parts: DataFrame) -> DataFrame:
    """(token, part): the distinct words (token) that hold a part (part) anywhere: an equi-join on its first three letters."""
    vocabulary = words.select("token").distinct()
    at = F.sequence(F.lit(1), F.length("token"))
    begin = lambda n: F.transform(at, lambda i: F.substring(F.col("token"), i, F.lit(n)))
    grams = F.concat(begin(1), begin(2), begin(3))
    grams = vocabulary.where("token <> ''").select("token", F.explode(F.array_distinct(grams)).alias("gram"))
    wanted = parts.select("part").where("part <> ''").distinct().withColumn("gram", F.substring("part", 1, 3))
    return grams.join(wanted, "gram").where(F.contains("token", F.col("part"))).select("token", "part")


def inside(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(token, term): the words (token) in which an occurrence of a term (term) can begin: a term of one token stands
    anywhere in a word, the first token of a longer one ends a word. Empty terms occur nowhere."""
    wanted = terms.where("term <> ''").select("term", first_token(F.col("term")).alias("part")).distinct()
    begins = F.endswith("token", F.col("part")) | (F.col("part") == F.col("term"))
    return holding(words, wanted).join(wanted, "part").where(begins).select("token", "term")


def keyword_scores(chunks: DataFrame, keywords: DataFrame, cap: int = 4, letters: int = LETTERS) -> DataFrame:
    """(chunk_id, profile, score): each keyword (profile, term) that occurs, inside words too, gives 3 plus its further occurrences
    up to `cap`. letters: size of an automaton, see operators.automaton."""
    found = occurrences(chunks, keywords, letters=letters)
    return found.groupBy("chunk_id", "profile").agg(F.sum(3 + F.least(F.col("n") - 1, F.lit(cap))).alias("score"))


def lines_of(chunks: DataFrame, cut: str = "\n", key: list[str] = ["chunk_id"]) -> DataFrame:
    """(key..., keys, marks, upper): a chunk's lines, as line_occurrences() takes them. `upper`: what stands before a colon is in capitals."""
    lines = F.split("text", cut)
    head = lambda x: F.trim(F.split_part(x, F.lit(":"), F.lit(1)))
    return chunks.select(*key, F.transform(lines, fold).alias("keys"), F.transform(lines, fold_marks).alias("marks"), F.transform(lines, lambda x: (head(x) != "") & (head(x) == F.upper(head(x)))).alias("upper"))


def near_top(top: int) -> F:
    """The first occurrence lies whole in the first `top` letters."""
    return F.col("first") + F.length("term") <= top


def alias_scores(chunks: DataFrame, terms: DataFrame, top: int = 1200) -> DataFrame:
    """(chunk_id, item, score) of terms (item, term): the best alias. Whole occurrences give 8 + up to 6, a heading line
    180 plus its rank, a place near the top 12."""
    found = line_occurrences(lines_of(chunks), terms, top=top).where("whole > 0")
    heading = F.when(F.col("head") > 0, F.col("head") + 180).otherwise(0)
    score = 8 + F.least("whole", F.lit(6)) + F.when(near_top(top), 12).otherwise(0) + heading
    return found.groupBy("chunk_id", "item").agg(F.max(score.cast("long")).alias("score"))


def best_chunk(scores: DataFrame, chunks: DataFrame, by: list[str]) -> DataFrame:
    """The chunk with the highest score of each group; ties go to the lower page, then the lower index."""
    placed = scores.join(chunks.select("chunk_id", "document_id", "page_number", "chunk_index"), "chunk_id")
    order = W.partitionBy(*by).orderBy(F.desc("score"), "page_number", "chunk_index")
    return placed.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def routed(scored: list[DataFrame], chunks: DataFrame, limit: int) -> DataFrame:
    """Union of candidate sets (chunk_id, profile, score): the best score of a chunk counts, and each document's best
    `limit` chunks of a profile stay, with their place in reading order."""
    every = scored[0]
    for one in scored[1:]:
        every = every.unionByName(one)
    best = every.groupBy("chunk_id", "profile").agg(F.max("score").alias("score"))
    placed = best.join(chunks.select("chunk_id", "document_id", "page_number", "chunk_index"), "chunk_id")
    order = W.partitionBy("document_id", "profile").orderBy(F.desc("score"), "page_number", "chunk_index")
    top = placed.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)
    return top.withColumn("reading_order", F.row_number().over(W.partitionBy("document_id", "profile").orderBy("page_number", "chunk_index")).cast("long"))


def detected(scores: DataFrame, least: int, by: str = "document_id") -> DataFrame:
    """Items of a document whose best score reaches `least`, sorted."""
    best = scores.groupBy(by, "item").agg(F.max("score").alias("score")).where(F.col("score") >= least)
    return best.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set("item")), ",").alias("items"), F.count(F.lit(1)).alias("n_items"))


def looks_like_contents(text):
    """A table of contents: the word near the top, or rows of dots."""
    return F.contains(F.substring(fold(text), 1, 500), F.lit("sumario")) | (substring_count(text, F.lit("....")) >= 4) | (substring_count(text, F.lit("........")) >= 2)


def page_range(pages: DataFrame, pattern: str, after: int = 10) -> DataFrame:
    """(document_id, end_page): the page before the first one after `after` whose head matches, else the last page."""
    head = F.substring(fold(F.col("raw_text")), 1, 600)
    first = F.min(F.when((F.col("page_number") > after) & head.rlike(pattern), F.col("page_number") - 1))
    return pages.groupBy("document_id").agg(F.coalesce(first, F.max("page_number")).cast("long").alias("end_page"), F.max("page_number").cast("long").alias("page_count"))


def phrase_scores(chunks: DataFrame, phrases: DataFrame, head: int = 1000) -> DataFrame:
    """(chunk_id, item, score) of phrases (item, term): 80, and 20 more near the top."""
    score = 80 + F.when(near_top(head), 20).otherwise(0)
    return occurrences(chunks, phrases).groupBy("chunk_id", "item").agg(F.max(score.cast("long")).alias("score"))


def stage_routes(routes: DataFrame) -> DataFrame:
    """(document_id, routes): a map from each stage to its chunk ids in reading order."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "chunk_id"))), lambda x: x["chunk_id"])
    per = routes.groupBy("document_id", "profile").agg(ids.alias("chunks"))
    return per.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("profile", "chunks")))).alias("routes"))
