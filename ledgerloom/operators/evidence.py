"""Claims checked against their sources: validation, repair, recovery, search and regular-expression scalars."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ledgerloom.functions.text import fold, line_around, squeeze
from ledgerloom.operators.automaton import occurrences, supported, supported_within


def validated(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """claims(document_id, claim_id, chunk_id, page_number, excerpt) with status and reason, the first rule that applies."""
    source = chunks.select("document_id", "chunk_id", F.col("page_number").alias("__page"), F.col("text").alias("__text"))
    out = claims.join(source, ["document_id", "chunk_id"], "left")
    status = F.when(F.col("__text").isNull(), "UNKNOWN_CHUNK").when(F.col("__page") != F.col("page_number"), "PAGE_MISMATCH")
    status = status.when(F.contains(squeeze(F.col("__text")), squeeze(F.col("excerpt"))), "VALID").otherwise("NOT_FOUND")
    out = out.withColumn("reason", status)
    return out.withColumn("status", F.when(F.col("reason") == "VALID", "VALID").otherwise("INVALID")).drop("__page", "__text")


def report(results: DataFrame, by: str) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in ("VALID", "INVALID", "REPAIRED", "RECOVERED")]
    got = results.groupBy(by).agg(F.count(F.lit(1)).alias("total"), *counts)
    good = F.col("valid") + F.col("repaired") + F.col("recovered")
    return got.withColumn("validity_rate", F.when(F.col("total") == 0, 1.0).otherwise(good / F.col("total")))


def line_windows(texts: DataFrame, sizes: Column, text: str = "text") -> DataFrame:
    """Windows of consecutive non-empty lines: (…, size, start, window) for each size in an array column."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    out = texts.withColumn("__lines", lines).withColumn("size", F.explode(sizes)).where("size > 0 and size <= size(__lines)")
    out = out.withColumn("start", F.explode(F.sequence(F.lit(1), F.size("__lines") - F.col("size") + 1)))
    return out.withColumn("window", F.array_join(F.slice("__lines", F.col("start"), F.col("size")), "\n")).drop("__lines")


GRAM = 3


def shared_grams(a: int, b: int, least: float) -> float:
    """How many of the character grams of a text of b letters at least occur in one of a letters, if their similarity is `least`: matching letters
    are least * (a + b) / 2 at least; an unmatched letter of b breaks GRAM grams of b, one of a those across its place."""
    matched = least * (a + b) / 2
    return b - GRAM + 1 - GRAM * (b - matched) - (GRAM - 1) * (a - matched) - 1e-6


def nearest(excerpt: str, text: str, least: float) -> tuple[str | None, float, int]:
    """(window, similarity, comparisons): the window of about as many lines as the excerpt that is most similar to it, case and spacing
    ignored, if `least` is reached; ties go to fewer lines, then to the first. A window is compared letter by letter only if its
    length and the number of its grams that the excerpt has, too, a sum over its lines, leave room for `least` and for more than the best one
    so far."""
    key = lambda x: " ".join(x.split()).casefold()
    wanted = key(excerpt)
    grams = {wanted[i : i + GRAM] for i in range(len(wanted) - GRAM + 1)}
    lines = [x.strip(" ") for x in text.split("\n") if x.strip()]
    keys = [key(x) for x in lines]
    size, known = [0], [0]
    for k in keys:
        size.append(size[-1] + len(k) + 1)
        known.append(known[-1] + sum(k[i : i + GRAM] in grams for i in range(len(k) - GRAM + 1)))
    n = max(1, sum(1 for x in excerpt.split("\n") if x.strip()))
    best, found, compared = 0.0, None, 0
    for many in range(max(1, n - 1), min(len(lines), n + 1) + 1):
        for at in range(len(lines) - many + 1):
            length = size[at + many] - size[at] - 1
            bar = max(best, least)
            if 2 * min(len(wanted), length) < bar * (len(wanted) + length) - 1e-6:
                continue
            if known[at + many] - known[at] + GRAM * (many - 1) < shared_grams(len(wanted), length, bar):  # GRAM grams lie across a joint
                continue
            window = " ".join(keys[at : at + many])
            if window == wanted:
                similarity = 1.0
            else:
                compared += 1
                similarity = SequenceMatcher(None, wanted, window, autojunk=False).ratio()
            if similarity > best:
                best, found = similarity, at
                text = "\n".join(lines[at : at + many])
    return (text, best, compared) if found is not None and best >= least else (None, best, compared)


def repaired(claims: DataFrame, chunks: DataFrame, least: float = 0.97, shortest: int = 24) -> DataFrame:
    """(claim_id, window, similarity) of invalid claims (document_id, chunk_id, claim_id, excerpt): the nearest window of their chunk,
    see nearest(). A chunk's text travels once a claim; its windows are cut in the task."""
    asked = claims.where(F.length(squeeze(F.col("excerpt"))) >= shortest)
    joined = asked.join(chunks.select("document_id", "chunk_id", "text"), ["document_id", "chunk_id"]).select("claim_id", "excerpt", "text")
    fields = T.StructType([joined.schema["claim_id"], T.StructField("window", T.StringType()), T.StructField("similarity", T.DoubleType())])

    def run(batches):
        for batch in batches:
            got = [nearest(a, b, least)[:2] if b else (None, 0.0) for a, b in zip(batch.column("excerpt").to_pylist(), batch.column("text").to_pylist())]
            keep = pa.array([w is not None for w, _ in got], pa.bool_())
            out = pa.RecordBatch.from_arrays([batch.column("claim_id"), pa.array([w for w, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], fields.names)
            yield out.filter(keep)

    return joined.mapInArrow(run, fields)


def repaired_folded(claims: DataFrame, chunks: DataFrame, least: float = 0.97, shortest: int = 24) -> DataFrame:
    """As repaired(), by edit distance of the folded texts, without Python: another measure, for very large tables. Lines are folded once a chunk; windows are
    places in them, of which only those of a fitting length leave their row, and a distance is counted no further than `least` allows."""
    n = F.size(filled_lines("excerpt"))
    asked = claims.where(F.length("excerpt") >= shortest).select("document_id", "chunk_id", "claim_id", fold(F.col("excerpt")).alias("a"), F.array(n - 1, n, n + 1).alias("sizes"))
    joined = asked.join(keyed(chunks.select("document_id", "chunk_id", "text")), ["document_id", "chunk_id"])
    part = lambda m, i: F.filter(F.slice("keys", i, m), lambda k: k != "")
    many, wanted = F.size("keys"), F.length("a")
    place = lambda m, i: F.struct(m.alias("size"), i.alias("start"), F.aggregate(part(m, i), F.lit(-1), lambda n, k: n + F.length(k) + 1).alias("length"))
    every = F.flatten(F.transform(F.filter("sizes", lambda m: (m > 0) & (m <= many)), lambda m: F.transform(F.sequence(F.lit(1), many - m + 1), lambda i: place(m, i))))
    longest = lambda w: F.greatest(wanted, w["length"])
    near = F.filter(every, lambda w: (w["length"] > 0) & (F.least(wanted, w["length"]) >= longest(w) * least))
    distance = lambda w: F.call_function("levenshtein", F.col("a"), F.array_join(part(w["size"], w["start"]), " "), F.ceil(longest(w) * (1 - least)).cast("int"))
    told = F.transform(near, lambda w: F.struct(w["size"].alias("size"), w["start"].alias("start"), longest(w).alias("longest"), distance(w).alias("distance")))
    # distances are -1 beyond what they are counted to; outer, as else Spark would make the array once more to see whether it is empty
    found = joined.select("claim_id", "text", F.explode_outer(F.filter(told, lambda w: w["distance"] >= 0)).alias("w")).select("claim_id", "text", "w.*")
    close = found.withColumn("similarity", 1 - F.col("distance") / F.col("longest")).where(F.col("similarity") >= least)
    close = close.select("claim_id", "similarity", "size", "start", F.array_join(F.slice(filled_lines(), F.col("start"), F.col("size")), "\n").alias("window"))
    order = W.partitionBy("claim_id").orderBy(F.desc("similarity"), "size", "start")
    return close.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("claim_id", "window", "similarity")


def containing(excerpts: DataFrame, sources: DataFrame) -> DataFrame:
    """Pairs of excerpts (claim_id, excerpt) and sources (document_id, text) that contain them, white space squeezed: excerpts are the terms of an
    automaton, through which each text runs once. Texts are not shuffled."""
    needles = excerpts.select("claim_id", squeeze(F.col("excerpt")).alias("term")).where("term <> ''")
    texts = sources.select(F.col("document_id").alias("chunk_id"), squeeze(F.col("text")).alias("norm"))
    return occurrences(texts, needles).select("claim_id", F.col("chunk_id").alias("document_id"))


def first_match(pages: DataFrame, pattern: str, text: str = "raw_text", by: str = "document_id") -> DataFrame:
    """(by, page_number, value, line): the first page that matches a pattern, the match and the line around it."""
    found = pages.withColumn("value", F.regexp_extract(text, f"({pattern})", 1)).where("value <> ''")
    got = found.groupBy(by).agg(F.min_by(F.struct("page_number", "value", line_around(F.col(text), pattern).alias("line")), "page_number").alias("hit"))
    return got.select(by, "hit.*")


def clean_terms(terms: Column) -> Column:
    """Folded terms of six characters or more, one of each, the longest first, then by text."""
    keys = F.filter(F.array_distinct(F.transform(terms, fold)), lambda t: F.length(t) >= 6)
    return F.transform(F.array_sort(F.transform(keys, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: x["t"])


def filled_lines(text: str = "text") -> Column:
    """A text's lines that are not empty, trimmed."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def keyed(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with `keys`, their lines as operators.automaton.supports() takes them."""
    return texts.withColumn("keys", F.transform(filled_lines(text), fold))


def cut_lines(start: str, size) -> Column:
    """The text of `size` lines from number `start` (from 0) on."""
    return F.array_join(F.slice(filled_lines(), F.col(start) + 1, size), "\n")


def window_support(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(document_id, term, size, start, window): the smallest, then first window of one to three lines with a term, inside
    words too. Lines are postings of the terms' occurrences; text is cut for the windows that are left."""
    hits = supported(keyed(texts), terms.select("term").distinct()).where("size is not null")
    out = hits.join(texts.select("document_id", "text"), "document_id")
    return out.select("document_id", "term", "size", (F.col("start") + 1).alias("start"), cut_lines("start", F.col("size")).alias("window"))


def grounded(items: DataFrame, evidence: DataFrame, hits: DataFrame) -> DataFrame:
    """Items (document_id, item) without evidence take the best hit (document_id, item, window), if there is one."""
    return items.join(evidence, ["document_id", "item"], "left_anti").join(hits, ["document_id", "item"])


def heading_support(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(document_id, term, score, pos, excerpt): the best heading line of a text for each term: numbered exact 300, numbered with at
    most six more words 250, plain 220 and 170; the excerpt is the line and the two after it, pos its number among all lines. Ties go to
    the first line."""
    hits = supported(keyed(texts), terms.select("term").distinct()).where("score is not null")
    out = hits.join(texts.select("document_id", "text"), "document_id")
    numbers = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())
    return out.select("document_id", "term", "score", F.element_at(numbers, F.col("pos") + 1).alias("pos"), cut_lines("pos", 3).alias("excerpt"))


def recovered(results: DataFrame, support: DataFrame) -> DataFrame:
    """Validation results (…, document_id, term, status) with invalid claims turned RECOVERED where a support exists."""
    found = support.select("document_id", "term", F.col("excerpt").alias("recovered_excerpt"))
    out = results.join(found, ["document_id", "term"], "left")
    hit = (F.col("status") == "INVALID") & F.col("recovered_excerpt").isNotNull()
    return out.withColumn("status", F.when(hit, "RECOVERED").otherwise(F.col("status"))).withColumn("recovered_excerpt", F.when(hit, F.col("recovered_excerpt")))


def find_support(wanted: DataFrame, chunks: DataFrame, pages: DataFrame, prefer_heading: bool) -> DataFrame:
    """(claim_id, page_number, chunk_id, term, excerpt): where each claim's terms are found in its own document.
    wanted(claim_id, document_id, preferred_page, terms), chunks(document_id, page_number, chunk_index, chunk_id, text),
    pages(document_id, page_number, raw_text). With prefer_heading the best heading of the document counts first: its score, 20 more on the
    preferred page, 2 less in the raw page than in a chunk, ties to the lower page. Else, and where there is no heading, the first window: preferred
    page, then pages in order, chunks before the raw page, smaller windows, longer terms."""
    terms = wanted.select("claim_id", "document_id", "preferred_page", F.posexplode(clean_terms(F.col("terms"))).alias("term_rank", "term"))
    unit = lambda raw, index, chunk: F.struct("page_number", F.lit(raw).alias("raw"), index.alias("chunk_index"), chunk.alias("chunk_id")).alias("unit")
    kind = chunks.schema["chunk_id"].dataType
    units = chunks.select("document_id", unit(0, F.col("chunk_index"), F.col("chunk_id")), "text").unionByName(pages.select("document_id", unit(1, F.lit(0), F.lit(None).cast(kind)), F.col("raw_text").alias("text")))
    hits = supported_within(keyed(units), terms.select("document_id", "term"))
    met = hits.join(terms, ["document_id", "term"]).withColumn("away", F.coalesce((F.col("unit.page_number") != F.col("preferred_page")), F.lit(True)).cast("int"))
    windows = F.struct("away", "unit.page_number", "unit.raw", "unit.chunk_index", "size", "start", "term_rank")
    found = F.min_by(F.struct("unit", "term", "size", "start"), F.when(F.col("size").isNotNull(), windows)).alias("hit")
    if prefer_heading:
        total = F.col("score") + F.when(F.col("away") == 0, 20).otherwise(0) - F.when(F.col("unit.raw") == 1, 2).otherwise(0)
        heads = F.struct((-total).alias("total"), "unit.page_number", "unit.raw", "unit.chunk_index", "pos", "term_rank")
        head = F.min_by(F.struct("unit", "term", F.lit(3).alias("size"), F.col("pos").alias("start")), F.when(F.col("score").isNotNull(), heads))
        found = F.coalesce(head, found).alias("hit")
    best = met.groupBy("claim_id", "document_id").agg(found).where("hit is not null").select("claim_id", "document_id", "hit.*")
    # the text is cut for the winner alone
    out = best.join(units, (best["document_id"] == units["document_id"]) & best["unit"].eqNullSafe(units["unit"]))
    return out.select("claim_id", best["unit.page_number"], best["unit.chunk_id"], "term", cut_lines("start", F.col("size")).alias("excerpt"))
