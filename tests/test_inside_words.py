"""Keywords and phrases that occur only inside longer words, against plain substring search."""

from ledgerloom.operators import evidence, retrieve, scoring

TEXTS = ["franquias e franquia", "sobrefranquias", "aide lasso", "ide laços", "de  LA", "del a", "nada", "", "claims claims claims claims claims claims"]
TERMS = ["franquia", "de la", "claim", "franquia e", ""]


def folded_texts(spark):
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)], "chunk_id int, text string")
    return scoring.folded(chunks), ["franquias e franquia", "sobrefranquias", "aide lasso", "ide lacos", "de la", "del a", "nada", "", TEXTS[-1]]


def test_keywords_count_inside_words(spark):
    chunks, norms = folded_texts(spark)
    terms = spark.createDataFrame([(t, t) for t in TERMS] + [("claim", "claim")], "profile string, term string")
    got = {(r["chunk_id"], r["profile"]): r["score"] for r in scoring.keyword_scores(chunks, terms).collect()}
    each = lambda i, t: 3 + min(norms[i].count(t) - 1, 4)
    assert got == {(i, t): each(i, t) * (2 if t == "claim" else 1) for i, x in enumerate(norms) for t in TERMS if t and t in x}
    got = {(r["chunk_id"], r["item"]) for r in scoring.phrase_scores(chunks, terms.withColumnRenamed("profile", "item")).collect()}
    assert got == {(i, t) for i, x in enumerate(norms) for t in TERMS if t and t in x} and (1, "franquia") in got


def test_windows_and_questions_match_inside_words(spark):
    texts = spark.createDataFrame([(1, "nada\nas franquias\nfim"), (2, "aide\nlasso"), (3, "x")], "document_id int, text string")
    terms = spark.createDataFrame([("franquia",), ("de la",)], "term string")
    got = {(r["document_id"], r["term"], r["size"], r["window"]) for r in evidence.window_support(texts, terms).collect()}
    assert got == {(1, "franquia", 1, "as franquias"), (2, "de la", 2, "aide\nlasso")}
    asked = spark.createDataFrame([(1, "Quais franquias?"), (2, "subclaims de franquias"), (3, "nada")], "question_id int, question string")
    phrases = spark.createDataFrame([("c", "claim"), ("f", "franquia")], "item string, term string")
    assert {(r["question_id"], r["item"]) for r in retrieve.matched_item(asked, phrases).collect()} == {(1, "f"), (2, "f")}
