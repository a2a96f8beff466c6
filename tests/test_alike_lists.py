"""Rows that score alike: one list where they are, compared once; names of a large dictionary without the driver."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import automaton, compare, retrieve

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_large_dictionary_meets_texts_by_an_equi_join(spark):
    """Against plain Python: terms shorter than the letters met first, whole texts, overlaps, texts without letters; no term reaches the driver."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    texts = [(k, word(rng.randint(0, 30))) for k in range(40)] + [(90, None), (91, ""), (92, "abba"), (93, "é ab")]
    terms = sorted({word(rng.randint(1, 9)) for _ in range(150)} | {"abba", "é", "zz"}) + ["", None, "abba"]
    t = spark.createDataFrame(texts, "chunk_id int, norm string")
    d = spark.createDataFrame([(x,) for x in terms], "term string")
    want = sorted((k, x) for k, text in texts for x in {x for x in terms if x} if x in (text or ""))
    assert rows(automaton.contained(t, d, letters=1)) == rows(automaton.contained(t, d)) == want
    assert "MapInArrow" not in automaton.contained(t, d, letters=1)._jdf.queryExecution().executedPlan().toString()


def test_questions_are_copied_not_lists(spark):
    """Lists of rows are as many as the rows: none is copied for the parts into which a portfolio is dealt."""
    r = spark.range(50).select(F.lit(1).alias("portfolio_id"), F.col("id").alias("row_id"), F.col("id").cast("string").alias("field_id"), F.lit("l").alias("label"), F.lit("EQUAL").alias("status"), F.lit("ring").alias("search_text"))
    q = spark.createDataFrame([(1, 1, "ring 7")], "portfolio_id int, question_id int, question string")
    got = retrieve.boosted(q, r)
    assert got.count() == 50
    copied = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode(" in x]
    assert copied and not any("ids#" in x and "explode(ids" not in x for x in copied)


def test_rows_are_compared_once(spark, monkeypatch):
    """Key differences read the compared rows, not the cells again."""
    from ledgerloom.plans import question_queries

    seen, inner = [], compare.key_differences
    monkeypatch.setattr(compare, "key_differences", lambda df, *a, **b: seen.append(df.inputFiles()) or inner(df, *a, **b))
    question_queries.rows_of(spark, SF)
    assert seen[0] and all("/compared-" in f for f in seen[0])
