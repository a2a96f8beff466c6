"""Rows that score alike meet a question as one, and every pair still comes out."""

from pyspark.sql import functions as F

from ledgerloom.operators import retrieve


def test_alike_rows_meet_questions_in_packs(spark, monkeypatch):
    """Against all pairs scored one by one; null labels, named fields (also as parts of others), a side, packs smaller than a class."""
    monkeypatch.setattr(retrieve, "PACK", 7)
    n = F.col("id")
    r = spark.range(400).select((n % 2).alias("portfolio_id"), n.alias("row_id"), F.when(n == 40, "side_a").otherwise(F.concat(F.lit("part-"), n.cast("string"))).alias("field_id"), F.when(n % 5 != 0, F.lit("red wheel")).alias("label"), F.when(n % 3 == 0, "EQUAL").otherwise("ONLY_IN_SOME").alias("status"), F.when(n % 4 == 0, "blue wheel").otherwise("ring").alias("search_text"))
    asked = ["red wheel part-250", "apenas algumas?", "side a", "nothing", "todas: ring part-7, part-31", None]
    q = spark.createDataFrame([(p, 10 * p + i, t) for p in (0, 1) for i, t in enumerate(asked)], "portfolio_id long, question_id long, question string")
    pairs = q.join(r, "portfolio_id").select("question_id", "row_id")
    rows = lambda df: sorted(map(tuple, df.collect()))
    got = retrieve.boosted(q, r)
    assert rows(got) == rows(retrieve.boosted(q, r, pairs=pairs)) and got.count() > 700
    assert "explode(ids" in got._jdf.queryExecution().optimizedPlan().toString()
