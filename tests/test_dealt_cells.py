"""Comparison cells are dealt to tasks whose number grows with the table."""

from pyspark.sql import functions as F

from ledgerloom.operators import compare


def cells(spark, n):
    """Cells of constant section and label, 40 fields; a field's members repeat, differ or agree."""
    i = F.col("id")
    return spark.range(n).select((i % 3).alias("portfolio_id"), (i % 500).alias("entity_id"), F.lit("s").alias("section"), (i % 40).alias("field_id"), F.lit("l").alias("label"), F.when(i % 7 == 0, "AMBIGUOUS").otherwise("FOUND").alias("state"), F.when(i % 40 < 20, F.lit("k")).otherwise(F.concat(F.lit("k"), (i % 9).cast("string"))).alias("key"))


def test_number_of_tasks_grows_with_cells(spark, monkeypatch):
    members = spark.range(1500).select((F.col("id") % 3).alias("portfolio_id"), (F.col("id") % 500).alias("entity_id"), F.col("id").alias("position"))
    few = sorted(map(tuple, compare.comparison_rows(cells(spark, 20000), members).collect()))
    assert len(few) == 120
    monkeypatch.setattr(compare, "TASK", 1000)
    got = compare.comparison_rows(cells(spark, 20000), members)
    assert sorted(map(tuple, got.collect())) == few
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2 and ", 20), REPARTITION_BY_NUM" in plan  # 20 tasks for 20,000 cells of 1,000 each
    assert plan.count("Exchange hashpartitioning") <= plan.count("REPARTITION_BY_NUM") + 3  # no aggregation of cells deals them anew


def test_status_of_keys(spark):
    """Null keys are not counted, one key is EQUAL, two are DIFFERENT."""
    rows = [("a", "x", "k"), ("b", "x", "k"), ("a", "y", "k"), ("b", "y", "j"), ("a", "z", None), ("b", "z", None), ("a", "w", None), ("b", "w", "k")]
    c = spark.createDataFrame([(1, e, "s", f, "l", "FOUND", k) for e, f, k in rows], "portfolio_id int, entity_id string, section string, field_id string, label string, state string, key string")
    members = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "portfolio_id int, entity_id string, position int")
    assert {r.field_id: r.status for r in compare.comparison_rows(c, members).collect()} == {"x": "EQUAL", "y": "DIFFERENT", "z": "DIFFERENT", "w": "EQUAL"}
