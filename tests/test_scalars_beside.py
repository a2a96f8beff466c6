"""Scalars of whole records counted beside each other, against one cell for each field."""

import json

from pyspark.sql import functions as F

from ledgerloom.operators import compare, record_cells
from ledgerloom.sources import records as R


def test_scalars_are_not_cells_before_their_portfolio(spark):
    """Records that share an id, entities of two portfolios, an entity without a record, states to review; fields are written out behind the last exchange
    of records (a row for each field was exchanged twice)."""
    text = lambda v, status="FOUND": {"status": status, "value": v}
    said = [("a", text("X"), text("claims made")), ("a", text("Y"), None), ("b", text("x "), text("Base de Reclamações")), ("c", text(None, "CONFLICTING"), text(None)), ("d", None, text("other"))]
    rows = [(json.dumps({"policy_id": p, "identification": {"insurer": i}, "contractual_terms": {"coverage_trigger": t}}),) for p, i, t in said]
    df = spark.createDataFrame(rows, "j string").select(F.from_json("j", R.RECORD).alias("r")).select("r.*")
    members = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "a"), ("q", "c"), ("q", "gone"), ("r", "d"), ("s", "gone")], "portfolio_id string, entity_id string").withColumn("position", F.lit(0))
    want = compare.comparison_rows(record_cells.scalar_cells(df).join(members.drop("position"), "entity_id"), members, repeats_need_review=False)
    got = record_cells.scalar_rows(df, members, 100)
    key = lambda rows: sorted(tuple(r[c] for c in sorted(want.columns)) for r in rows.collect())
    assert key(got) == key(want) and got.count() == 45
    plan = got._jdf.queryExecution().executedPlan().toString().split("\n")
    assert [i for i, x in enumerate(plan) if "Generate" in x] < [i for i, x in enumerate(plan) if "Exchange" in x and "__at" in x]


def test_what_records_lack_is_filled_in(spark):
    df = spark.sql("SELECT 'a' policy_id, named_struct('insurer', named_struct('value', 'v')) identification, array(named_struct('original_name', 'n', 'category', 'c')) coverages")
    got = R.whole(df)
    assert got.schema.simpleString() == R.RECORD.simpleString()
    (one,) = got.collect()
    assert one.identification.insurer.value == "v" and one.identification.insured is None and one.definitions is None
    assert [(x.original_name, x.category, x.limits) for x in one.coverages] == [("n", "c", None)]
