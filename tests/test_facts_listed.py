"""Facts of a record are gathered by kind."""

from ledgerloom.operators import assembly


def test_fields_have_no_aggregate_of_their_own(spark):
    """Seventeen fields had one each; facts without a place do not count, of money without an item the first premium does."""
    facts = spark.createDataFrame([("d", "insurer", 1, "FOUND", "A"), ("d", "insurer", 3, "FOUND", "C"), ("d", "insurer", 2, "FOUND", "B"), ("d", "insured", None, "FOUND", "N"), ("d", "currency", 3, "FOUND", "BRL")], "document_id string, field_id string, pos int, status string, raw string")
    money = spark.createDataFrame([("d", "premium", None, 9.0), ("d", "premium", 4, 4.0), ("d", "premium", 2, 2.0), ("d", "deductible", 1, 1.0), ("d", "aggregate_limit", 0, 8.0), ("d", "maximum_guarantee_limit", 5, 5.0), ("d", "other", 0, 7.0)], "document_id string, field_id string, pos int, amount double")
    got = assembly.assembled(assembly.put_together(assembly.tagged("fact", facts), assembly.tagged("money", money)))
    (one,) = got.collect()
    assert one.identification.insurer.value == "C" and one.identification.insured.status == "NOT_FOUND" and one.contractual_terms.currency.value == "BRL"
    assert float(one.contractual_terms.premium.value) == 2.0
    assert [float(x.amount) for x in one.policy_limits] == [8.0, 5.0] and [x.canonical_id for x in one.policy_deductibles] == ["deductible"]
    assert "max_by" not in got._jdf.queryExecution().optimizedPlan().toString()
