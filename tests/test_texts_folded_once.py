"""Texts that several automata look at are made once; texts of routes are dealt before they are folded."""

import pyarrow as pa

from ledgerloom.operators.automaton import occurrences
from ledgerloom.plans import routing_queries


def test_texts_are_made_once_for_all_automata(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f"word{i} and word{i + 1}" for i in batch.column(0).to_pylist()])], ["chunk_id", "norm"])

    texts = spark.range(300).mapInArrow(count, "chunk_id long, norm string")
    terms = spark.createDataFrame([(f"word{i}",) for i in range(200, 300)], "term string")
    assert occurrences(texts, terms, letters=100).count() == 200
    assert made.value == 300


def test_chunks_are_dealt_before_they_are_folded(spark):
    plan = routing_queries.chunks_of(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [chunk_id" in plan
