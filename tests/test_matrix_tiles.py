"""The matrix of compare_matrix is made, cell by cell, and counted where it is made."""

import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.operators import compare


def test_tiles_are_filled_and_counted():
    """Two parts in several tiles and batches: 5 fields x 3 members and 2 x 2; fields without a cell of a member count as missing."""
    rows = [(1, 0, 1, 1, 2, 3), (1, 0, 1, 3, 1, 3), (1, 0, 2, None, 2, 3), (1, 0, 3, 1, 2, 3), (1, 0, 4, 2, 2, 3), (1, 0, 5, 1, 2, 3), (2, 0, 1, 1, 2, 2), (2, 0, 2, 2, 0, 2)]
    schema = pa.schema([("portfolio_id", pa.int32()), ("part", pa.int64()), ("field", pa.int32()), ("member", pa.int64()), ("state", pa.int32()), ("members", pa.int64())])
    for size in (1, 3, 8):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + size]), schema)], schema=schema) for a in range(0, len(rows), size)]
        for tile in (1, 6, 100):
            got = [tuple(r.values()) for b in compare.counted_tiles(batches, tile) for r in b.to_pylist()]
            assert got == [(1, 1, 5, 3), (1, 2, 5, 1), (1, 3, 5, 0), (2, 1, 2, 1), (2, 2, 2, 0)]


def test_matrix_is_made_and_counted(spark):
    """As the rows of matrix(), with nulls, strangers, members listed twice and fields that only strangers state; the plan makes the cells."""
    states = F.element_at(F.array(*map(F.lit, ["FOUND", "AMBIGUOUS", "NOT_FOUND", "FOUND"])), (F.col("id") % 4 + 1).cast("int"))
    cells = spark.range(3000).select((F.col("id") % 3).alias("portfolio_id"), (F.col("id") * 7 % 41).alias("entity_id"), F.when(F.col("id") % 50 > 0, "s").alias("section"), F.concat(F.lit("f"), (F.col("id") % 113).cast("string")).alias("field_id"), states.alias("state"), F.lit("k").alias("key"), F.lit("l").alias("label"))
    cells = cells.union(cells.limit(5).withColumn("portfolio_id", F.lit(None).cast("long")))
    members = spark.range(36).select((F.col("id") % 4).alias("portfolio_id"), F.col("id").alias("entity_id"), F.col("id").alias("position"))
    members = members.union(members.where("entity_id in (4, 5)"))
    got = compare.matrix_counts(cells, members)
    found = F.count_if(F.col("state") == "FOUND")
    want = compare.matrix(cells, members).groupBy("portfolio_id", "entity_id").agg(F.count(F.lit(1)), found, F.count(F.lit(1)) - found)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
