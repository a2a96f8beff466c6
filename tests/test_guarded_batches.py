"""Ids guarded over runs: a batch of many ids, orders and contents of any type."""

import time

from pyspark.sql import functions as F

from ledgerloom.streaming import incremental


def test_many_ids_of_a_batch(spark, tmp_path):
    """A call for each id took minutes; the second run replays no id of the first."""
    base = f"file://{tmp_path}"
    df = spark.range(600_000).select((F.col("id") % 300_000).alias("k"), F.col("id").alias("n"))
    began = time.time()
    for rows in (df, df.withColumn("k", F.col("k") + 299_000)):
        rows.write.mode("append").parquet(f"{base}/in")
        incremental.run_guarded(spark, f"{base}/in", df.schema, "k", "n", f"{base}/out", f"{base}/checkpoint")
    assert time.time() - began < 40
    got = spark.read.parquet(f"{base}/out/taken").groupBy("batch").agg(F.count("k"), F.min("k"), F.max("n")).orderBy("batch").collect()
    assert [tuple(r) for r in got] == [(0, 300_000, 0, 299_999), (1, 299_000, 300_000, 299_999)]
    assert spark.read.parquet(f"{base}/out/refused").count() == 2 * 600_000 - 599_000


def test_orders_are_values(spark, tmp_path):
    """Decimals sorted by their digits, and times lost what is below a thousandth."""
    base = f"file://{tmp_path}"
    df = spark.sql("SELECT * FROM VALUES ('a', 10.5BD, TIMESTAMP '2024-01-01 00:00:00.123456'), ('a', 9.5BD, TIMESTAMP '2024-01-01 00:00:00.654321'), ('b', NULL, NULL), ('b', -1BD, NULL) t(id, n, at)")
    df.coalesce(1).write.parquet(f"{base}/in")
    incremental.run_guarded(spark, f"{base}/in", df.schema, "id", "n", f"{base}/out", f"{base}/checkpoint")
    read = lambda name: sorted((r["id"], str(r["n"]), r["at"] and r["at"].microsecond) for r in spark.read.parquet(f"{base}/out/{name}").collect())
    assert read("taken") == [("a", "9.5", 654321), ("b", "None", None)]
    assert read("refused") == [("a", "10.5", 123456), ("b", "-1.0", None)]
