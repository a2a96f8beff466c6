"""Disk of the Jaccard join: shuffles go with the tables they made, texts that meet nobody are not exchanged."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from ledgerloom.llm import common, jaccard


def shuffles(spark):
    return set(Path(spark.sparkContext.getConf().get("spark.local.dir")).rglob("shuffle_*.data"))


def test_shuffles_go_with_discarded_tables(spark):
    """Those of the step at hand may stay; steps before it leave nothing."""
    before, seen = shuffles(spark), []
    for _ in range(3):
        made = common.written(spark.range(50_000).repartition(4, "id").groupBy(F.col("id") % 1000).count(), "made")
        seen.append(shuffles(spark) - before - set().union(*seen))
        common.discard(made)
        time.sleep(1)
    assert all(seen) and not (seen[0] | seen[1]) & shuffles(spark)


def test_texts_of_no_group_stay(spark):
    """Members come with all their rows, copies too; nearly no others. With one word of bits there are more, and none is lost."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 19_000).cast("string")).alias("text")).withColumn("row", F.xxhash64("text"))
    members = rows.where("doc_id % 100 = 3").select("doc_id", "row")
    want = {x.doc_id for x in rows.join(members.select("row").distinct(), "row", "left_semi").collect()}
    got = [x.doc_id for x in jaccard.among(rows, members).collect()]
    assert want <= set(got) and len(got) == len(set(got)) < 1500
    few = jaccard.among(rows, members, most=1)
    assert want <= {x.doc_id for x in few.collect()} and few.columns == ["doc_id", "text", "row"]
    assert jaccard.among(rows, members.limit(0)).count() == 0
