"""op9 with a benchmark that is not broadcast: the same rows, and no text beside the shingles that move."""

import random
import re

from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate


def tables(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    items = [(i, " ".join(word() for _ in range(rng.randint(6, 40)))) for i in range(30)]
    docs = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60)))] + [rng.choice(items)[1] for _ in range(rng.randint(0, 2))]
        rng.shuffle(parts)
        docs.append((i % 50, " ".join(parts)))
    docs += docs[:5] + [(None, items[0][1]), (99, None), (98, "")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_rows_are_the_same(spark):
    docs, items = tables(spark)
    a, b = (sorted(tuple(r) for r in decontaminate.contaminated(docs, items, most_broadcast=n).collect()) for n in (500_000, 0))
    assert a == b and len(a) > 20


def test_texts_do_not_travel_with_their_shingles(spark):
    docs, items = tables(spark)
    text = docs.select("doc_id", F.xxhash64("text").alias("row"), decontaminate.words("text").alias("w"))
    sizes = items.select(F.lit(8).alias("m"), F.explode(decontaminate.shingle_hashes(decontaminate.words("text"))).alias("key")).groupBy("key").agg(F.collect_set("m").alias("ms"))
    plan = decontaminate.touched(text, sizes, ["doc_id", "row", "m", "start"], False)._jdf.queryExecution().optimizedPlan().toString()
    join = next(i for i, line in enumerate(plan.split("\n")) if re.search(r"Join Inner, \(key#", line))
    below = plan.split("\n")[join + 1]
    assert "Project [doc_id" in below and not re.search(r"[\[ ]w#\d+[,\]]", below)  # only the number of words is left of them
