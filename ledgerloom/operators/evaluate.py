"""Scores of extracted values against a ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def set_metrics(expected: DataFrame, extracted: DataFrame, by: str, item: str) -> DataFrame:
    """Precision, recall and F1 of distinct items for each group; an empty side counts as its convention says."""
    side = lambda df, e, x: df.select(by, item).where(F.col(item).isNotNull()).withColumn("__e", F.lit(e)).withColumn("__x", F.lit(x))
    items = side(expected, 1, 0).unionByName(side(extracted, 0, 1)).groupBy(by, item).agg(F.max("__e").alias("__e"), F.max("__x").alias("__x"))
    got = items.groupBy(by).agg(F.sum(F.col("__e") * F.col("__x")).alias("tp"), F.sum("__e").alias("expected"), F.sum("__x").alias("extracted"))
    precision = F.when(F.col("extracted") == 0, F.when(F.col("expected") == 0, 1.0).otherwise(0.0)).otherwise(F.col("tp") / F.col("extracted"))
    recall = F.when(F.col("expected") == 0, 1.0).otherwise(F.col("tp") / F.col("expected"))
    got = got.withColumn("precision", precision).withColumn("recall", recall)
    both = F.col("precision") + F.col("recall")
    return got.withColumn("f1", F.when(both == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / both))


def macro_f1(metrics: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """Mean F1 over fixed groups; a group without rows on either side counts as 1."""
    return groups.join(metrics, by, "left").agg(F.avg(F.coalesce("f1", F.lit(1.0))).alias("macro_f1"), F.count(F.lit(1)).alias("groups"))


def accuracy(pairs: DataFrame, by: str, expected: str, actual: str) -> DataFrame:
    """Share of equal values; null equals null."""
    hit = F.col(expected).eqNullSafe(F.col(actual))
    return pairs.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("correct"), F.avg(hit.cast("double")).alias("accuracy"))


def overlap(expected: DataFrame, extracted: DataFrame) -> DataFrame:
    """One row: sizes of the distinct sets, of their intersection and of both differences."""
    sides = {"expected": expected.distinct(), "extracted": extracted.distinct(), "hits": expected.intersect(extracted), "missing": expected.subtract(extracted), "extra": extracted.subtract(expected)}
    out = None
    for name, df in sides.items():
        one = df.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.join(one)  # single rows
    return out.withColumn("accuracy", F.when(F.col("expected") == 0, 1.0).otherwise(F.col("hits") / F.col("expected")))


def gold_facts(gold: DataFrame, fields: DataFrame) -> DataFrame:
    """gold(source_id, fact_id, kind, path, expected, pages) against fields(source_id, path, status, value, pages): passed
    and page_ok. Kinds: field_contains, field_status, canonical_present."""
    got = gold.join(fields.select("source_id", "path", "status", "value", F.col("pages").alias("__pages")), ["source_id", "path"], "left")
    contains = (F.col("status") == "FOUND") & F.contains(F.lower("value"), F.lower("expected"))
    passed = F.when(F.col("kind") == "field_contains", contains).when(F.col("kind") == "field_status", F.col("status") == F.col("expected")).when(F.col("kind") == "canonical_present", F.col("value") == F.col("expected"))
    page = F.when(F.col("pages").isNotNull(), F.coalesce(F.arrays_overlap("pages", "__pages"), F.lit(False)))
    return got.withColumn("passed", F.coalesce(passed, F.lit(False))).withColumn("page_ok", page)


def gold_summary(facts: DataFrame) -> DataFrame:
    got = facts.groupBy("source_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count("page_ok").alias("pages"), F.count_if("page_ok").alias("pages_ok"))
    return got.withColumn("fact_accuracy", F.col("passed") / F.col("total")).withColumn("page_accuracy", F.when(F.col("pages") == 0, 1.0).otherwise(F.col("pages_ok") / F.col("pages")))


def unknown_kinds(gold: DataFrame) -> DataFrame:
    return gold.where(~F.col("kind").isin("field_contains", "field_status", "canonical_present"))
