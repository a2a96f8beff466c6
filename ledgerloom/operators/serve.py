"""Serving projections of records and comparison rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.operators.compare import ROW


def overview(records: DataFrame, collections: list[str]) -> DataFrame:
    """Sizes of a record's collections."""
    return records.select("policy_id", *(F.coalesce(F.size(c), F.lit(0)).alias(f"n_{c}") for c in collections))


def sizes(parts: DataFrame, by: str, counts: dict[str, Column]) -> DataFrame:
    """Sizes of collections that are still rows: they are counted, not collected."""
    return parts.groupBy(by).agg(*(v.alias(k) for k, v in counts.items()))


def stages(flags: dict[str, Column]) -> Column:
    """Array of (stage, done) in order."""
    return F.array(*(F.struct(F.lit(k).alias("stage"), v.alias("done")) for k, v in flags.items()))


def filtered(rows: DataFrame, statuses: list[str], sections: list[str]) -> DataFrame:
    return rows.where(F.col("status").isin(statuses) & F.col("section").isin(sections))


def pages(evidence: Column) -> Column:
    """Distinct sorted pages of an evidence array as text."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(evidence, lambda e: e["page"]))), ",")


def with_evidence(rows: DataFrame, values: str = "values") -> DataFrame:
    return rows.where(F.exists(values, lambda v: F.size(v["evidence"]) > 0))


def sections_in_order(rows: DataFrame, pos: str) -> DataFrame:
    return rows.groupBy("section").agg(F.min(pos).alias("first_pos"))


def family_presence(rows: DataFrame, concepts: DataFrame, families: DataFrame) -> DataFrame:
    """Rows with the presence of their family where it differs from their own."""
    of = concepts.select("concept_id", "section", "field_id")
    named = families.select("portfolio_id", "concept_id", F.concat_ws("/", "present_count", "policy_count").alias("family"))
    out = rows.join(of, ["section", "field_id"], "left").join(named, ["portfolio_id", "concept_id"], "left")
    return out.withColumn("family_presence", F.when(F.col("family") != F.col("presence"), F.col("family"))).select(*ROW, "status", "presence", "family_presence")


def value_text(kind: Column, start: Column, end: Column, raw: Column, normalized: Column, number: Column) -> Column:
    """Display text of a value, the first form that exists: period, raw text, normalized text, number."""
    day = lambda d: F.date_format(d, "dd/MM/yyyy")
    period = F.when((kind == "PERIOD") & start.isNotNull(), F.concat(day(start), F.lit(" - "), day(end)))
    return F.coalesce(period, raw, normalized, number.cast("string"), F.lit("-"))
