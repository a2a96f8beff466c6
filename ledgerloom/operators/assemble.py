"""Flat extracted facts to one nested record per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def last_by(facts: DataFrame, by: list[str], pos: str) -> DataFrame:
    """The last fact of each key, as dictionaries filled in order keep it."""
    rest = [c for c in facts.columns if c not in by]
    return facts.groupBy(*by).agg(F.max_by(F.struct(*rest), pos).alias("fact")).select(*by, "fact.*")


def first_by(facts: DataFrame, by: list[str], pos: str) -> DataFrame:
    rest = [c for c in facts.columns if c not in by]
    return facts.groupBy(*by).agg(F.min_by(F.struct(*rest), pos).alias("fact")).select(*by, "fact.*")


def field(status: Column, normalized: Column, raw: Column, fallback: Column) -> Column:
    """STRUCT<status, value, confidence-like note>: FOUND needs a value, AMBIGUOUS does not survive, a fallback fills in."""
    value = F.coalesce(normalized, raw, fallback)
    found = F.when((status == "FOUND") & value.isNotNull(), "FOUND").when(fallback.isNotNull(), "FOUND").otherwise("NOT_FOUND")
    note = F.when(status == "AMBIGUOUS", "was ambiguous")
    return F.struct(found.alias("status"), F.when(found == "FOUND", value).alias("value"), note.alias("note"))


def nested(facts: DataFrame, by: str, pos: str, into: str) -> DataFrame:
    """One array of structs for each document, in the order of the facts."""
    rest = [c for c in facts.columns if c not in (by, pos)]
    return facts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(pos, *rest))).alias(into))


def period(start: Column, end: Column) -> Column:
    """Start and end dates, FOUND only if both parse."""
    both = start.isNotNull() & end.isNotNull()
    return F.struct(F.when(both, "FOUND").otherwise("NOT_FOUND").alias("status"), F.when(both, start).alias("start"), F.when(both, end).alias("end"))


def merged(parts: list[DataFrame]) -> DataFrame:
    """Outputs of split stages as one."""
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one)
    return out


def method(native: Column, second: Column) -> Column:
    return F.when((native > 0) & (second > 0), "HYBRID").when(second > 0, "SECOND_READING").otherwise("NATIVE")


def violations(facts: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, key) of every row that breaks a rule; one pass."""
    broken = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items())))
    return facts.select(key, F.explode(broken).alias("rule"))


def state_rules(status: Column, value: Column, candidates: Column, confidence: Column) -> dict[str, Column]:
    return {
        "found_without_value": (status == "FOUND") & value.isNull(),
        "value_without_found": status.isin("NOT_FOUND", "NOT_APPLICABLE") & value.isNotNull(),
        "review_without_candidates": status.isin("AMBIGUOUS", "CONFLICTING") & (F.coalesce(candidates, F.lit(0)) == 0),
        "confidence_range": (confidence < 0) | (confidence > 1),
    }
