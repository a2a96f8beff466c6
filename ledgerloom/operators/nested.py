"""Nested parts of a record: money by kind, items with limits of their own, keys with scopes, what items are compared by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.text import decimal_key, fold, snake_of
from ledgerloom.operators.taxonomy import resolved

#: fixed values: which money facts a record keeps, and its sections of items
LIMITS, DEDUCTIBLES = ["maximum_guarantee_limit", "aggregate_limit"], ["deductible"]
SECTIONS = ["coverages", "extensions", "exclusions"]
#: fixed values: words of the three contractual fields, the first rule that holds decides
WORLDWIDE = ["mundial", "mundo inteiro", "qualquer lugar do mundo", "qualquer parte do mundo", "worldwide", "world wide", "anywhere in the world"]
HOME_SCOPE = ["brasil", "brazil", "territorio nacional"]
HOME_LAW = ["brasil", "brazil", "legislacao brasileira", "jurisdicao brasileira"]
TRIGGERS = [
    (["reclamacoes com notificacao", "reclamacao com notificacao", "claims made with notification", "claims made notification"], "CLAIMS_MADE_WITH_NOTIFICATION"),
    (["primeira manifestacao", "first manifestation", "first discovery"], "CLAIMS_MADE_FIRST_MANIFESTATION"),
    (["base de reclamacoes", "claims made"], "CLAIMS_MADE"),
    (["base de ocorrencia"], "OCCURRENCE"),
]


def any_of(key: Column, words: list[str]) -> Column:
    return F.rlike(key, F.lit("|".join(words)))  # folded words hold letters, digits and blanks only


def contractual_code(path: Column, value: Column) -> Column:
    """Code of a contractual field's text by the field's rules; other fields, null and blank texts have none."""
    def of(key):
        scope = F.when(any_of(key, WORLDWIDE), "WORLDWIDE").when(key.isin(HOME_SCOPE), "BRAZIL")
        law = F.when(any_of(key, HOME_LAW), "BR")
        trigger = F.when(key == "occurrence", "OCCURRENCE")
        for words, code in reversed(TRIGGERS):
            trigger = F.when(any_of(key, words), code).otherwise(trigger)
        by_path = {"contractual_terms.geographic_scope": scope, "contractual_terms.jurisdiction": law, "contractual_terms.coverage_trigger": trigger}
        out = F.lit(None).cast("string")
        for name, code in by_path.items():
            out = F.when(path == name, F.coalesce(code, snake_of(key))).otherwise(out)
        return F.when(key != "", out)

    return F.element_at(F.transform(F.array(fold(value)), of), 1)  # folded once, not once a rule


def policy_id(hint: Column, number: Column, document: Column) -> Column:
    """The given id, else the policy's number, else the document's id; blanks count as missing."""
    given = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(given(hint), given(number), document)


def stable(**fields: Column) -> Column:
    """Text that is equal exactly for equal values: fields by name, nulls written out."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in sorted(fields.items()))), {"ignoreNullFields": "false"})


def value_key(kind: Column, number: Column, currency: Column, unit: Column, text: Column) -> Column:
    """What a value is compared by; its raw text is not."""
    return stable(kind=kind, number=decimal_key(number), currency=F.upper(currency), unit=fold(unit), text=fold(text))


def candidate_values(status: Column, candidates: Column) -> Column:
    """Values of a field's candidates where a person has to decide, else null."""
    return F.when(status.isin("AMBIGUOUS", "CONFLICTING"), F.transform(candidates, lambda c: c["value"]))


def scope_ids(facts: DataFrame, key: list[str], scopes: str, items: DataFrame, alias_norms: DataFrame, category: str) -> DataFrame:
    """(key, scope_ids): canonical ids of each row's array of scope names, unknown ones as unmapped:<folded text>; distinct and sorted."""
    names = facts.select(*key, F.explode(scopes).alias("name")).withColumn("category", F.lit(category)).withColumn("given_id", F.col("name"))
    one = F.coalesce("canonical_id", F.concat(F.lit("unmapped:"), F.when(fold(F.col("name")) == "", "scope").otherwise(fold(F.col("name")))))
    return resolved(names, items, alias_norms).groupBy(*key).agg(F.array_sort(F.collect_set(one)).alias("scope_ids"))


def scoped_key(base: Column, scopes: Column) -> Column:
    return F.when(F.size(scopes) > 0, F.concat(base, F.lit("::scope="), F.array_join(scopes, "+"))).otherwise(base)


def money(facts: DataFrame, by: str, pos: str, fields: list[str]) -> DataFrame:
    """(by, policy_limits, policy_deductibles): arrays of the money facts' structs (canonical_id and `fields`) in the facts' order; other
    kinds of money are left out, and a fact without a canonical id takes its field's name."""
    row = F.struct(pos, F.coalesce("canonical_id", "field_id").alias("canonical_id"), *fields)
    side = lambda names: F.array_sort(F.collect_list(F.when(F.col("field_id").isin(names), row)))
    return facts.where(F.col("field_id").isin(LIMITS + DEDUCTIBLES)).groupBy(by).agg(side(LIMITS).alias("policy_limits"), side(DEDUCTIBLES).alias("policy_deductibles"))


def item_sections(items: DataFrame, financials: DataFrame | None, by: str, pos: str) -> DataFrame:
    """(by, coverages, extensions, exclusions) of items (by, pos, section, canonical_id, normalization_confidence,
    given_confidence, name, category) and the financials inside them (by, pos, inner_pos, canonical_id, field_id, amount):
    arrays in the facts' order. A given confidence counts only with an id; a coverage without a category is a main
    one; limits apply to the item that holds them. Without financials, items bring theirs as an array `limits` of (inner_pos, canonical_id,
    amount), null where there are none, and need no join."""
    known, rows = F.col("canonical_id").isNotNull(), items
    if financials is not None:
        limit = F.struct("inner_pos", F.coalesce("canonical_id", "field_id").alias("canonical_id"), "amount")
        rows = items.join(financials.groupBy(by, pos).agg(F.array_sort(F.collect_list(limit)).alias("limits")), [by, pos], "left")
    rows = rows.withColumn("normalization_confidence", F.greatest("normalization_confidence", F.when(known, F.col("given_confidence")).otherwise(0.0)))
    rows = rows.withColumn("category", F.when(F.col("section") == "coverages", F.coalesce("category", F.lit("MAIN_COVERAGE"))))
    applies = F.when(known, F.array("canonical_id")).otherwise(F.array().cast("array<string>"))
    held = F.transform(F.coalesce("limits", F.array().cast(rows.schema["limits"].dataType)), lambda x: F.struct(x["canonical_id"].alias("canonical_id"), x["amount"].alias("amount"), applies.alias("applies_to")))
    row = F.struct(pos, "canonical_id", "name", "normalization_confidence", "category", held.alias("limits"))
    return rows.groupBy(by).agg(*(F.array_sort(F.collect_list(F.when(F.col("section") == s, row))).alias(s) for s in SECTIONS))


def texts_key(texts: Column) -> Column:
    """Folded texts, sorted."""
    return F.array_sort(F.transform(F.coalesce(texts, F.array().cast("array<string>")), fold))


def items_of_sections(sections: DataFrame, by: str, names: list[str] = SECTIONS) -> DataFrame:
    """(by, section, x) of item_sections(): the items of all named sections as rows, by one explode."""
    one = lambda s: F.transform(s, lambda x: F.struct(F.lit(s).alias("section"), x.alias("x")))
    return sections.select(by, F.explode(F.concat(*map(one, names))).alias("item")).select(by, "item.section", "item.x")


def item_payload(section: Column, category: Column, conditions: Column, limits: Column, exceptions: Column, applies_to: Column, text: Column) -> Column:
    """What items of a section are compared by: their matter, not their names, descriptions, confidences or evidence.
    limits: array of strings, one for each nested limit."""
    inner = F.array_sort(F.coalesce(limits, F.array().cast("array<string>")))
    return (
        F.when(section == "coverages", stable(category=fold(category), conditions=texts_key(conditions), limits=inner))
        .when(section == "extensions", stable(conditions=texts_key(conditions), limits=inner))
        .when(section == "exclusions", stable(exceptions=texts_key(exceptions), applies_to=texts_key(applies_to)))
        .when(section == "definitions", stable(text=fold(text)))
        .when(section == "clauses", stable(category=fold(category), conditions=texts_key(conditions), text=fold(text)))
    )


def by_path(records: DataFrame, key: str, paths: list[str]) -> DataFrame:
    """(key, path, value) of dotted paths into nested structs; a path that leads through a null is null."""
    return records.select(key, *(F.col(p).cast("string").alias(p) for p in paths)).unpivot(key, [f"`{p}`" for p in paths], "path", "value")


def sublimits(items: DataFrame) -> DataFrame:
    """(policy_id, kind, parent, value) of the nested limits of items (policy_id, kind, canonical_id, limits) that are
    sublimits: the amount, or where there is none its folded text."""
    inner = items.where(F.col("kind").isin("coverage", "extension")).select("policy_id", "kind", F.coalesce("canonical_id", F.lit("")).alias("parent"), F.explode("limits").alias("l"))
    value = F.when(F.col("l.amount").isNotNull(), decimal_key(F.col("l.amount"))).otherwise(F.coalesce(fold(F.col("l.raw_text")), F.lit("")))
    return inner.where("l.canonical_id = 'coverage_sublimit'").select("policy_id", "kind", "parent", value.alias("value")).distinct()


def sublimit_accuracy(expected: DataFrame, extracted: DataFrame) -> DataFrame:
    """(policy_id, correct, total, accuracy) of sublimits() of both sides for every policy that has any; nothing expected counts as 1."""
    key = ["policy_id", "kind", "parent", "value"]
    return sublimits_judged(expected.select(*key, F.lit(1).alias("e"), F.lit(0).alias("x")).unionByName(extracted.select(*key, F.lit(0).alias("e"), F.lit(1).alias("x"))))


def sublimits_judged(both: DataFrame) -> DataFrame:
    """sublimit_accuracy() of the sublimits of both sides in one table, e 1 where a row is expected and x 1 where it is extracted."""
    key = ["policy_id", "kind", "parent", "value"]
    per = both.groupBy(*key).agg(F.max("e").alias("e"), F.max("x").alias("x")).groupBy("policy_id")
    got = per.agg(F.sum(F.col("e") * F.col("x")).alias("correct"), F.sum("e").alias("total"))
    return got.withColumn("accuracy", F.when(F.col("total") == 0, 1.0).otherwise(F.col("correct") / F.col("total")))
