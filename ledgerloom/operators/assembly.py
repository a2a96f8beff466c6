"""All raw facts of documents to whole records, in one exchange.

Scalar facts, items, money, definitions, clauses and the documents' own rows are brought to one tagged row type (`tagged`), put together, and
exchanged once by document; one grouped aggregate folds them to a record. What lies inside another thing (money inside items) is
attached to it afterwards inside the row, so nothing is joined. A record's size is its document's.

Rules: of a field's facts the last one counts, of money fields without an item the first; ambiguous facts do not survive; limits and deductibles are
told apart by field; items keep the order of their facts, a given confidence counts only with an id, a coverage without a category is a main one;
the policy's id is the hint, else its number, else the document's. Facts of unknown kinds, fields and sections are left out. A document of which
there is any row has a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.text import date_or_null, duration, version
from ledgerloom.operators.assemble import field, period
from ledgerloom.operators.nested import DEDUCTIBLES, LIMITS, SECTIONS, contractual_code, policy_id

#: the tagged row: kind is fact, item, money, definition, clause or document
FACT = {"kind": "string", "field_id": "string", "pos": "long", "inner_pos": "long", "status": "string", "normalized": "string", "raw": "string", "text": "string", "amount": "decimal(38,6)", "currency": "string", "canonical_id": "string", "category": "string", "given_confidence": "double", "confidence": "double"}
#: fixed values: text fields of a record and those with codes
TEXTS = "insurer product_name susep_process policy_number insured policyholder document_version".split()
CODED = "geographic_scope jurisdiction coverage_trigger".split()


def tagged(kind: str, rows: DataFrame, by: str = "document_id") -> DataFrame:
    """rows as tagged rows of a kind; columns that they do not have are null. Items carry their section in field_id, money inside
    an item the item's pos and an inner_pos; names are in `raw`."""
    return rows.select(by, F.lit(kind).alias("kind"), *((F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in FACT.items() if c != "kind"))


def put_together(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def text_field(fact: Column) -> Column:
    return field(fact["status"], fact["normalized"], fact["raw"], F.lit(None).cast("string"))


def typed(fact: Column, value: Column) -> Column:
    """A field that is FOUND only if its text is a value."""
    found = (fact["status"] == "FOUND") & value.isNotNull()
    return F.struct(F.when(found, "FOUND").otherwise("NOT_FOUND").alias("status"), F.when(found, value).alias("value"))


def assembled(facts: DataFrame, by: str = "document_id") -> DataFrame:
    """Records (policy_id, by, identification, contractual_terms, policy_limits, policy_deductibles, coverages, extensions, exclusions,
    definitions, clauses, extraction_method) of tagged facts."""
    kind, name = F.col("kind"), F.col("field_id")
    scalars = [*TEXTS, "policy_start", "policy_end", "currency", "retroactive_date", "extended_reporting_period", *CODED]
    listed = lambda test, *columns: F.sort_array(F.collect_list(F.when(test, F.struct("pos", "inner_pos", *columns))))
    loose = (kind == "money") & F.col("inner_pos").isNull()
    price = F.struct(F.coalesce("canonical_id", "field_id").alias("canonical_id"), "amount", "currency", "raw").alias("m")
    # one list a kind, not an aggregate for each field: what tells the fields apart stands last, so that it orders nothing
    folded = facts.groupBy(by).agg(
        F.reverse(listed((kind == "fact") & name.isin(scalars) & F.col("pos").isNotNull(), "status", "normalized", "raw", name.alias("name"))).alias("facts"),
        listed(loose & name.isin("premium", *LIMITS, *DEDUCTIBLES), price, name.alias("of")).alias("money"),
        listed((kind == "money") & F.col("inner_pos").isNotNull(), price).alias("inner"),
        listed((kind == "item") & name.isin(SECTIONS), "canonical_id", F.col("raw").alias("name"), "category", "given_confidence", "confidence", name.alias("of")).alias("items"),
        listed(kind == "definition", F.col("canonical_id").alias("canonical_term"), F.col("raw").alias("original_term"), F.col("text").alias("definition_text")).alias("definitions"),
        listed(kind == "clause", "canonical_id", F.col("raw").alias("name"), "category", F.col("text").alias("summary")).alias("clauses"),
        F.max(F.when(kind == "document", F.col("raw"))).alias("hint"),
        F.max(F.when(kind == "document", F.col("status"))).alias("extraction_method"),
    )
    of_kind = lambda c, names: F.filter(c, lambda x: x["of"].isin(names))
    last = lambda f: F.get("facts", F.array_position(F.col("facts")["name"], f).cast("int") - 1).alias(f"f_{f}")
    premium = F.get(F.filter("money", lambda x: (x["of"] == "premium") & x["pos"].isNotNull()), 0)["m"].alias("premium")
    folded = folded.select(by, "hint", "extraction_method", "inner", "definitions", "clauses", premium, of_kind("money", LIMITS).alias("policy_limits"), of_kind("money", DEDUCTIBLES).alias("policy_deductibles"), *(of_kind("items", [s]).alias(s) for s in SECTIONS), *map(last, scalars))
    of = lambda f: F.col(f"f_{f}")
    said = lambda f: F.coalesce(of(f)["normalized"], of(f)["raw"])
    day = lambda f: F.when(of(f)["status"] == "FOUND", date_or_null(said(f)))

    def item(section: str):
        def one(x):
            known = x["canonical_id"].isNotNull()
            owner = F.when(known, F.array(x["canonical_id"])).otherwise(F.array().cast("array<string>"))
            limits = F.transform(F.filter("inner", lambda m: m["pos"] == x["pos"]), lambda m: F.struct(m["m"]["canonical_id"].alias("canonical_id"), m["m"]["amount"].alias("amount"), m["m"]["currency"].alias("currency"), owner.alias("applies_to")))
            confidence = F.greatest(F.coalesce(x["confidence"], F.lit(0.0)), F.when(known, x["given_confidence"]).otherwise(0.0))
            category = F.coalesce(x["category"], F.lit("MAIN_COVERAGE")) if section == "coverages" else x["category"]
            return F.struct(x["canonical_id"].alias("canonical_id"), x["name"].alias("original_name"), confidence.alias("normalization_confidence"), category.alias("category"), limits.alias("limits"))

        return F.transform(section, one).alias(section)

    texts = [text_field(of(f)).alias(f) for f in TEXTS if f != "document_version"]
    dated = text_field(of("document_version"))
    identification = F.struct(*texts, F.struct(dated["status"].alias("status"), version(dated["value"]).alias("value")).alias("document_version"))
    whole = lambda d: F.when(d["number"].isNotNull() & d["unit"].isNotNull(), F.struct(d["number"].alias("number"), d["unit"].alias("unit")))
    span = F.get(F.transform(F.array(duration(said("extended_reporting_period"))), whole), 0)  # read once, not once for each mention
    money = F.struct(F.when(F.col("premium.amount").isNotNull(), "FOUND").otherwise("NOT_FOUND").alias("status"), F.col("premium.amount").alias("value"), F.col("premium.currency").alias("currency"))
    coded = [c for f in CODED for c in (text_field(of(f)).alias(f), contractual_code(F.lit(f"contractual_terms.{f}"), text_field(of(f))["value"]).alias(f"{f}_canonical"))]
    terms = F.struct(period(day("policy_start"), day("policy_end")).alias("policy_period"), text_field(of("currency")).alias("currency"), money.alias("premium"), typed(of("retroactive_date"), date_or_null(said("retroactive_date"))).alias("retroactive_date"), typed(of("extended_reporting_period"), span).alias("extended_reporting_period"), *coded)
    flat = lambda c: F.transform(c, lambda x: x["m"]).alias(c)
    plain = lambda c: F.transform(c, lambda x: x.dropFields("pos", "inner_pos")).alias(c)
    number = text_field(of("policy_number"))["value"]
    return folded.select(policy_id(F.col("hint"), number, F.col(by).cast("string")).alias("policy_id"), by, identification.alias("identification"), terms.alias("contractual_terms"), flat("policy_limits"), flat("policy_deductibles"), *map(item, SECTIONS), plain("definitions"), plain("clauses"), "extraction_method")
