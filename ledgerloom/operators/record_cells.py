"""Whole records as cells of the comparison: fifteen scalar fields and seven collections of items.

records(policy_id, ...) in the columns of sources.records.RECORD. A cell is (entity_id, section, field_id, label, state, key, name);
members say which portfolio an entity belongs to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.text import fold
from ledgerloom.operators import compare
from ledgerloom.operators.nested import contractual_code, item_payload, scoped_key, stable, value_key
from ledgerloom.sources.shared import stored

#: fixed values: sections and fields of a record that are compared, and the dictionary of each collection
SCALARS = [("identification", f) for f in "insurer product_name susep_process policy_number insured policyholder document_version".split()] + [("contractual_terms", f) for f in "policy_period currency premium retroactive_date extended_reporting_period geographic_scope jurisdiction coverage_trigger".split()]
COLLECTIONS = {"policy_limits": "financial_fields", "policy_deductibles": "financial_fields", "coverages": "coverages", "extensions": "extensions", "exclusions": "exclusions", "definitions": "definitions", "clauses": "clauses"}
MONEY = ["policy_limits", "policy_deductibles"]
VALUES, CODED = ["premium", "extended_reporting_period"], ["geographic_scope", "jurisdiction", "coverage_trigger"]


def money_key(v: Column) -> Column:
    return value_key(v["kind"], v["numeric_value"], v["currency"], v["unit"], v["normalized_text"])


def scalar_key(section: str, name: str) -> Column:
    value = F.col(f"{section}.{name}.value")
    if name in VALUES:
        return money_key(value)
    if name == "policy_period":
        return stable(start=value["start"], end=value["end"])
    if name == "retroactive_date":
        return value.cast("string")
    if name in CODED:
        stored = F.col(f"{section}.{name}_canonical")
        return F.coalesce(F.when(stored != "", stored), contractual_code(F.lit(f"{section}.{name}"), value), fold(value))
    return fold(value)


def scalar_cells(records: DataFrame) -> DataFrame:
    """One cell for each of the fifteen fields; a field that a record does not have is NOT_FOUND."""
    one = []
    for section, name in SCALARS:
        state = F.coalesce(F.col(f"{section}.{name}.status"), F.lit("NOT_FOUND"))
        one.append(F.struct(F.lit(section).alias("section"), F.lit(name).alias("field_id"), F.lit(name).alias("label"), state.alias("state"), F.when(state == "FOUND", scalar_key(section, name)).alias("key"), F.lit(None).cast("string").alias("name")))
    return records.select(F.col("policy_id").alias("entity_id"), F.explode(F.array(*one)).alias("c")).select("entity_id", "c.*")


def scalar_rows(records: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """comparison_rows() of scalar_cells(), with the fifteen fields of a record beside each other: a record is one row up to its portfolio, whose fields are
    written out at the end. `size`: about how many cells there would be."""
    every, wide, review = range(len(SCALARS)), [], F.lit(0).cast("long")
    for i, (section, name) in enumerate(SCALARS):
        state = F.coalesce(F.col(f"{section}.{name}.status"), F.lit("NOT_FOUND"))
        found = state == "FOUND"
        wide += [found.alias(f"found{i}"), F.when(found, scalar_key(section, name)).alias(f"key{i}")]
        review = review.bitwiseOR(F.when(state.isin(compare.REVIEW), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    rows = records.select(F.col("policy_id").alias("entity_id"), *wide, review.alias("review")).join(members.select("portfolio_id", "entity_id"), "entity_id")
    least, most = (lambda i: F.min(f"key{i}").alias(f"key{i}")), (lambda i, c: F.max(f"{c}{i}").alias(f"last{i}"))
    flags = F.bit_or("review").alias("review")
    at = F.xxhash64("portfolio_id", F.pmod(F.xxhash64("entity_id"), F.lit(compare.PARTS)))
    rows = compare.dealt(rows.withColumn("__at", at), size, "__at").groupBy("__at", "portfolio_id", "entity_id").agg(flags, *(x for i in every for x in (F.count_if(f"found{i}").alias(f"items{i}"), least(i))))
    rows = rows.groupBy("__at", "portfolio_id").agg(flags, *(x for i in every for x in (F.count_if(F.col(f"items{i}") > 0).alias(f"present{i}"), F.count_if(F.col(f"items{i}") > 1).alias(f"repeats{i}"), least(i), most(i, "key"))))
    rows = compare.dealt(rows.withColumn("__at", F.xxhash64("portfolio_id")), size, "__at").groupBy("__at", "portfolio_id").agg(flags, *(x for i in every for x in (F.sum(f"present{i}").alias(f"present{i}"), F.sum(f"repeats{i}").alias(f"repeats{i}"), least(i), most(i, "last"))))
    one = lambda i, section, name: F.struct(F.lit(section).alias("section"), F.lit(name).alias("field_id"), F.col(f"present{i}").alias("present_count"), (F.col(f"key{i}") == F.col(f"last{i}")).alias("same"), F.col(f"repeats{i}").alias("repeats"), (F.col("review").bitwiseAND(F.lit(1 << i).cast("long")) != 0).cast("int").alias("review"), F.lit(name).alias("label"))
    rows = rows.select("portfolio_id", F.explode(F.array(*(one(i, *field) for i, field in enumerate(SCALARS)))).alias("r")).select("portfolio_id", "r.*")
    return compare.judged(rows, members, False)


def long_items(records: DataFrame) -> DataFrame:
    """Items of all collections as rows (entity_id, section, pos, ...), by one explode; what a section does not have is null. A record's portfolio_id and
    __ids, where it has them, are its items'."""
    kinds = {f.name: f.dataType for f in records.schema.fields}
    limits = kinds["policy_limits"]
    def shaped(section: str):
        has = kinds[section].elementType.fieldNames()

        def one(x, i):
            get = lambda name, kind: (x[name] if name in has else F.lit(None).cast(kind)).alias(name)
            term = section == "definitions"
            text = x["definition_text"] if term else x["summary"] if "summary" in has else F.lit(None).cast("string")
            return F.struct(F.lit(section).alias("section"), i.alias("pos"), x["canonical_term" if term else "canonical_id"].alias("given"), x["original_term" if term else "original_name"].alias("name"), get("category", "string"), get("conditions", "array<string>"), get("exceptions", "array<string>"), get("applies_to", "array<string>"), text.alias("text"), get("value", limits.elementType["value"].dataType), get("limits", limits), get("deductibles", limits))

        return F.transform(F.coalesce(section, F.array().cast(kinds[section])), one)

    own = [F.col("policy_id").alias("entity_id"), *(c for c in ("portfolio_id", "__ids") if c in kinds)]
    return records.select(*own, F.explode(F.concat(*map(shaped, COLLECTIONS))).alias("x")).select("entity_id", *own[1:], "x.*")


def scope_names(records: DataFrame) -> Column:
    """The distinct names of scopes in a record, of its own money and of money inside its items."""
    kinds = {f.name: f.dataType for f in records.schema.fields}
    flat = lambda c: F.flatten(F.array_compact(c))
    inner = [flat(F.col(f"{s}.{m}"))["applies_to"] for s in COLLECTIONS for m in ("limits", "deductibles") if m in kinds[s].elementType.fieldNames()]
    none = F.array().cast("array<string>")
    return F.array_compact(F.array_distinct(F.concat(*(F.coalesce(flat(c), none) for c in [*(F.col(f"{m}.applies_to") for m in MONEY), *inner]))))


def scopes_of(records: DataFrame, items: DataFrame, alias_norms: DataFrame) -> DataFrame:
    """(policy_id, __ids): for each record that names scopes a map from each name to the ids that the dictionary of coverages has for it, else to the name
    as unmapped. Names are looked up once, not once an item."""
    named = records.select("policy_id", F.explode(scope_names(records)).alias("scope"))
    scopes = named.select("scope").distinct().withColumn("norm", fold(F.col("scope")))
    known = items.where("category = 'coverages'").select(F.col("id").alias("scope"), F.col("id").alias("direct")).distinct()
    alias = alias_norms.where("category = 'coverages'").select(F.col("alias_norm").alias("norm"), F.col("id").alias("alias"))
    scopes = scopes.join(known, "scope", "left").join(alias, "norm", "left")
    unnamed = F.concat(F.lit("unmapped:"), F.when(F.col("norm") == "", "scope").otherwise(F.col("norm")))
    # written, so that its size is known when it is joined
    one = stored(scopes.groupBy("scope").agg(F.array_sort(F.collect_set(F.coalesce("direct", "alias", unnamed))).alias("ids")), "scopes")
    return named.join(one, "scope").groupBy("policy_id").agg(F.map_from_entries(F.collect_set(F.struct("scope", "ids"))).alias("__ids"))


def collection_cells(records: DataFrame, items: DataFrame, alias_norms: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """A cell for each item of each collection. Its field is the given id, else the dictionary's id for its name, else the name as
    unmapped; limits and deductibles carry their scopes. Items are compared by their payload. Scopes come to whole records, which are then cut into
    items; money inside items is looked at where it is, in its array. With members, cells have their portfolio_id."""
    rows = records.join(scopes_of(records, items, alias_norms), "policy_id", "left")
    if members is not None:
        rows = rows.join(members.select("portfolio_id", F.col("entity_id").alias("policy_id")), "policy_id")
    rows = long_items(rows)
    none = F.array().cast("array<string>")
    rows = rows.withColumn("__ids", F.coalesce("__ids", F.create_map().cast("map<string,array<string>>")))
    resolved = lambda names: F.array_sort(F.array_distinct(F.flatten(F.transform(F.coalesce(names, none), lambda n: F.coalesce(F.try_element_at(F.col("__ids"), n), none)))))
    payload_of = lambda value, names: stable(value=money_key(value), applies_to=F.array_join(resolved(names), "+"))
    money = lambda c: F.transform(F.coalesce(c, F.array().cast(rows.schema[c].dataType)), lambda m: F.concat(F.lit(f"{c}:"), payload_of(m["value"], m["applies_to"])))
    own = F.col("section").isin(MONEY)
    rows = rows.withColumns({"scope_ids": F.when(own, resolved(F.col("applies_to"))), "own_payload": F.when(own, payload_of(F.col("value"), F.col("applies_to"))), "nested": F.concat(money("limits"), money("deductibles"))})

    dictionary = F.create_map(*(F.lit(x) for kv in COLLECTIONS.items() for x in kv))
    names = alias_norms.select(F.col("category").alias("__category"), F.col("alias_norm").alias("__norm"), F.col("id").alias("__id"))
    rows = rows.withColumn("__category", F.element_at(dictionary, F.col("section"))).withColumn("__norm", fold(F.col("name"))).join(names, ["__category", "__norm"], "left")
    unmapped = F.concat(F.lit("unmapped:"), F.when(F.coalesce("__norm", F.lit("")) == "", "unnamed").otherwise(F.col("__norm")))
    base = F.coalesce(F.when(F.col("given") != "", F.col("given")), "__id", unmapped)
    field = scoped_key(base, F.coalesce("scope_ids", F.array().cast("array<string>")))
    payload = F.coalesce("own_payload", item_payload(F.col("section"), F.col("category"), F.col("conditions"), F.col("nested"), F.col("exceptions"), F.col("applies_to"), F.col("text")))
    place = ["portfolio_id"] if members is not None else []
    return rows.select(*place, "entity_id", "section", field.alias("field_id"), base.alias("label"), F.lit("FOUND").alias("state"), payload.alias("key"), "name")


def compare_records(records: DataFrame, members: DataFrame, items: DataFrame, alias_norms: DataFrame) -> DataFrame:
    """Comparison rows of records inside the portfolios of members (portfolio_id, entity_id, position): repeats of an item under one field
    need review, scalars have none."""
    held = [F.coalesce(F.sum(F.greatest(F.size(c), F.lit(0))), F.lit(0)) for c in COLLECTIONS]
    n, *sizes = records.agg(F.count(F.lit(1)), *held).first()
    alias_norms = stored(alias_norms, "aliases")  # of known size when it is joined
    cells = collection_cells(records, items, alias_norms, members)
    return scalar_rows(records, members, n * len(SCALARS)).unionByName(compare.comparison_rows(cells, members, size=sum(sizes)))
