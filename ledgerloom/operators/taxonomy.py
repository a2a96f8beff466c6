"""Dictionary dimensions: checks, exact resolution of names, keys of items, gaps.

items(category, id, label, item_order) and aliases(category, id, alias) are dictionaries that people write; joins with
them are plain equi-joins, which AQE turns into broadcasts by their measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.text import fold


def alias_table(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """(category, alias_norm, id): labels count as aliases. Colliding aliases keep the smallest id; checks() lists them."""
    every = aliases.select("category", "id", "alias").unionByName(items.select("category", "id", F.col("label").alias("alias")))
    every = every.withColumn("alias_norm", fold(F.col("alias"))).where("alias_norm <> ''")
    return every.groupBy("category", "alias_norm").agg(F.min("id").alias("id"))


def checks(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """(rule, category, subject) of every finding."""
    norm = fold(F.col("alias"))
    both = aliases.select("category", "id", norm.alias("a")).unionByName(items.select("category", "id", fold(F.col("label")).alias("a")))
    found = [
        items.groupBy("category", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("rule"), "category", F.col("id").alias("subject")),
        items.where("trim(coalesce(id, '')) = '' or trim(coalesce(label, '')) = ''").select(F.lit("empty_id_or_label"), "category", F.coalesce("id", F.lit(""))),
        items.join(aliases, ["category", "id"], "left_anti").select(F.lit("no_alias"), "category", "id"),
        aliases.where(norm == "").select(F.lit("empty_alias"), "category", "id"),
        both.where("a <> ''").groupBy("category", "a").agg(F.count_distinct("id").alias("n")).where("n > 1").select(F.lit("alias_collision"), "category", "a"),
    ]
    out = found[0]
    for one in found[1:]:
        out = out.union(one)
    return out


def resolved(facts: DataFrame, items: DataFrame, alias_norms: DataFrame) -> DataFrame:
    """facts(category, given_id, name) with canonical_id and normalization_confidence: a valid given id 1.0, an alias
    0.9, else null and 0.0; item_key is the id or 'unmapped:<folded name>'."""
    known = items.select("category", F.col("id").alias("given_id"), F.lit(True).alias("__given")).distinct()
    alias = alias_norms.select("category", F.col("alias_norm").alias("__norm"), F.col("id").alias("__alias"))
    out = facts.withColumn("__norm", fold(F.col("name"))).join(known, ["category", "given_id"], "left").join(alias, ["category", "__norm"], "left")
    by_id = F.col("__given").isNotNull()
    out = out.withColumn("canonical_id", F.when(by_id, F.col("given_id")).otherwise(F.col("__alias")))
    out = out.withColumn("normalization_confidence", F.when(by_id, 1.0).when(F.col("__alias").isNotNull(), 0.9).otherwise(0.0))
    unnamed = F.when(F.coalesce("__norm", F.lit("")) == "", "unnamed").otherwise(F.col("__norm"))
    return out.withColumn("item_key", F.coalesce("canonical_id", F.concat(F.lit("unmapped:"), unnamed))).drop("__given", "__norm", "__alias")


def scope_key(scopes: DataFrame, by: list[str], key: Column) -> DataFrame:
    """Sorted distinct scope keys of each owner, joined by '+'."""
    return scopes.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(key)), "+").alias("scopes"))


def gaps(resolved_facts: DataFrame, by: str) -> DataFrame:
    """Names without a canonical id, as 'category:name', distinct and sorted."""
    name = F.concat_ws(":", "category", "name")
    return resolved_facts.where("canonical_id is null").groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(name)), ";").alias("gaps"))


def listing(items: DataFrame) -> DataFrame:
    """One text for each category, its items sorted by id."""
    line = F.struct("id", F.concat_ws(": ", "id", "label").alias("text"))
    return items.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_set(line)), lambda x: x["text"]), "\n").alias("listing"))


def recovery_terms(label: Column, aliases: Column, original: Column) -> Column:
    """Label, aliases and original name, one of each folded form, at least six characters and 40 % of the longest."""
    every = F.array_compact(F.concat(F.array(label), F.coalesce(aliases, F.array().cast("array<string>")), F.array(original)))
    keys = F.array_distinct(F.transform(every, fold))
    # keys and the least length are arguments of lambdas: what a lambda's body names is computed once an element
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    least = lambda ks: F.greatest(F.lit(6), F.floor(F.array_max(F.transform(ks, F.length)) * 0.4))
    return once(keys, lambda ks: once(least(ks), lambda n: F.filter(ks, lambda t: F.length(t) >= n)))
