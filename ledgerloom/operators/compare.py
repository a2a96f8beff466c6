"""N-way comparison of entities inside portfolios, over one long table of cells.

members(portfolio_id, entity_id, position) and cells(portfolio_id, entity_id, section, field_id, label, state, key,
name): one row for each statement of an entity on a field. A field (row) is aligned over all members of its portfolio.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

ROW = ["portfolio_id", "section", "field_id"]
REVIEW = ["AMBIGUOUS", "CONFLICTING"]


TASK, PARTS, PLACES = 1_000_000, 64, 1 << 20  # cells of a task, parts into which the members of a field are dealt, places by which fields are dealt: few bytes in an exchange


def dealt(df: DataFrame, size: int, *by) -> DataFrame:
    """df dealt by columns to tasks of about TASK rows, as it has `size` rows: their number grows with the table, not the memory of each."""
    if size <= TASK:
        return df.repartition(*by)
    return df.repartition(max(-(-size // TASK), df.sparkSession.sparkContext.defaultParallelism), *by)


def entity_values(cells: DataFrame, by: list[str] = [], keys: list[str] = ["key"]) -> DataFrame:
    """One row for each entity and field: statements, key, review flag. The first of the aggregations."""
    found = F.col("state") == "FOUND"
    return cells.groupBy(*by, *ROW, "entity_id").agg(
        F.count_if(found).alias("items"),
        *(F.min(F.when(found, F.col(k))).alias(k) for k in keys),
        F.max(F.col("state").isin(REVIEW).cast("int")).alias("review"),
        F.min("label").alias("label"),
    )


def status(repeats_need_review: bool) -> Column:
    """Status from present, members, whether all keys are the same, review and repeats; the order of the rules matters."""
    review = (F.col("review") > 0) | ((F.col("repeats") > 0) if repeats_need_review else F.lit(False))
    return (
        F.when(review, "NEEDS_REVIEW")
        .when(F.col("present_count") == 0, "ALL_MISSING")
        .when(F.col("present_count") < F.col("policy_count"), "ONLY_IN_SOME")
        .when(F.col("same"), "EQUAL")
        .otherwise("DIFFERENT")
    )


def comparison_rows(cells: DataFrame, members: DataFrame, repeats_need_review: bool = True, size: int | None = None) -> DataFrame:
    """One row for each field of each portfolio with its status and presence counts. Cells are dealt once by field and part of its members, in
    which entities are put together without a further exchange, and once more by field; `size`: about how many cells there are, else they are counted.
    Where an entity with several keys needs review anyway, keys are compared by 128 bits of hashes, which are grouped without sorting."""
    keys = ["key"]
    if repeats_need_review:
        keys = ["key", "key_more"]
        cells = cells.withColumns({k: F.when(F.col("key").isNotNull(), F.xxhash64(F.lit(i), "key")) for i, k in enumerate(keys)})
    size = cells.count() if size is None else size
    place = lambda *by: F.pmod(F.xxhash64(*by), F.lit(PLACES)).cast("int")
    at = place(*ROW, F.pmod(F.xxhash64("entity_id"), F.lit(PARTS)))  # a column of its own: constant ones leave groups, but not what is dealt by
    values = entity_values(dealt(cells.withColumn("__at", at), size, "__at"), ["__at"], keys)
    rows = values.groupBy("__at", *ROW).agg(
        F.count_if(F.col("items") > 0).alias("present_count"),
        *(x for k in keys for x in (F.min(k).alias(k), F.max(k).alias(f"last_{k}"))),
        F.count_if(F.col("items") > 1).alias("repeats"),
        F.max("review").alias("review"),
        F.min("label").alias("label"),
    )
    rows = dealt(rows.withColumn("__at", place(*ROW)), size, "__at").groupBy("__at", *ROW).agg(
        F.sum("present_count").alias("present_count"),
        reduce(and_, (F.min(k) == F.max(f"last_{k}") for k in keys)).alias("same"),
        F.sum("repeats").alias("repeats"),
        F.max("review").alias("review"),
        F.min("label").alias("label"),
    )
    return judged(rows.drop("__at"), members, repeats_need_review)


def judged(rows: DataFrame, members: DataFrame, repeats_need_review: bool) -> DataFrame:
    """Counted rows (present_count, same, repeats, review) with their portfolio's size and status."""
    counts = members.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("policy_count"))
    # portfolios are few and AQE broadcasts their counts by measured size
    rows = rows.join(counts, "portfolio_id").withColumn("status", status(repeats_need_review)).drop("same")
    return rows.withColumn("presence", F.concat_ws("/", "present_count", "policy_count"))


def matrix(cells: DataFrame, members: DataFrame) -> DataFrame:
    """All fields of a portfolio x all its members; a cell that nobody states is NOT_FOUND. The join stays inside a
    portfolio, so its size is what the result asks for."""
    values = entity_values(cells)
    full = values.select(*ROW).distinct().join(members, "portfolio_id")
    out = full.join(values, [*ROW, "entity_id"], "left")
    return out.withColumn("state", F.when(F.col("items") > 0, "FOUND").when(F.col("review") > 0, "AMBIGUOUS").otherwise("NOT_FOUND"))


TILE = 1 << 22  # cells of the matrix that a task holds at once
STATES = ["NOT_FOUND", "AMBIGUOUS", "FOUND"]


def counted_tiles(batches, tile: int = TILE):
    """Batches (portfolio_id, n, cells, found) from batches (portfolio_id, part, field, member, state, members) sorted by the first three: the fields of a part of a
    portfolio are numbered from 1. The matrix of a part, all its fields x all members of its portfolio, is filled tile by tile and its cells are counted by member."""
    at = grid = found = None
    base = last = 0  # fields before the tile, fields so far

    def fold():
        for a in range(0, last - base, 255):  # as many rows as a byte counts
            held = grid[a : min(a + 255, last - base)]
            np.add(found, (held == 2).sum(axis=0, dtype=np.uint8), out=found)
        grid[: last - base] = 0

    def member_counts():
        fold()
        n = np.arange(1, len(found) + 1)
        return pa.RecordBatch.from_arrays([pa.array([at[0]] * len(n), kind), pa.array(n), pa.array(np.full(len(n), last)), pa.array(found)], ["portfolio_id", "n", "cells", "found"])

    for batch in batches:
        kind = batch.column(0).type
        portfolios = batch.column(0).dictionary_encode()
        codes = portfolios.indices.to_numpy(zero_copy_only=False)
        part, field, state, members = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 4, 5))
        member = batch.column(3).fill_null(0).to_numpy(zero_copy_only=False)  # 0: a statement that makes a field, but is nobody's cell
        cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (part[1:] != part[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if a == b:
                continue
            if at != (key := (portfolios.dictionary[int(codes[a])].as_py(), int(part[a]))):
                if at:
                    yield member_counts()
                at, base, last = key, 0, 0
                grid = np.zeros((max(1, tile // int(members[a])), int(members[a])), np.uint8)
                found = np.zeros(int(members[a]), np.int64)
            while a < b:
                end = a + int(np.searchsorted(field[a:b], base + len(grid), "right"))
                if end > a:
                    held = np.flatnonzero(member[a:end] > 0) + a
                    grid[field[held] - base - 1, member[held] - 1] = state[held]
                    last = int(field[end - 1])
                if end < b:
                    fold()
                    base += len(grid)
                a = end
    if at:
        yield member_counts()


def matrix_counts(cells: DataFrame, members: DataFrame, size: int | None = None) -> DataFrame:
    """(portfolio_id, entity_id, cells, found, missing): the cells of matrix() made and counted by member. Cells that are stated are dealt once by portfolio and part of its fields;
    the others are made where they are counted, in tiles of a fixed size, so that nothing as large as the matrix is exchanged or held. `size`: see comparison_rows()."""
    size = cells.count() if size is None else size
    place = members.select("portfolio_id", "entity_id", F.row_number().over(W.partitionBy("portfolio_id").orderBy("entity_id")).cast("long").alias("n"))
    counts = members.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("members"))
    part = F.pmod(F.xxhash64("section", "field_id"), F.lit(PARTS)).alias("part")
    stated = cells.select(*ROW, part, "entity_id", "state").join(place, ["portfolio_id", "entity_id"], "left").join(counts, "portfolio_id")
    # a field without section or id equals no field: it has a row of the matrix, and nobody states it
    stated = stated.withColumn("member", F.when(F.col("section").isNotNull() & F.col("field_id").isNotNull(), F.col("n")))
    review, said = F.max(F.col("state").isin(REVIEW).cast("int")), F.count_if(F.col("state") == "FOUND") > 0
    held = dealt(stated, size, "portfolio_id", "part").groupBy(*ROW, "part", "member", "members").agg(F.when(said, STATES.index("FOUND")).when(review > 0, STATES.index("AMBIGUOUS")).otherwise(STATES.index("NOT_FOUND")).alias("state"))
    held = held.withColumn("field", F.dense_rank().over(W.partitionBy("portfolio_id", "part").orderBy("section", "field_id")))
    kind = held.schema["portfolio_id"].dataType.simpleString()
    made = held.select("portfolio_id", "part", "field", "member", "state", "members").mapInArrow(counted_tiles, f"portfolio_id {kind}, n long, cells long, found long")
    out = made.groupBy("portfolio_id", "n").agg(F.sum("cells").alias("cells"), F.sum("found").alias("found")).join(place, ["portfolio_id", "n"])
    out = out.groupBy("portfolio_id", "entity_id").agg(F.sum("cells").alias("cells"), F.sum("found").alias("found"))
    return out.withColumn("missing", F.col("cells") - F.col("found"))


WORD = 64  # members in one word of bits


def bit(position: Column) -> Column:
    """A member's bit in its word."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(position, F.lit(WORD)).cast("int"))


def member_words(members: DataFrame) -> DataFrame:
    """(portfolio_id, word, every, ids): the members of a portfolio, WORD positions to a word: their bits, and their ids in portfolio order."""
    held = members.select("portfolio_id", F.floor(F.col("position") / WORD).alias("word"), bit(F.col("position")).alias("one"), F.struct("position", bit(F.col("position")).alias("bit"), F.col("entity_id").cast("string").alias("entity_id")).alias("id"))
    return held.groupBy("portfolio_id", "word").agg(F.bit_or("one").alias("every"), F.array_sort(F.collect_list("id")).alias("ids"))


def present_bits(cells: DataFrame, members: DataFrame, by: list[str]) -> DataFrame:
    """(by..., word, bits, review): which members state something FOUND, as bits: one fixed-size state a word of members, whatever they are."""
    at = cells.join(members.select("portfolio_id", "entity_id", "position"), ["portfolio_id", "entity_id"])
    here = F.when(F.col("state") == "FOUND", bit(F.col("position"))).otherwise(F.lit(0).cast("long"))
    return at.groupBy(*by, F.floor(F.col("position") / WORD).alias("word")).agg(F.bit_or(here).alias("bits"), F.max(F.col("state").isin(REVIEW).cast("int")).alias("review"))


def presence(cells: DataFrame, members: DataFrame) -> DataFrame:
    """Lists of present and missing members of each field, in portfolio order. Up to the lists, members are bits; a word of members (64) is one
    row, and ids are cut from its bits. Positions are different inside a portfolio."""
    words = member_words(members)
    bits = present_bits(cells, members, ROW).select(*ROW, "word", "bits")
    fields = cells.select(*ROW).distinct().join(words, "portfolio_id").join(bits, [*ROW, "word"], "left").withColumn("bits", F.coalesce("bits", F.lit(0).cast("long")))
    cut = lambda mask: F.transform(F.filter("ids", lambda x: x["bit"].bitwiseAND(mask) != 0), lambda x: x["entity_id"])
    per = F.array_sort(F.collect_list(F.struct("word", cut(F.col("bits")).alias("p"), cut(F.bitwise_not("bits")).alias("m"))))
    got = fields.groupBy(*ROW).agg(per.alias("per"))
    return got.select(*ROW, F.flatten(F.transform("per", lambda x: x["p"])).alias("present_ids"), F.flatten(F.transform("per", lambda x: x["m"])).alias("missing_ids"))


def duplicates(cells: DataFrame) -> DataFrame:
    """Entities with more than one statement under a field, with the distinct sorted names."""
    got = cells.where("state = 'FOUND'").groupBy(*ROW, "entity_id").agg(F.count(F.lit(1)).alias("items"), F.array_sort(F.collect_set("name")).alias("names"))
    return got.where("items > 1")


def summary(rows: DataFrame) -> DataFrame:
    kinds = {"equal": "EQUAL", "different": "DIFFERENT", "only_in_some": "ONLY_IN_SOME", "all_missing": "ALL_MISSING", "needs_review": "NEEDS_REVIEW"}
    counts = [F.count_if(F.col("status") == v).alias(k) for k, v in kinds.items()]
    got = rows.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("row_count"), *counts)
    return got.withColumn("material", F.col("different") + F.col("only_in_some") + F.col("needs_review"))


def key_differences(rows: DataFrame, sections: list[str], limit: int = 12) -> DataFrame:
    """The first `limit` rows of each portfolio by section priority, status, label and field."""
    rank = lambda c, values: F.array_position(F.array(*map(F.lit, values)), F.col(c))
    kinds = ["NEEDS_REVIEW", "ONLY_IN_SOME", "DIFFERENT"]
    order = [rank("section", sections), rank("status", kinds), F.lower("label"), F.col("field_id")]
    picked = rows.where(F.col("section").isin(sections) & F.col("status").isin(kinds))
    return picked.withColumn("rank", F.row_number().over(W.partitionBy("portfolio_id").orderBy(*order)).cast("long")).where(F.col("rank") <= limit)


def ordered_rows(rows: DataFrame) -> DataFrame:
    """Reading order inside a portfolio: mapped fields before unmapped ones, then label, then field."""
    order = [F.startswith(F.col("field_id").cast("string"), F.lit("unmapped:")), F.lower("label"), F.col("field_id")]
    return rows.withColumn("row_order", F.row_number().over(W.partitionBy("portfolio_id", "section").orderBy(*order)).cast("long"))


def harmonized(cells: DataFrame, members: DataFrame, concepts: DataFrame) -> DataFrame:
    """Presence of concepts, each a family of (section, field_id), over the members of each portfolio."""
    said = cells.join(concepts.select("concept_id", "section", F.col("field_id")), ["section", "field_id"])
    per = present_bits(said, members, ["portfolio_id", "concept_id"])
    got = per.groupBy("portfolio_id", "concept_id").agg(F.sum(F.bit_count("bits")).alias("present"), F.max("review").alias("review"))
    every = members.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("policy_count")).crossJoin(concepts.select("concept_id", "concept_label").distinct())  # the rows that the result has
    out = every.join(got, ["portfolio_id", "concept_id"], "left").withColumn("present_count", F.coalesce("present", F.lit(0)))
    state = F.when(F.col("review") > 0, "NEEDS_REVIEW").when(F.col("present_count") == 0, "ABSENT_IN_ALL").when(F.col("present_count") == F.col("policy_count"), "PRESENT_IN_ALL").otherwise("PRESENT_IN_SOME")
    return out.select("portfolio_id", "concept_id", "concept_label", "present_count", "policy_count", state.alias("status"))


def subset(members: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members that are asked for, asked ids nobody has)."""
    return members.join(wanted, "entity_id", "left_semi"), wanted.join(members, "entity_id", "left_anti")


def wide(rows: DataFrame, columns: list[str], name: str, value: str) -> DataFrame:
    """One column for each value of `name` that is listed."""
    return rows.groupBy(*ROW).pivot(name, columns).agg(F.first(value))


def unique_labels(entities: DataFrame, label: str, suffix: str, into: str = "unique_label") -> DataFrame:
    """Equal labels are told apart by a suffix, and equal pairs by a number."""
    same = F.count(F.lit(1)).over(W.partitionBy(label))
    pair = W.partitionBy(label, suffix)
    nth = F.row_number().over(pair.orderBy("entity_id"))
    text = F.when(same == 1, F.col(label)).otherwise(F.concat(F.col(label), F.lit(" - "), F.col(suffix)))
    return entities.withColumn(into, F.when((same > 1) & (F.count(F.lit(1)).over(pair) > 1), F.concat(text, F.lit(" ("), nth.cast("string"), F.lit(")"))).otherwise(text))


def report_lines(rows: DataFrame) -> DataFrame:
    """Report text, one row a portfolio: a heading for each section and a line for each status with its number of rows."""
    counts = rows.groupBy("portfolio_id", "section", "status").agg(F.count(F.lit(1)).alias("n"))
    line = F.struct("section", "status", F.concat(F.lit("| "), "section", F.lit(" | "), "status", F.lit(" | "), F.col("n").cast("string"), F.lit(" |")).alias("text"))
    got = counts.groupBy("portfolio_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return got.select("portfolio_id", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("report"))
