"""Embedding near-duplicates by spherical-cap filters (locality-sensitive filtering with random product codes).

A filter is a direction (a_i, b_j) / sqrt 2 made of one random unit codeword for each half of the coordinates, so
`code` codewords a half give code**2 filters of which none is stored. A vector is list-decoded to all filters whose
inner product reaches the cap height: only codewords that can still exceed with the best one of the other half are
looked at. The cap height makes `filters` filters a vector expected; a vector with fewer than `least` takes its `least`
best. Vectors of one label meet by an equi-join on the whole filter (label, dimension, i, j); a meeting pair counts only
at its lowest common filter, where its exact cosine in double precision decides, so no table of pairs is ever built.

If `code` is not given it is the least power of two whose filters hold one unrelated vector of the largest label each on
average (64 to 4,096; beyond that table size filters fill up in proportion), so the unrelated pairs that are compared grow with the rows, not with their square. Only filters
that two vectors have get the vectors themselves; the others end as (filter, number) rows. A filter with more than
`block` vectors is split into pairs of blocks.

Equal vectors of a label are collapsed before (their links follow from the count), so a group of copies costs one
vector. Null, zero or non-finite vectors and null labels link with nothing; vectors of different dimension never link.
Repeated vec_ids are rows of their own: a number that each distinct vector of a label gets is the key of all joins, not its vec_id.
Rows without a vec_id link like others; they name no component, and kept is true for them only where their component has no vec_id at all. An empty table gives an empty result. Extra columns are dropped. Labels may be of
any type that groups, components float or double.
The filters are random (fixed seed), so a link can be missed: measured recall stands in the README.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import connected_components, discard, spanning, written

SMALL = 24  # larger groups are compared by matrix products


def codewords(size: int, dim: int, half: int) -> np.ndarray:
    x = np.random.default_rng([17, half]).standard_normal((size, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def list_decode(unit: np.ndarray, code: int, filters: int, least: int) -> list[np.ndarray]:
    """Filter numbers i * code + j of each unit vector, ascending."""
    cut = (unit.shape[1] + 1) // 2
    height = NormalDist().inv_cdf(1 - min(0.5, filters / code**2)) / math.sqrt(unit.shape[1]) * math.sqrt(2)
    first_words, second_words = codewords(code, cut, 0), codewords(code, unit.shape[1] - cut, 1) if unit.shape[1] > cut else None
    out = []
    for lo in range(0, len(unit), 256):
        part = unit[lo : lo + 256]
        first = part[:, :cut] @ first_words.T
        second = part[:, cut:] @ second_words.T if second_words is not None else np.zeros((len(part), code))
        order = np.argsort(-second, axis=1)
        falling = np.take_along_axis(second, order, 1)
        row, i = np.nonzero(first + falling[:, :1] >= height)
        top = min(32, code)  # second codewords looked at, from the best one on
        while True:
            hit = first[row, i][:, None] + falling[row, :top] >= height
            if top == code or not hit[:, -1].any():
                break
            top = min(2 * top, code)
        which, rank = np.nonzero(hit)
        row, number = row[which], i[which].astype(np.int64) * code + order[row[which], rank]
        few = np.flatnonzero(np.bincount(row, minlength=len(part)) < least)
        if len(few):  # the best sums are among the best of either half
            k = min(least, code)
            best = np.argpartition(first[few], -k, axis=1)[:, -k:]
            total = (np.take_along_axis(first[few], best, 1)[:, :, None] + falling[few][:, None, :k]).reshape(len(few), -1)
            at = np.argpartition(total, -min(least, k * k), axis=1)[:, -min(least, k * k) :]
            taken = np.take_along_axis(best, at // k, 1).astype(np.int64) * code + np.take_along_axis(order[few], at % k, 1)
            keep = ~np.isin(row, few)
            row, number = np.concatenate([row[keep], np.repeat(few, at.shape[1])]), np.concatenate([number[keep], taken.ravel()])
        number = number[np.lexsort((number, row))]
        out.extend(np.split(number, np.cumsum(np.bincount(row, minlength=len(part)))[:-1]))
    return out


def meeting(unit: np.ndarray, lists: np.ndarray, group: np.ndarray, filter_: np.ndarray, side: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """(linked pairs of rows (i, j), i < j, number of cosines taken) of rows sorted by group. lists: filters of each row,
    filled up with negative numbers that occur once. side: 0, or 1 and 2 where only pairs of different sides count."""
    cuts = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(np.append(cuts, len(group)))
    near, taken = [], 0
    for k in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
        begin = cuts[sizes == k]
        a, b = np.triu_indices(k, 1)
        step = max(1, (1 << 18) // len(a))
        for x in range(0, len(begin), step):
            i, j = ((begin[x : x + step, None] + c[None, :]).ravel() for c in (a, b))
            keep = (side[i] == 0) | (side[i] != side[j])
            i, j = i[keep], j[keep]
            taken += len(i)
            hit = np.einsum("nd,nd->n", unit[i], unit[j]) >= threshold
            near.append(np.stack([i[hit], j[hit]], 1))
    small = np.concatenate(near) if near else np.zeros((0, 2), np.int64)
    near = [small[lowest_by_search(lists, small, filter_)]]
    for at, k in zip(cuts[sizes > SMALL], sizes[sizes > SMALL]):
        cosine = unit[at : at + k] @ unit[at : at + k].T >= threshold
        mine = side[at : at + k]
        cosine &= (mine[:, None] == 0) | (mine[:, None] != mine[None, :])
        np.fill_diagonal(cosine, False)
        taken += k * (k - 1) // 2
        rows = np.flatnonzero(cosine.any(1))
        if len(rows):
            cosine = cosine[np.ix_(rows, rows)] & ~common_below(lists[at + rows], filter_[at])
            near.append(np.argwhere(np.triu(cosine, 1)))
            near[-1] = at + rows[near[-1]]
    return np.concatenate(near), taken


def lowest_by_search(lists: np.ndarray, pairs: np.ndarray, filter_: np.ndarray) -> np.ndarray:
    """Whether a pair's rows have no common filter below the one they met at."""
    out = np.ones(len(pairs), bool)
    own = np.where(lists >= 0, lists, 0).astype(np.int64) + (np.arange(len(lists), dtype=np.int64) << 32)[:, None]
    flat = own[lists >= 0]  # ascending: by row, then by filter
    for x in range(0, len(pairs), 1 << 15):
        p = pairs[x : x + (1 << 15)]
        mine = lists[p[:, 0]]
        pair, column = np.nonzero((mine >= 0) & (mine < filter_[p[:, 0], None]))
        wanted = (p[pair, 1].astype(np.int64) << 32) + mine[pair, column]
        found = flat[np.minimum(np.searchsorted(flat, wanted), len(flat) - 1)] == wanted
        out[x + pair[found]] = False
    return out


def common_below(lists: np.ndarray, here: int) -> np.ndarray:
    """Boolean matrix of the rows that have a common filter below `here`."""
    row, column = np.nonzero((lists >= 0) & (lists < here))
    ids, at = np.unique(lists[row, column], return_inverse=True)
    out = np.zeros((len(lists), len(lists)), bool)
    for a in range(0, len(ids), 4096):  # bounds the memory
        some = (at >= a) & (at < a + 4096)
        grid = np.zeros((len(lists), min(4096, len(ids) - a)), np.float32)
        grid[row[some], at[some] - a] = 1
        out |= grid @ grid.T > 0
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, code: int | None = None, filters: int = 32, least: int = 24, block: int = 1200) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors (vec_id, embedding, label)."""
    rows = vectors.select("vec_id", "embedding", "label")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0))
    groups = fine.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    groups = written(groups.withColumn("rep", F.monotonically_increasing_id()), "vectors")  # rep: the vector's own number
    if code is None:
        most = groups.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
        code = min(1 << 12, max(64, 1 << math.ceil(math.log2(math.sqrt(filters * most)))))
    kind = {f.name: f.dataType.simpleString() for f in groups.schema.fields}

    def decoded(batches):
        for batch in batches:
            n = [len(x) for x in batch.column("embedding").to_pylist()]
            lists = [np.zeros(0, np.int64)] * batch.num_rows
            for dim in set(n):
                at = np.flatnonzero(np.array(n) == dim)
                x = np.array(batch.column("embedding").take(pa.array(at)).to_pylist(), np.float64)
                for k, found in zip(at, list_decode(x / np.linalg.norm(x, axis=1, keepdims=True), code, filters, least)):
                    lists[k] = found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int32()), pa.array([x.astype(np.int32) for x in lists], pa.list_(pa.int32()))], [*batch.schema.names, "dim", "filters"])

    entered = groups.drop("least")
    fields = ", ".join(f"{c} {kind[c]}" for c in entered.columns)
    coded = written(entered.mapInArrow(decoded, f"{fields}, dim int, filters array<int>"), "decoded")
    entries = coded.select("label", "dim", F.explode("filters").alias("filter"), "rep")
    met = entries.groupBy("label", "dim", "filter").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = met.select("label", "dim", "filter", F.ceil(F.col("members") / block).cast("int").alias("parts"))
    ids = entries.join(met, ["label", "dim", "filter"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    ids = ids.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    ids = ids.select("label", "dim", "filter", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "rep")
    sent = ids.join(coded.select("rep", "label", "dim", "copies", "embedding", "filters"), ["rep", "label", "dim"])
    keys = ["label", "dim", "filter", "lo", "hi"]
    # neighbours in the sort order are numbered by Spark's own comparison of the keys, so labels of any type do
    sent = sent.withColumn("cell", F.xxhash64(*keys)).select("cell", *keys[2:], "dim", "part", "rep", "copies", "embedding", "filters", "label")

    def compared(batches):
        held = []

        def found(table):
            table = table.combine_chunks()
            column = {c: table.column(c).to_numpy() for c in ("cell", "filter", "lo", "hi", "dim", "part", "rep", "copies")}
            label = table.column("label").combine_chunks()
            label = (label if isinstance(label, pa.DictionaryArray) else label.dictionary_encode()).indices.to_numpy()
            group = np.cumsum(np.any([np.diff(c, prepend=c[:1]) != 0 for c in (label, *(column[k] for k in ("dim", "filter", "lo", "hi")))], axis=0))
            some = table.column("filters").combine_chunks()
            size = np.diff(some.offsets.to_numpy())
            lists = -3 - np.arange(len(size), dtype=np.int64)[:, None] * np.ones(max(1, size.max()), np.int64)
            lists[np.arange(lists.shape[1]) < size[:, None]] = some.flatten().to_numpy()
            for dim in np.unique(column["dim"]):
                at = np.flatnonzero(column["dim"] == dim)
                x = table.column("embedding").take(pa.array(at)).combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(at), dim)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                side = np.where(column["lo"] != column["hi"], 1 + (column["part"] == column["hi"]), 0)[at]
                pairs, _ = meeting(unit, lists[at], group[at], column["filter"][at], side, threshold)
                if not len(pairs):
                    continue
                rep, copies = column["rep"][at], column["copies"][at]
                links = np.bincount(pairs.ravel(), copies[pairs[:, ::-1]].ravel(), len(at)).astype(np.int64)
                i, j = spanning(pairs, len(at))
                linked = np.flatnonzero(links)
                src, dst, n = np.concatenate([rep[linked], rep[i]]), np.concatenate([rep[linked], rep[j]]), np.concatenate([links[linked], np.zeros(len(i), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(n)], ["src", "dst", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 8192:
                continue
            table = pa.Table.from_batches(held)
            last = np.flatnonzero(table.column("cell").to_numpy() != table.column("cell")[-1].as_py())
            whole = int(last[-1]) + 1 if len(last) else 0  # the last cell may go on
            if whole:
                yield from found(table.slice(0, whole))
                held = pa.Table.slice(table, whole).to_batches()
        if held:
            yield from found(pa.Table.from_batches(held))

    sent = sent.repartition("cell").sortWithinPartitions("cell", *keys)
    found = written(sent.mapInArrow(compared, "src long, dst long, n long"), "links")
    links = found.where("n > 0").groupBy(F.col("src").alias("rep")).agg(F.sum("n").alias("n"))
    components = connected_components(found.where("src <> dst").select("src", "dst")).withColumnRenamed("node", "rep")
    linked = groups.join(components, "rep", "left").join(links, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    names = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    per = linked.join(names, "component").select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", F.lit(True).alias("fine"))
    discard(coded)
    out = rows.join(per, ["label", "embedding"], "left")
    component = F.when(F.col("fine"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
