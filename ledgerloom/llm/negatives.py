"""Hard negatives by slots between the positives' upper limits.

An anchor's positives are the best rows of its own label; for each of them the best rows of other labels are wanted whose
score lies between 50 % and 95 % of the positive's. These windows of scores overlap. Their upper limits, in descending order, cut
the scores into disjoint slots, and the rows below one limit are the slots from there on: so each slot's best `k` rows
are kept, and one walk over the slots in descending order answers every window, however many overlap. Slots are combined
before anything is shuffled.

Anchors are a stated share of the rows, so all of them meet all rows, in blocks: anchors and rows are dealt into blocks of a
bounded size, a cell is one block of each, and a task streams a cell's rows, batch by batch, past its anchors as exact
products of integer vectors. Of a cell only k rows a slot (or a positive's place) of each anchor leave. Blocks are dealt by a
number that rows get once, when they are written, so neither one label nor one vector with a third of all rows makes
a larger cell.

Rows with a null vec_id, label or vector, or any null or non-finite component take no part; an empty vector neither. Rows of
another length than the anchor's are not comparable to it and are passed over. Repeated vec_ids are rows of their own. A component x becomes
floor(256 x); scores beyond a long are cut to its range. Equal scores go by smaller vec_id. Anchors with no positive and windows with no
row give nothing. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from ledgerloom.llm.common import written

TILE = 1 << 21  # scores at once
LEAST = 1024  # rows of a cell from which on rows are dealt out for the tasks' sake
TOP = np.iinfo(np.int64).max


def prepared(vectors: DataFrame) -> DataFrame:
    """(uid, vec_id, label, code): rows that take part, with a number of their own and integer components."""
    clean = vectors.where("vec_id is not null and label is not null and size(embedding) > 0").where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    code = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return written(clean.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), code.alias("code")), "vectors")


def matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact integer products [row, anchor]."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(anchors).max(initial=0)) * rows.shape[1]
    if most < 2**53:
        return (rows.astype(np.float64) @ anchors.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return rows @ anchors.T
    exact = rows.astype(object) @ anchors.astype(object).T
    return np.clip(exact, np.iinfo(np.int64).min, TOP).astype(np.int64)


class Kept:
    """The best k rows of each (anchor, slot), as arrays that are sorted and cut whenever they have grown."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.k, self.slots, self.parts, self.new = k, slots, [], 0
        self.least = np.full(anchors * slots, np.iinfo(np.int64).min)  # below these scores nothing enters

    def add(self, at, score, vec_id):
        enters = score >= self.least[at]
        self.parts.append((at[enters], score[enters], vec_id[enters]))
        self.new += len(self.parts[-1][0])
        if self.new > max(1 << 18, 2 * self.k * len(self.least)):
            self.cut()

    def cut(self):
        at, score, vec_id = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else [np.zeros(0, np.int64)] * 3
        order = np.lexsort((vec_id, ~score, at))
        at, score, vec_id = at[order], score[order], vec_id[order]
        begin = np.flatnonzero(np.diff(at, prepend=-1))
        place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        last = place == self.k - 1
        self.least[at[last]] = score[last]
        keep = place < self.k
        self.parts, self.new = [(at[keep], score[keep], vec_id[keep])], 0
        return self.parts[0]


class Anchors:
    """One block of anchors: vectors by their length, upper limits in descending order, the least score of use."""

    def __init__(self, same: bool, k: int):
        self.same, self.k, self.held, self.ready = same, k, [], False

    def put(self, batch):
        self.held.append(batch)

    def prepare(self):
        table = pa.Table.from_batches(self.held).combine_chunks()
        get = lambda name: table.column(name).to_numpy()
        self.uid, self.label, size = get("uid"), get("label"), get("dim")
        limits = table.column("limits").to_pylist()
        slots = max(map(len, limits))
        self.limits = np.array([x + [np.iinfo(np.int64).min] * (slots - len(x)) for x in limits])
        self.least = get("least")
        self.kept = Kept(len(self.uid), slots, self.k)
        self.by_size = {int(d): (at := np.flatnonzero(size == d), matrix(table.column("code").combine_chunks().take(pa.array(at)), int(d))) for d in np.unique(size)}
        self.ready, self.held = True, []

    def meet(self, batch):
        if not self.ready:
            self.prepare()
        get = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
        uid, vec_id, label, size = get("uid"), get("vec_id"), get("label"), get("dim")
        for d in np.unique(size):
            if int(d) not in self.by_size:
                continue
            anchors, codes = self.by_size[int(d)]
            mine = np.flatnonzero(size == d)
            rows = matrix(batch.column("code").take(pa.array(mine)), int(d))
            # positives: anchors and rows of one label at a time; negatives: all labels at once, own ones struck out
            groups = [(mine[label[mine] == x], anchors[self.label[anchors] == x]) for x in np.intersect1d(label[mine], self.label[anchors])] if self.same else [(mine, anchors)]
            place, row = np.empty(len(self.uid), np.int64), np.empty(len(uid), np.int64)
            place[anchors], row[mine] = np.arange(len(anchors)), np.arange(len(mine))
            for r, a in groups:
                step = max(1, TILE // max(1, len(a)))
                for i in range(0, len(r), step):
                    self.tile(r[i : i + step], a, scores(rows[row[r[i : i + step]]], codes[place[a]]), uid, vec_id, label)

    def tile(self, r, a, score, uid, vec_id, label):
        fits = (score >= self.least[a]) & (score <= self.limits[a, 0])
        fits &= (uid[r][:, None] != self.uid[a]) if self.same else (label[r][:, None] != self.label[a])
        i, j = np.nonzero(fits)
        score, a = score[i, j], a[j]
        slot = np.zeros(len(a), np.int64)
        for s in range(1, self.limits.shape[1]):
            slot += score <= self.limits[a, s]
        self.kept.add(a * self.limits.shape[1] + slot, score, vec_id[r[i]])

    def result(self):
        if not self.ready:
            return
        at, score, vec_id = self.kept.cut()
        yield pa.RecordBatch.from_arrays([pa.array(self.uid[at // self.kept.slots]), pa.array(at % self.kept.slots), pa.array(score), pa.array(vec_id)], ["anchor", "slot", "score", "vec_id"])


def best(anchors: DataFrame, rows: DataFrame, same: bool, k: int, a_blocks: int, r_blocks: int) -> DataFrame:
    """(anchor, slot, score, vec_id): of every anchor (uid, label, code, limits, least) and slot the best k rows of the same or of
    other labels, over all rows; `slot` counts the limits that lie above a score, but the first."""
    none = {"limits": F.lit(None).cast("array<long>"), "least": F.lit(None).cast("long")}
    dealt = lambda df, n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    across = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["a", "r", "kind", "uid", "vec_id", "label", F.size("code").alias("dim"), "code", "limits", "least"]
    left = anchors.withColumns({"a": dealt(anchors, a_blocks), "kind": F.lit(0), "vec_id": F.lit(None).cast("long")}).withColumn("r", across(r_blocks)).select(columns)
    right = rows.withColumns({"r": dealt(rows, r_blocks), "kind": F.lit(1), **none}).withColumn("a", across(a_blocks)).select(columns)
    cells = left.union(right).repartition(a_blocks * r_blocks, "a", "r").sortWithinPartitions("a", "r", "kind")

    def streamed(batches):
        cell, block = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in keys], axis=0)) + 1
            for b, e in zip([0, *cuts], [*cuts, batch.num_rows]):
                if (now := (keys[0][b], keys[1][b])) != cell:
                    if block:
                        yield from block.result()
                    cell, block = now, None
                if keys[2][b] == 0:
                    block = block or Anchors(same, k)
                    block.put(batch.slice(b, e - b))
                elif block:
                    block.meet(batch.slice(b, e - b))
        if block:
            yield from block.result()

    found = cells.mapInArrow(streamed, "anchor long, slot long, score long, vec_id long")
    order = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = 1 << 16) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, label, embedding): for
    each anchor (rows where the SQL condition `is_anchor` holds) and each of its first `positives` rows of the same label the first
    `negatives` rows of other labels with low * positive <= 100 * negative <= high * positive. block: most anchors and rows of a cell, about."""
    spark = vectors.sparkSession
    rows = prepared(vectors)
    anchors = rows.where(is_anchor)
    n, m = rows.count(), anchors.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    a_blocks = max(1, -(-m // block))
    r_blocks = max(1, -(-n // block), min(-(-tasks // a_blocks), n // LEAST))  # a cell for each task, if it has enough rows
    wide = anchors.withColumns({"limits": F.array(F.lit(TOP)), "least": F.lit(int(np.iinfo(np.int64).min))})
    found = best(wide, rows, True, positives, a_blocks, r_blocks).select("anchor", F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id"))
    # whole numbers: low * p <= 100 * s <= high * p
    p = F.col("positive_score").cast("decimal(20,0)")
    found = written(found.withColumns({"floor": F.ceil(p * low / 100).cast("long"), "limit": F.floor(p * high / 100).cast("long")}), "positives")
    useful = found.where("floor <= limit")
    windows = useful.groupBy("anchor").agg(F.sort_array(F.collect_set("limit"), False).alias("limits"), F.min("floor").alias("least"))
    chosen = anchors.join(windows, anchors["uid"] == windows["anchor"]).select("uid", "label", "code", "limits", "least")
    slots = best(chosen, rows, False, negatives, a_blocks, r_blocks)
    # slots descend: in one descending list of an anchor's kept rows, the rows of a window follow each other
    ranked = F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("down"), F.col("vec_id").alias("id"))))
    ranked = slots.groupBy("anchor").agg(ranked.alias("ranked"))
    fits = F.filter("ranked", lambda x: F.bitwise_not(x["down"]).between(F.col("floor"), F.col("limit")))
    out = useful.join(ranked, "anchor").select("anchor", "positive_id", "positive_score", F.posexplode(F.slice(fits, 1, negatives)).alias("at", "one"))
    ids = anchors.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return out.join(ids, "anchor").select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.id").alias("negative_id"), "positive_score", F.bitwise_not("one.down").alias("negative_score"))
