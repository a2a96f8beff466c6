"""N-gram Jaccard join by prefix trees.

A document is the set of its distinct word n-grams in one global order: longer n-grams first (in bytes, a fixed stand-in
for rarity), then by hash. Equal sets are one: a task makes their points
once, and groups hold the smallest document of each. Sets meet at points, which are chosen so that no
link is lost: sizes fall into classes a factor of the threshold wide, a pair lies in one class or two neighbouring ones,
and for the larger class at most k n-grams are in only one of two linked sets. The hash range is cut into k + 1 + e
parts, so linked sets agree on e + 1 whole parts at least; each non-empty part's content is a point of the set. Only sets
with more than e empty parts could agree on empty ones alone; they also get the n-grams of their prefix (the first
n - ceil(threshold * n) + 1 in the global order, of which linked sets share one) as points. A passage that many
documents share makes no points, since parts hold n-grams of the whole text.

Points whose smallest document is the same one are merged, and each such group gets its sets once. A task stores the
sets of a group in a prefix tree (a level spans a range of the global order, a node is one distinct way to fill the
ranges so far) and joins the tree with itself: pairs of nodes carry the overlap of their paths, which all sets below
share, and a pair is cut as soon as its overlap plus the smaller remaining length cannot reach the required overlap.
What is left at the leaves is exact. Groups beyond `block` sets are split into pairs of blocks; from each group only a
spanning forest of its links goes on, and components are joined on Spark.

Null, empty and blank texts have no n-grams and link with nothing; a text of fewer words than n is one n-gram of all
its words. Repeated rows and ties: equal sets always link. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from ledgerloom.llm.common import blocks, connected_components, discard, sorted_groups, spanning, utf8_view, written

FACTOR = np.uint64(0x9E3779B97F4A7C15)
SLICE = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Shingler:
    """Sets of word n-grams as sorted 64-bit keys: 255 - length in the top byte, then 56 bits of a hash."""

    def __init__(self, width: int):
        self.width = width
        self.byte = mixed(np.arange(1, 257, dtype=np.uint64) * FACTOR)
        self.place = mixed(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
        self.power = self.inverse = np.ones(1, np.uint64)

    def reach(self, n: int):
        if len(self.power) <= n:
            n = max(n, SLICE) + 1
            base = np.array([int(FACTOR) | 1], np.uint64)
            inverse = np.array([pow(int(base[0]), -1, 1 << 64)], np.uint64)
            self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.repeat(base, n)]), dtype=np.uint64)
            self.inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.repeat(inverse, n)]), dtype=np.uint64)

    def sets(self, column):
        """Yields the sorted distinct keys of each row."""
        data, offsets = utf8_view(column)
        for a, b in blocks(offsets, SLICE):
            yield from self.block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])

    def block(self, data: np.ndarray, offsets: np.ndarray):
        n, width = len(offsets) - 1, self.width
        low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        word = ~((low == 32) | ((low >= 9) & (low <= 13)))
        edge = np.zeros(len(low) + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], word[:-1]]) if len(word) else word
        after = np.concatenate([word[1:], [False]]) if len(word) else word
        start = np.flatnonzero(word & (~before | edge[:-1]))
        end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.reach(len(low))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.byte[low] * self.power[: len(low)], dtype=np.uint64)])
        h = mixed((total[end] - total[start]) * self.inverse[start] + (end - start).astype(np.uint64))
        first = np.searchsorted(start, offsets)  # first word of each row
        m = max(0, len(h) - width + 1)
        gram, size = np.zeros(m, np.uint64), np.zeros(m, np.int64)
        for k in range(width):
            gram += h[k : k + m] * self.place[k]
            size += (end - start)[k : k + m]
        keys = (np.uint64(255) - np.minimum(size, 255).astype(np.uint64)) << np.uint64(56) | mixed(gram) >> np.uint64(8)
        for i in range(n):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= width:
                yield np.unique(keys[lo : hi - width + 1])
            elif hi > lo:
                short = mixed(np.array([(h[lo:hi] * self.place[: hi - lo]).sum(dtype=np.uint64) ^ np.uint64(hi - lo)]))[0]
                yield np.array([(255 - min(255, int((end - start)[lo:hi].sum()))) << 56 | int(short) >> 8], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


class Points:
    """Meeting points of sets for a threshold num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.least = [-(-num // (den - num))]  # the smallest set that can link with another one
        self.parts: list[tuple[int, int]] = []

    def instance(self, c: int) -> tuple[int, int]:
        """(parts, empty ones allowed) of class c."""
        while len(self.parts) <= c:
            low = self.least[len(self.parts)]
            top = low * self.den // self.num
            self.least.append(top + 1)
            union = 2 * top * self.den // (self.num + self.den)
            k = union * (self.den - self.num) // self.den
            e = 0
            for _ in range(4):
                empty = (k + 1 + e) * np.exp(-low / (k + 1 + e))
                e = int(np.ceil(empty + 3 * np.sqrt(empty)))
            self.parts.append((k + 1 + e, e))
        return self.parts[c]

    def of(self, s: np.ndarray) -> np.ndarray:
        if len(s) < self.least[0]:
            return np.zeros(0, np.int64)
        while self.least[-1] <= len(s):
            self.instance(len(self.parts))
        c = int(np.searchsorted(self.least, len(s), "right")) - 1
        h = (s << np.uint64(8) >> np.uint64(32)).astype(np.uint64)
        order = np.argsort(h)
        h = h[order]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(s[order]), dtype=np.uint64)])
        out = []
        for j in (c, c + 1):
            parts, spare = self.instance(j)
            cuts = np.searchsorted(h * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
            full = np.flatnonzero(cuts[1:] > cuts[:-1])
            mark = mixed((full + (j << 32) + 1).astype(np.uint64) * FACTOR)
            out.append(mixed((total[cuts[full + 1]] - total[cuts[full]]) ^ mark))
            if parts - len(full) > spare:
                out.append(mixed(s[: len(s) + 1 + (-self.num * len(s) // self.den)] ^ np.uint64(j + 1)))
        return np.concatenate(out).view(np.int64)


def tree_join(sets: list[np.ndarray], num: int, den: int, levels: int) -> np.ndarray:
    """Pairs (i, j) of the distinct non-empty sets with den * overlap >= num * union, by a self-join of their prefix tree."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    every, key = np.unique(np.concatenate(sets), return_inverse=True)
    seen = np.bincount(key)
    node = np.zeros(len(sets), np.int64)  # node of each set at the level
    pairs = np.zeros((1, 2), np.int64)
    overlap = np.zeros(1, np.int64)
    rest = size.copy()
    cuts = np.unique(np.searchsorted(np.cumsum(seen), np.linspace(0, len(key), levels + 1)[1:-1]))
    cuts = np.concatenate([[0], cuts[(cuts > 0) & (cuts < len(every))], [len(every)]])
    mark = mixed(np.arange(1, len(every) + 1, dtype=np.uint64) * FACTOR)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        inside = (key >= lo) & (key < hi)
        o, k = owner[inside], key[inside]
        content = np.zeros(len(sets), np.uint64)
        np.add.at(content, o, mark[k])
        rest = rest - np.bincount(o, minlength=len(sets))
        _, one, content = np.unique(content, return_index=True, return_inverse=True)
        grid = np.zeros((len(one), hi - lo), np.float32)
        grid[content[o], k - lo] = 1
        shared = grid @ grid.T
        child, leaf, now = np.unique(node * len(one) + content, return_index=True, return_inverse=True)
        parent = child // len(one)
        begin = np.searchsorted(parent, np.arange(parent[-1] + 2))
        least, most, left = np.full(len(child), 1 << 60), np.zeros(len(child), np.int64), np.zeros(len(child), np.int64)
        np.minimum.at(least, now, size)
        np.maximum.at(most, now, size)
        np.maximum.at(left, now, rest)
        na, nb = (begin[pairs[:, 0] + 1] - begin[pairs[:, 0]]), (begin[pairs[:, 1] + 1] - begin[pairs[:, 1]])
        made = na * nb
        which = np.repeat(np.arange(len(pairs)), made)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(made) - made, made)
        a = begin[pairs[which, 0]] + nth // nb[which]
        b = begin[pairs[which, 1]] + nth % nb[which]
        keep = a <= b
        a, b, which = a[keep], b[keep], which[keep]
        got = overlap[which] + shared[content[leaf[a]], content[leaf[b]]].astype(np.int64)
        need = num * (least[a] + least[b])  # overlap * (num + den) >= num * (|x| + |y|)
        alive = ((got + np.minimum(left[a], left[b])) * (num + den) >= need) & (den * most[a] >= num * least[b]) & (den * most[b] >= num * least[a])
        pairs, overlap, node = np.stack([a[alive], b[alive]], 1), got[alive], now
        if not len(pairs):
            return pairs
    at = np.zeros(int(node.max()) + 1, np.int64)
    at[node] = np.arange(len(sets))
    pairs = at[pairs]
    i, j = pairs[:, 0], pairs[:, 1]
    return pairs[(i != j) & (overlap * (num + den) >= num * (size[i] + size[j]))]


WORDS = 1 << 20  # words of bits in which the texts of groups are marked, at most: 64 texts a word


def among(rows: DataFrame, members: DataFrame, most: int = WORDS) -> DataFrame:
    """The rows (doc_id, text, row) without nearly all those whose `row` no member has: members set bits by their hash, and a row stays if its bit is
    set. Beyond 64 * most members fewer rows go, and none too many."""
    marks = members.select("row").distinct()
    words = F.lit(min(max(marks.count(), 1), most)).cast("long")
    place = F.struct(F.pmod(F.col("row"), words).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64("row"), F.lit(64)).cast("int")).alias("bit"))
    bits = marks.select(place.alias("at")).groupBy(F.col("at.word").alias("word")).agg(F.bit_or("at.bit").alias("bits"))
    held = rows.withColumn("at", place).join(F.broadcast(bits), F.col("at.word") == F.col("word"))
    return held.where(F.col("bits").bitwiseAND(F.col("at.bit")) != 0).select(rows.columns)


def components(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, block: int = 500, most_split: int = 100_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs (doc_id, text): two documents link when den * overlap >= num * union."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row"))

    def pointed(batches):
        shingler, points, seen = Shingler(width), Points(num, den), set()
        for batch in batches:
            n, hi, lo, met = [], [], [], []
            for s, named in zip(shingler.sets(batch.column(1)), batch.column(0).is_valid().to_pylist()):
                n.append(len(s))
                hi.append(int(mixed(s).sum(dtype=np.uint64).view(np.int64)))
                lo.append(int(mixed(s ^ FACTOR).sum(dtype=np.uint64).view(np.int64)))
                same = (n[-1], hi[-1], lo[-1])
                met.append(points.of(s) if named and same not in seen else np.zeros(0, np.int64))  # a task's copies make their points once
                if named:
                    seen.add(same)
            if len(seen) > 500_000:
                seen.clear()  # bounds the memory; points made again change nothing
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in met])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(met) if met else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), lists], ["doc_id", "row", "n", "hi", "lo", "points"])

    same = ["n", "hi", "lo"]
    pointed_sets = written(rows.mapInArrow(pointed, "doc_id long, row long, n long, hi long, lo long, points array<long>"), "points")
    sets = written(pointed_sets.select("doc_id", "row", *same), "sets")
    reps = sets.where("n > 0 and doc_id is not null").groupBy(*same).agg(F.min(F.struct("doc_id", "row")).alias("one"))
    reps = reps.select(*same, F.col("one.doc_id").alias("rep"), F.col("one.row").alias("row"))
    # one exchange; a window keeps no group in memory beyond its sorted (point, set) rows, which can spill. Sets go by a hash
    # of theirs: copies from several tasks are one, and two sets of one hash would only be compared once too often
    met = pointed_sets.where("doc_id is not null").select(F.col("hi").alias("set"), F.explode("points").alias("point"))
    at = W.partitionBy("point")
    met = met.withColumn("center", F.min("set").over(at)).withColumn("last", F.max("set").over(at)).where("center < last")
    members = met.select("center", "set").distinct().join(reps.select(F.col("hi").alias("set"), F.col("rep").alias("doc_id"), "row", "n"), "set").select("center", "doc_id", "row", "n")
    members = written(members, "members")
    discard(pointed_sets)
    # only centers beyond a block are split: at most members / block. While they are fewer than most_split, they are broadcast and
    # members stay where they are, beyond that the join shuffles
    hot = members.groupBy("center").agg(F.count(F.lit(1)).alias("met"), F.sum("n").alias("all"))
    hot = hot.select("center", F.greatest(F.ceil(F.col("met") / block), F.ceil(F.col("all") / (block * 2000))).cast("int").alias("parts")).where("parts > 1")
    hot = written(hot, "hot")
    sent = members.join(F.broadcast(hot) if hot.count() < most_split else hot, "center", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sent = sent.select("center", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "doc_id", "row")
    sent = sent.hint("merge").join(among(rows, members), ["doc_id", "row"])  # the same plan at every size
    keys = ["center", "lo", "hi"]

    def joined(batches):
        shingler = Shingler(width)
        for (_, lo, hi), group in sorted_groups(batches, 3):
            ids = group.column("doc_id").to_numpy()
            if ids.min() == ids.max():
                continue
            pairs = tree_join(list(shingler.sets(group.column("text"))), num, den, min(32, 2 + len(ids) // 8))
            if lo != hi and len(pairs):
                side = group.column("part").to_numpy()
                pairs = pairs[side[pairs[:, 0]] != side[pairs[:, 1]]]
            i, j = spanning(pairs, len(ids))
            i, j = (x[ids[i] != ids[j]] for x in (i, j))
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], ["src", "dst"])

    sent = sent.select(*keys, "part", "doc_id", "text").repartition(*keys).sortWithinPartitions(*keys)
    found = connected_components(sent.mapInArrow(joined, "src long, dst long"))
    joined_reps = reps.drop("row").join(found.withColumnRenamed("node", "rep"), "rep", "left").select(*same, F.coalesce("component", "rep").alias("component"))
    out = sets.select("doc_id", *same).join(joined_reps, same, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
