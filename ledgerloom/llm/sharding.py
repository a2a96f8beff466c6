"""Sharding by best-fit-decreasing bin packing of indivisible groups into fixed-capacity shards.

Rows with the same group key stay together. Groups enter shards from the largest to the smallest, each into the shard
with the tightest remaining capacity that still fits, which a balanced tree over the remaining capacities finds; where
none fits, a new shard opens. Groups of one size class are interchangeable, and after a placement the same shard is
still the tightest that fits until it is full, so the plan needs only the histogram of size classes: a run of equal
groups goes into one shard in one step. Sizes below 65,536 bytes are classes of their own; above, a class spans at most
1/4,096 of its size and counts as its upper end. So at most 65,536 + 4,096 x 47 classes reach the driver, whatever the
corpus. Rows learn their shard from the rank of their group in its class by a join on (class, block of ranks).

Groups no capacity fits (larger than it) get a shard of their own. Null text is one group, empty text another; ties in
size go by key. An empty table gives an empty result. Extra columns are kept, result columns are overwritten.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import ranked, written

EXACT, BITS = 1 << 16, 12
RUN = 4096


def size_class(size):
    """Upper end of a size's class, as a column."""
    shift = F.greatest(F.length(F.bin(size)) - (BITS + 1), F.lit(0))
    step = F.pow(F.lit(2.0), shift).cast("long")
    return F.when(size < EXACT, size).otherwise(F.ceil(size / step).cast("long") * step)


class Tree:
    """Balanced search tree (randomised priorities, fixed seed) of (remaining capacity, shard)."""

    def __init__(self):
        self.root, self.rng = None, np.random.default_rng(7)

    def insert(self, key):
        less, more = self.split(self.root, key)
        self.root = self.merge(self.merge(less, [key, self.rng.random(), None, None]), more)

    def take(self, size):
        """Removes and returns the least (remaining, shard) with remaining >= size, or None."""
        less, more = self.split(self.root, (size, -1))
        if more is None:
            self.root = less
            return None
        path, node = [], more
        while node[2] is not None:
            path.append(node)
            node = node[2]
        if path:
            path[-1][2] = node[3]
        else:
            more = node[3]
        self.root = self.merge(less, more)
        return node[0]

    def split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[3], more = self.split(node[3], key)
            return node, more
        less, node[2] = self.split(node[2], key)
        return less, node

    def merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self.merge(a[3], b)
            return a
        b[2] = self.merge(a, b[2])
        return b


def best_fit(histogram: list[tuple[int, int]], capacity: int, shards: int | None = None) -> tuple[list[tuple[int, int, int, int]], int]:
    """(runs, number of shards): runs are (class, first rank, ranks, shard). With `shards`, stops beyond that number."""
    tree, runs, n = Tree(), [], 0
    for size, count in sorted(histogram, reverse=True):
        rank = 0
        while rank < count:
            got = tree.take(size)
            if got is None:
                if shards is not None and n >= shards:
                    return runs, n + 1
                got, n = (max(capacity, size), n), n + 1
            k = min(count - rank, got[0] // size) if size else count - rank
            runs.append((size, rank, k, got[1]))
            tree.insert((got[0] - k * size, got[1]))
            rank += k
    return runs, n


def least_capacity(histogram: list[tuple[int, int]], shards: int) -> int:
    """A capacity with which the packing needs at most `shards` shards, minimal to one part in 2**20 of the total."""
    total, largest = sum(s * c for s, c in histogram), max((s for s, _ in histogram), default=1)
    lo = max(largest, -(-total // shards))
    if best_fit(histogram, lo, shards)[1] <= shards:
        return lo
    hi = lo + largest + -(-total // shards)
    while hi - lo > max(1, total >> 20):
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if best_fit(histogram, mid, shards)[1] <= shards else (mid, hi)
    return hi


def even_runs(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Runs for `shards` shards of near equal size. A group above the even share fills a shard alone; the others share
    the rest, at the least capacity that suffices for them."""
    rest, left, alone, used = dict(histogram), sum(s * c for s, c in histogram), [], {}
    for size in sorted(rest, reverse=True):
        while rest[size] and len(alone) < shards - 1 and size * (shards - len(alone)) > left:
            alone.append((size, used.get(size, 0), 1, shards - 1 - len(alone)))
            rest[size], left, used[size] = rest[size] - 1, left - size, used.get(size, 0) + 1
    small = [(s, c) for s, c in rest.items() if c]
    runs, _ = best_fit(small, least_capacity(small, shards - len(alone)))
    return alone + [(s, a + used.get(s, 0), k, shard) for s, a, k, shard in runs]


def pack_shards(rows: DataFrame, key: str, size: str, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """rows with `shard` and `slot` (gapless from 0 in each shard). Give the number of shards (the capacity is then the
    least that suffices) or the capacity (then the number of shards is what the packing needs)."""
    rows = rows.drop("shard", "slot")
    groups = rows.groupBy(key).agg(F.sum(size).alias("__bytes")).withColumn("__class", size_class(F.col("__bytes")))
    groups = written(ranked(groups, "__class", [key], "__rank"), "groups")
    histogram = [(r["__class"], r["n"]) for r in groups.groupBy("__class").agg(F.count(F.lit(1)).alias("n")).collect()]
    runs = best_fit(histogram, capacity)[0] if capacity else even_runs(histogram, shards or 1)
    spark = rows.sparkSession
    # the plan is small by the bound on classes; a run over several blocks of ranks is listed in each
    plan = [(s, a, a + k, shard) for s, a, k, shard in runs]
    plan = spark.createDataFrame(plan, "__class long, __from long, __to long, shard int")
    plan = plan.withColumn("__block", F.explode(F.expr(f"sequence(__from div {RUN}, (__to - 1) div {RUN})")))
    placed = groups.withColumn("__block", F.expr(f"__rank div {RUN}")).join(plan, ["__class", "__block"]).where("__rank >= __from and __rank < __to")
    placed = placed.select(F.col(key).alias("__key"), "shard")
    out = rows.join(placed, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")
    return ranked(written(out, "placed"), "shard", [c for c in ("doc_id", key) if c in rows.columns], "slot")
