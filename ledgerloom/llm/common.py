"""Helpers shared by the training-data operators: shared scratch tables, Arrow views, exact ranks, components."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W


MADE: list[str] = []  # folders that this driver asked for, in order
LOCAL: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder (URI) that driver and executors share, below spark.checkpoint.dir.

    Where that setting is absent, a local temporary folder serves in local mode only (single-machine tests).
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not LOCAL:
            LOCAL.append(f"file://{tempfile.mkdtemp(prefix='spark-ledgerloom-')}")
        base = LOCAL[0]
    MADE.append(f"{base.rstrip('/')}/ledgerloom/{name}-{uuid.uuid4().hex}")
    return MADE[-1]


def remove(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    # shuffle files of what has been written stay until the driver collects its garbage, of which it makes no more when the data grow
    gc.collect()
    jvm.System.gc()


def sweep(spark: SparkSession, begin: int, keep: list[str]) -> None:
    """Removes the folders made from number `begin` on but `keep`: what was computed through them has been written."""
    remove(spark, [p for p in MADE[begin:] if p not in keep])
    del MADE[begin:]


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written() tables from which all that follows has been written, too."""
    for table in tables:
        remove(table.sparkSession, [table.written_to])


def utf8_view(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without copying rows into Python; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int):
    """Row ranges [a, b) of about `size` bytes each, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b
        a = b


def word_counts(column) -> np.ndarray:
    """White-space separated words of each row of an Arrow string column (white space: bytes 9 to 13 and 32)."""
    data, offsets = utf8_view(column)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    begins = ~blank
    begins[1:] &= blank[:-1]
    at = offsets[:-1][np.diff(offsets) > 0]
    begins[at] = ~blank[at]
    total = np.concatenate([[0], np.cumsum(begins)])
    return total[offsets[1:]] - total[offsets[:-1]]


def ranked(df: DataFrame, group: str, order: list, into: str, parts: int | None = None) -> DataFrame:
    """df with a gapless 0-based rank inside each `group`, without bringing a group into one task.

    Rows of a group are dealt into `parts` slices (four times the shuffle partitions, if not given) by a hash of `order`; a rank is the size of the slices before
    it (a window over groups x parts counts) plus the row number in its slice. Ties in `order` (equal rows) take
    any order among themselves. Null groups count as a group.
    """
    parts = parts or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = df.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    rows = df.withColumn("__rn", F.row_number().over(W.partitionBy(group, "__part").orderBy(*order)))
    out = rows.join(base, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    return out.withColumn(into, (F.col("__base") + F.col("__rn") - 1).cast("long")).drop("__part", "__n", "__g", "__p", "__base", "__rn")


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of `edges` (src, dst long): component is the smallest node reachable.

    Contraction rounds on Spark: every label hooks to its smallest neighbour, the hooks are followed by pointer
    doubling, edges are relabelled and inner ones drop out, so the edge table shrinks by a constant factor a round.
    Each round is written to the shared folder. No edges: no rows. Nulls and loops are ignored.
    """
    spark = edges.sparkSession
    edges = edges.where("src is not null and dst is not null and src <> dst")
    edges = written(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), name)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    labels = written(nodes.select("node", F.col("node").alias("component")), name)
    while not edges.isEmpty():
        both = edges.union(edges.select("dst", "src"))
        hook = both.groupBy("src").agg(F.min("dst").alias("to")).select(F.col("src").alias("label"), F.least("src", "to").alias("to"))
        hook = first = written(hook, name)
        for _ in range(2):
            far = hook.select(F.col("label").alias("to"), F.col("to").alias("far"))
            hook = hook.join(far, "to", "left").select("label", F.coalesce("far", "to").alias("to"))
        hook = written(hook, name)
        old = [first, hook, labels, edges]
        labels = written(labels.join(hook, labels.component == hook.label, "left").select("node", F.coalesce("to", "component").alias("component")), name)
        a, b = hook.select(F.col("label").alias("src"), F.col("to").alias("a")), hook.select(F.col("label").alias("dst"), F.col("to").alias("b"))
        moved = edges.join(a, "src").join(b, "dst").where("a <> b")
        edges = written(moved.select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct(), name)
        discard(*old)
    discard(edges)
    return spark.createDataFrame([], "node long, component long").union(labels)


def spanning(pairs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j), i > j, that join the same ones of 0..n-1 as `pairs` (k, 2): each to the least one it reaches."""
    label = np.arange(n)
    if len(pairs):
        a, b = pairs[:, 0], pairs[:, 1]
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            new = new[new]
            new = np.minimum(new, new[label])
            if (new == label).all():
                break
            label = new
    i = np.flatnonzero(label != np.arange(n))
    return i, label[i]


def sorted_groups(batches, keys: int):
    """Tables of the rows that agree in the first `keys` columns, from batches sorted by these columns. Only the group
    at hand is in memory."""
    held, held_key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            key = tuple(c[a] for c in columns)
            if held and key != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(a, b - a))
    if held:
        yield held_key, pa.Table.from_batches(held)
