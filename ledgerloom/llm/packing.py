"""Packing into optimal length buckets and token-budget batches.

The global histogram of lengths (rows, tokens and largest length of each length class) comes to the driver, where
dynamic programming picks the `buckets` upper boundaries with the least padding in total: best[k][j] is the least
padding of the first j classes in k buckets. Lengths below 2,048 are classes of their own and the choice is then exactly
optimal; above, a class spans at most 1/256 of its length, so at most 2,048 + 256 x 53 classes exist for any corpus.
Each row is padded to its bucket's boundary; inside a bucket, budget // boundary rows (one at least) form a batch, in
an order that a hash of doc_id decides, with gapless slots and only the last batch not full.

Null and empty texts have length 0 and go to the first bucket. Repeated rows take slots of their own. An empty table
gives an empty result. Extra columns are kept, result columns are overwritten. A row longer than the budget is a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import ranked, word_counts, written

EXACT, BITS = 1 << 11, 8


def length_class(n):
    step = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(n)) - (BITS + 1), F.lit(0))).cast("long")
    return F.when(n < EXACT, n).otherwise(F.ceil(n / step).cast("long") * step)


def boundaries(longest: np.ndarray, rows: np.ndarray, tokens: np.ndarray, buckets: int) -> list[int]:
    """Upper boundaries with the least total padding, from classes in ascending order."""
    n = len(longest)
    count, total = np.concatenate([[0], np.cumsum(rows)]).astype(float), np.concatenate([[0], np.cumsum(tokens)]).astype(float)
    best = np.full(n + 1, np.inf)
    best[0] = 0
    cuts = []
    for _ in range(min(buckets, n)):
        now, cut = best.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):
            cost = best[:j] + longest[j - 1] * (count[j] - count[:j]) - (total[j] - total[:j])
            i = int(cost.argmin())
            if cost[i] < now[j]:
                now[j], cut[j] = cost[i], i
        best = now
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        if cut[j] >= 0:
            out.append(int(longest[j - 1]))
            j = int(cut[j])
    return sorted(out)


def with_words(docs: DataFrame, into: str = "n_tokens") -> DataFrame:
    """docs (doc_id, text, ...) with the number of white-space separated words instead of the text."""
    plain = docs.drop(into)
    names = plain.columns

    def counted(batches):
        for batch in batches:
            columns = [c for c, name in zip(batch.columns, names) if name != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(word_counts(batch.column(names.index("text"))), pa.int64())], [*(n for n in names if n != "text"), into])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in plain.schema.fields if f.name != "text")
    return plain.mapInArrow(counted, f"{fields}{into} long")


def pack(rows: DataFrame, length: str = "n_tokens", buckets: int = 16, budget: int = 65536) -> DataFrame:
    """rows (doc_id, `length`, ...) with bucket, bucket_len, batch (number in its bucket), slot (place in the batch)."""
    rows = written(rows.drop("bucket", "bucket_len", "batch", "slot").withColumn("__class", length_class(F.col(length))), "lengths")
    classes = rows.groupBy("__class").agg(F.count(F.lit(1)).alias("rows"), F.sum(length).alias("tokens"), F.max(length).alias("longest")).orderBy("__class").toPandas()
    ends = boundaries(classes["longest"].to_numpy(), classes["rows"].to_numpy(), classes["tokens"].to_numpy(), buckets) or [0]
    bucket, end = F.lit(len(ends) - 1), F.lit(ends[-1])
    for i in range(len(ends) - 2, -1, -1):
        bucket, end = F.when(F.col(length) <= ends[i], i).otherwise(bucket), F.when(F.col(length) <= ends[i], ends[i]).otherwise(end)
    rows = rows.drop("__class").withColumn("bucket", bucket).withColumn("bucket_len", end.cast("long"))
    rows = ranked(rows, "bucket", ["doc_id", length], "slot")
    fit = F.greatest(F.floor(F.lit(budget) / F.greatest("bucket_len", F.lit(1))), F.lit(1)).cast("long")
    return rows.withColumn("batch", F.floor(F.col("slot") / fit).cast("long")).withColumn("slot", (F.col("slot") % fit).cast("long"))
