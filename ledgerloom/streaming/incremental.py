"""Incremental processing: only new work is done, by anti-joins with what exists or a file stream with checkpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def job_ids(files: DataFrame, by: str, sha256: str) -> DataFrame:
    """(by, job_id): id of each job from its files' hashes, whatever their order, in two levels: digests of the hashes
    that begin alike (4,096 groups a job), then a digest of these."""
    hashes = F.concat_ws("\0", F.array_sort(F.collect_list(sha256)))
    parts = files.groupBy(by, F.substring(sha256, 1, 3).alias("head")).agg(F.sha2(hashes, 256).alias("digest"))
    whole = F.concat_ws("\0", F.array_sort(F.collect_list(F.concat_ws(":", "head", "digest"))))
    return parts.groupBy(by).agg(F.substring(F.sha2(whole, 256), 1, 16).alias("job_id"))


def pending(wanted: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Work items that have no result yet."""
    return wanted if force else wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def changed(stored: DataFrame, current: DataFrame, key: str, content: str) -> DataFrame:
    """Keys whose content differs from what is stored, or that are new."""
    old = stored.select(key, F.col(content).alias("__old"))
    return current.join(old, key, "left").where(~F.col(content).eqNullSafe(F.col("__old"))).drop("__old")


def duplicate_ids(records: DataFrame, key: str) -> DataFrame:
    return records.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def guarded(batch: DataFrame, earlier: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of a batch with a boolean `refused`: of the rows with one id the first (least `order`, nulls first, then by content) is taken, those after
    it are refused, and all whose id is among the ids (`id`) of earlier batches. One exchange by id, no join: an earlier id is a row before all others.
    Null ids are one id."""
    rest = [c for c in batch.columns if c not in (key, order)]
    content = [F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})] if rest else []
    rows = batch.withColumn("__earlier", F.lit(False)).unionByName(earlier.select(F.col("id").alias(key), F.lit(True).alias("__earlier")), allowMissingColumns=True)
    # dealt before the window, so that content is written out behind the exchange
    nth = F.row_number().over(W.partitionBy(key).orderBy(F.desc("__earlier"), F.asc_nulls_first(order), *content))
    return rows.repartition(key).withColumn("refused", nth > 1).where(~F.col("__earlier")).drop("__earlier")


def run_guarded(spark: SparkSession, source: str, schema: T.StructType, key: str, order: str, sink: str, checkpoint: str, max_files: int = 1000) -> None:
    """Everything new under `source` into `sink`/taken and `sink`/refused (Parquet), each id once over all runs, see guarded(). The ids that a batch takes
    are kept in `checkpoint`/ids, so a run after a restart knows them; a batch looks at those of batches before it, and its folders are written over if it
    is replayed. A checkpoint without them (of an earlier version) is not gone on with."""
    ids = T.StructType([T.StructField("id", schema[key].dataType), T.StructField("batch", T.LongType())])

    def batch(df: DataFrame, number: int) -> None:
        here = df.sparkSession
        earlier = here.read.schema(ids).parquet(f"{checkpoint}/ids").where(F.col("batch") < number) if number else here.createDataFrame([], ids)
        df = guarded(df, earlier, key, order).persist()
        taken = df.where(~F.col("refused")).drop("refused")
        for rows, path in ((taken, f"{sink}/taken"), (df.where("refused").drop("refused"), f"{sink}/refused"), (taken.select(F.col(key).alias("id")), f"{checkpoint}/ids")):
            rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        df.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_available(spark: SparkSession, source: str, schema: T.StructType, job: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, max_files: int = 1000) -> None:
    """Everything new under `source` through `job` into `sink` (Parquet). A batch id is a folder, written over if the batch
    is replayed, so a restart after a lost driver repeats nothing in the result."""

    def batch(df: DataFrame, number: int) -> None:
        job(df).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
