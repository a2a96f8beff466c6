"""Store of ingested documents: headers, pages and chunks in tables bucketed by document.

Joins and groups by document of a store's tables need no exchange, and the rows of one document are read from one bucket of each table. The catalog
is not needed to find a store again: its folder holds what each table is made of, written last, so that a folder without it is a write
that did not end.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.operators import pages as P

KEY = "document_id"
#: order of the rows of a document in each table
ORDER = {"documents": [], "pages": ["page_number"], "chunks": ["page_number", "chunk_index"]}
#: what is said of a page without text, of one with little, and of a document; the number of pages is put before the last two
MESSAGES = {"EMPTY": "no text on this page", "LOW_TEXT": "very little text on this page", "recovered": "page(s) taken from a second reading", "unresolved": "page(s) with little or no text"}


def page_warnings(status: Column, messages: dict[str, str] = MESSAGES) -> Column:
    """What is said of a page by its status; an empty array for a page with text or without status."""
    said = [F.when(status == kind, F.lit(messages[kind])) for kind in ("EMPTY", "LOW_TEXT")]
    return F.array_compact(F.array(*said))


def document_warnings(given: Column, recovered: Column, unresolved: Column, messages: dict[str, str] = MESSAGES) -> Column:
    """Warnings of a document: those it came with, then how many pages were recovered and how many are still poor. Each text once, where it
    stood first; null counts as none."""
    counted = lambda n, kind: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {messages[kind]}")))
    own = F.array_compact(F.array(counted(recovered, "recovered"), counted(unresolved, "unresolved")))
    return F.array_distinct(F.concat(F.array_compact(F.coalesce(given, F.array().cast("array<string>"))), own))


def cleaned(pages: DataFrame, ratio: float = 0.6, least: int = 3, low: int = 80) -> DataFrame:
    """Raw pages (document_id, page_number, raw_text, and where known text_origin and document_warnings, the same on all pages of a document)
    without repeated margins, with status, warnings and hash. A page without any line stays, with empty text. Page numbers of a
    document are distinct."""
    for name, kind in (("text_origin", "string"), ("document_warnings", "array<string>")):
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast(kind))
    given = pages.select(*P.PAGE, F.coalesce("raw_text", F.lit("")).alias("raw_text"), F.coalesce("text_origin", F.lit("NATIVE")).alias("text_origin"), "document_warnings")
    lines = P.page_lines(given)
    kept = P.without_margins(lines, P.repeated_margins(lines, given, ratio=ratio, least=least))
    none = F.array().cast("array<string>")
    rows = given.join(kept, P.PAGE, "left").withColumns({"clean_text": F.coalesce("clean_text", F.lit("")), "removed_lines": F.coalesce("removed_lines", none)})
    status = P.page_status(F.col("clean_text"), low)
    return rows.withColumns({"status": status, "warnings": page_warnings(status), "sha256": F.sha2("clean_text", 256)})


def headers(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row a document: pages by status, characters, number of chunks, its repeated margin lines in the order of their letters, warnings. The
    lines are a small set: each stands in the margins of most pages."""
    poor, second = F.col("status").isin("LOW_TEXT", "EMPTY"), F.col("text_origin") != "NATIVE"
    parts = pages.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("page_count"),
        F.count_if(~poor & ~second).alias("native_pages"),
        F.count_if(~poor & second).alias("recovered_pages"),
        F.count_if(F.col("status") == "LOW_TEXT").alias("low_pages"),
        F.count_if(F.col("status") == "EMPTY").alias("empty_pages"),
        F.sum(F.length("raw_text")).alias("raw_chars"),
        F.sum(F.length("clean_text")).alias("clean_chars"),
        F.first("document_warnings", ignorenulls=True).alias("given"),
    )
    margins = pages.select(KEY, F.explode("removed_lines").alias("line")).groupBy(KEY).agg(F.collect_set("line").alias("m"))
    counted = chunks.groupBy(KEY).agg(F.count(F.lit(1)).alias("chunk_count"))
    out = parts.join(margins, KEY, "left").join(counted, KEY, "left")
    by_letters = F.array_sort(F.transform(F.coalesce("m", F.array().cast("array<string>")), lambda x: F.struct(F.lower(x).alias("key"), x.alias("line"))))
    said = document_warnings(F.col("given"), F.col("recovered_pages"), F.col("low_pages") + F.col("empty_pages"))
    return out.withColumns({"chunk_count": F.coalesce("chunk_count", F.lit(0)), "margin_lines": F.transform(by_letters, lambda x: x["line"]), "warnings": said}).drop("given", "m")


def table_name(path: str, name: str) -> str:
    return f"ledgerloom_{name}_{hashlib.md5(path.encode()).hexdigest()}"


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.hash(KEY), F.lit(buckets))


def saved(df: DataFrame, path: str, name: str, buckets: int, spread: int) -> DataFrame:
    """df in `buckets` buckets by document of `spread` files at most, so that up to `spread` tasks write the rows of one document; read again."""
    order = ORDER.get(name, [])
    rows = df.repartition(buckets * spread, bucket_of(buckets), F.pmod(F.xxhash64(*order), F.lit(spread)) if order else F.lit(0))
    rows.write.bucketBy(buckets, KEY).sortBy(KEY, *order).option("path", f"{path}/{name}").saveAsTable(table_name(path, name))
    return df.sparkSession.table(table_name(path, name))


def ingest(pages: DataFrame, path: str, buckets: int = 64, spread: int = 4, size: int = 3000, overlap: int = 250, back: int = 500, **margins) -> dict[str, DataFrame]:
    """Writes a store of raw pages (see cleaned()) to `path`, a new folder, and opens it. Chunks are cut from the pages as written, and headers counted from
    both without an exchange. Pages without document_id or page_number are kept apart, as `rejects`. A lost write leaves no list of
    tables and is not opened."""
    spark = pages.sparkSession
    whole = F.col(KEY).isNotNull() & F.col("page_number").isNotNull()
    pages.where(~whole).write.parquet(f"{path}/rejects")
    made = {"pages": saved(cleaned(pages.where(whole), **margins), path, "pages", buckets, spread)}
    cut = P.chunks(made["pages"], size=size, overlap=overlap, back=back)
    made["chunks"] = saved(cut.withColumn("sha256", F.sha2("text", 256)), path, "chunks", buckets, spread)
    made["documents"] = saved(headers(made["pages"], made["chunks"]), path, "documents", buckets, 1)
    about = []
    for name, df in made.items():
        sizes = df.groupBy(bucket_of(buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("fullest"))
        about.append(sizes.select(F.lit(name).alias("name"), F.lit(buckets).alias("buckets"), F.lit(df.schema.toDDL()).alias("columns"), "rows", "fullest"))
    about[0].unionByName(about[1]).unionByName(about[2]).coalesce(1).write.json(f"{path}/about")
    return opened(spark, path)


def opened(spark: SparkSession, path: str, skew: float = 8.0, task_rows: int = 2_000_000) -> dict[str, DataFrame]:
    """The tables of a store, and its rejects. Bucketed, so that joins by document need no exchange, unless some bucket holds more than `task_rows` rows and
    more than `skew` times its share: then plainly, so that joins exchange and the adaptive planner can split what one document fills. The rows
    are the same."""
    about = spark.read.schema("name string, buckets int, columns string, rows long, fullest long").json(f"{path}/about").collect()  # one row a table
    even = all(t.fullest <= task_rows or t.fullest * t.buckets <= skew * t.rows for t in about)
    out = {"rejects": spark.read.parquet(f"{path}/rejects")}
    for t in about:
        if not even:
            out[t.name] = spark.read.schema(t.columns).parquet(f"{path}/{t.name}")
            continue
        name, order = table_name(path, t.name), ", ".join([KEY, *ORDER.get(t.name, [])])
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({t.columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({order}) INTO {t.buckets} BUCKETS LOCATION '{path}/{t.name}'")
        out[t.name] = spark.table(name)
    return out


def join_by_buckets(spark: SparkSession) -> None:
    """For the session: joins on document and page, or document and chunk, stay in the buckets by document, too. Without it they do so only when the
    document is their only key. It is the caller's to set, for it holds for all joins of the session whose keys begin with those of a partitioning
    that is there already."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def page(store: dict[str, DataFrame], document_id, page_number: int) -> DataFrame:
    """One page of a document; of the table, one bucket is read."""
    return store["pages"].where((F.col(KEY) == F.lit(document_id)) & (F.col("page_number") == page_number))


def chunks_by_page(store: dict[str, DataFrame], wanted: DataFrame | None = None) -> DataFrame:
    """Chunks beside the status and warnings of their page, all or those of wanted (document_id, page_number). The store's tables meet bucket by bucket."""
    pages = store["pages"].select(*P.PAGE, "status", "warnings")
    if wanted is not None:
        pages = pages.join(wanted.select(*P.PAGE).distinct(), P.PAGE, "left_semi")
    return pages.join(store["chunks"], P.PAGE)
