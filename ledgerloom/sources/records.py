"""Sources and sinks: record files with quarantine, dictionaries, runs, reports, file identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ledgerloom.functions.text import document_id

EVIDENCE = T.ArrayType(T.StructType().add("document_id", "string").add("page", "integer").add("section", "string").add("excerpt", "string").add("chunk_id", "string"))
VALUE = T.StructType().add("kind", "string").add("numeric_value", T.DecimalType(38, 6)).add("currency", "string").add("unit", "string").add("normalized_text", "string").add("raw_text", "string")


def field_of(kind: T.DataType) -> T.StructType:
    candidates = T.ArrayType(T.StructType().add("value", kind).add("evidence", EVIDENCE))
    return T.StructType().add("status", "string").add("value", kind).add("confidence", "double").add("evidence", EVIDENCE).add("candidates", candidates).add("notes", "string")


def item(*more: tuple[str, T.DataType]) -> T.ArrayType:
    out = T.StructType().add("canonical_id", "string").add("original_name", "string").add("description", "string").add("extraction_confidence", "double").add("normalization_confidence", "double").add("evidence", EVIDENCE)
    for name, kind in more:
        out = out.add(name, kind)
    return T.ArrayType(out)


TEXTS = T.ArrayType(T.StringType())
LIMITS = item(("value", VALUE), ("applies_to", TEXTS))
TEXT_FIELD = field_of(T.StringType())
RECORD = (
    T.StructType()
    .add("policy_id", "string")
    .add("source_documents", T.ArrayType(T.StructType().add("document_id", "string").add("source_file", "string").add("sha256", "string").add("page_count", "integer").add("language", "string").add("document_type", "string").add("origin", "string")))
    .add("identification", T.StructType([T.StructField(n, TEXT_FIELD) for n in "insurer product_name susep_process policy_number insured policyholder document_version".split()]))
    .add("contractual_terms", T.StructType([T.StructField("policy_period", field_of(T.StructType().add("start", "date").add("end", "date"))), T.StructField("currency", TEXT_FIELD), T.StructField("premium", field_of(VALUE)), T.StructField("retroactive_date", field_of(T.DateType())), T.StructField("extended_reporting_period", field_of(VALUE)), *(T.StructField(n, TEXT_FIELD) for n in "geographic_scope jurisdiction coverage_trigger".split()), *(T.StructField(f"{n}_canonical", T.StringType()) for n in "geographic_scope jurisdiction coverage_trigger".split())]))
    .add("policy_limits", LIMITS)
    .add("policy_deductibles", LIMITS)
    .add("coverages", item(("category", T.StringType()), ("conditions", TEXTS), ("limits", LIMITS), ("deductibles", LIMITS)))
    .add("extensions", item(("conditions", TEXTS), ("limits", LIMITS), ("deductibles", LIMITS)))
    .add("exclusions", item(("exceptions", TEXTS), ("applies_to", TEXTS)))
    .add("definitions", T.ArrayType(T.StructType().add("canonical_term", "string").add("original_term", "string").add("definition_text", "string").add("extraction_confidence", "double").add("normalization_confidence", "double").add("evidence", EVIDENCE)))
    .add("clauses", item(("category", T.StringType()), ("summary", T.StringType()), ("conditions", TEXTS)))
    .add("extraction", T.StructType().add("schema_version", "string").add("extraction_method", "string").add("extractor_model", "string").add("extracted_at", "timestamp").add("warnings", TEXTS).add("errors", TEXTS))
)


def filled(value: Column, has: T.DataType, wanted: T.DataType) -> Column:
    """A value as one of a wider type: fields that it does not have are null, also inside arrays. A struct that is null is one of nulls, so that what is
    asked of it is seen through."""
    if isinstance(wanted, T.StructType):
        one = lambda f: filled(value[f.name], has[f.name].dataType, f.dataType) if f.name in has.fieldNames() else F.lit(None).cast(f.dataType)
        return F.struct(*(one(f).alias(f.name) for f in wanted.fields))
    if isinstance(wanted, T.ArrayType):
        return F.transform(value, lambda x: filled(x, has.elementType, wanted.elementType))
    return value.cast(wanted)


def whole(rows: DataFrame) -> DataFrame:
    """Rows that have some columns and fields of RECORD as records with all of them."""
    has = {f.name: f.dataType for f in rows.schema.fields}
    return rows.select(*((filled(F.col(f.name), has[f.name], f.dataType) if f.name in has else F.lit(None).cast(f.dataType)).alias(f.name) for f in RECORD.fields))


REQUIRED = ["policy_id", "source_documents", "identification", "contractual_terms", "extraction"]


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of JSON files that hold a bare record or one under policy_json, policy or policy_record."""
    envelope = T.StructType(list(RECORD.fields))
    for name in ("policy_json", "policy", "policy_record"):
        envelope = envelope.add(name, RECORD)
    raw = spark.read.schema(envelope.add("_corrupt", "string")).json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    whole = F.lit(True)
    for name in REQUIRED:
        whole = whole & F.col(name).isNotNull()
    bare = F.when(whole, F.struct(*(f.name for f in RECORD.fields)))
    rows = raw.select(F.coalesce("policy_json", bare, "policy", "policy_record").alias("record"), "_corrupt", F.col("_metadata.file_path").alias("path"))
    reason = F.when(F.col("_corrupt").isNotNull(), "not JSON").otherwise("no record under a known name")
    return rows.where("record is not null").select("record.*", "path"), rows.where("record is null").select("path", reason.alias("reason"))


def portfolio(records: DataFrame, portfolio_id: str) -> DataFrame:
    """members of one portfolio in path order; fewer than two give none."""
    at = W.partitionBy("portfolio_id")
    out = records.select(F.lit(portfolio_id).alias("portfolio_id"), F.col("policy_id").alias("entity_id"), "path")
    out = out.withColumn("position", F.row_number().over(at.orderBy("path"))).withColumn("n", F.count(F.lit(1)).over(at))
    return out.where("n >= 2").select("portfolio_id", "entity_id", "position")


def read_dictionary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, aliases) of JSON dictionaries, one value a category: {"category", "items": [{"id", "label", "aliases", "description"}]}. Files that do
    not state their category have it as their name."""
    item_type = T.StructType().add("id", "string").add("label", "string").add("aliases", TEXTS).add("description", "string")
    schema = T.StructType().add("category", "string").add("items", T.ArrayType(item_type))
    raw = spark.read.schema(schema).json(path, multiLine=True, recursiveFileLookup=True)
    category = F.coalesce("category", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1))
    rows = raw.select(category.alias("category"), F.posexplode("items").alias("item_order", "item"))
    items = rows.select("category", "item.id", "item.label", "item.description", "item_order")
    return items, rows.select("category", "item.id", F.posexplode_outer("item.aliases").alias("alias_order", "alias")).where("alias is not null")


def write_dictionary(items: DataFrame, path: str) -> None:
    """Items (category, item_order, id, label, aliases, description) as dictionary files, a folder and file a category. The executors write them; nothing
    passes the driver."""
    item = F.struct("item_order", F.struct("id", "label", "aliases", "description").alias("item"))
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"])
    files = items.groupBy("category").agg(listed.alias("items")).withColumn("value", F.to_json(F.struct("category", "items")))
    files.select(F.xxhash64("category").alias("file"), "value").write.partitionBy("file").option("maxRecordsPerFile", 1).text(path)


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    member = T.StructType().add("section", "string").add("field_id", "string")
    concept = T.StructType().add("id", "string").add("label", "string").add("members", T.ArrayType(member))
    raw = spark.read.schema(T.StructType().add("concepts", T.ArrayType(concept))).json(path, multiLine=True)
    rows = raw.select(F.posexplode("concepts").alias("concept_order", "c")).select("concept_order", F.col("c.id").alias("concept_id"), F.col("c.label").alias("concept_label"), F.explode("c.members").alias("m"))
    return rows.select("concept_id", "concept_label", "m.section", "m.field_id", "concept_order")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    fact = T.StructType([T.StructField(n, T.StringType()) for n in "fact_id kind path collection canonical_id expected expected_status".split()]).add("evidence_pages", T.ArrayType(T.IntegerType()))
    raw = spark.read.schema(T.StructType().add("source_id", "string").add("facts", T.ArrayType(fact))).json(path, multiLine=True)
    return raw.select("source_id", F.explode("facts").alias("f")).select("source_id", "f.*")


def parsed_responses(raw: DataFrame, text: str, schema: str) -> DataFrame:
    """Raw model responses with code fences and preambles removed, parsed with a schema; failures keep a reason."""
    body = F.regexp_replace(text, r"(?s)^.*?```(?:json)?\s*|\s*```.*$", "")
    body = F.regexp_extract(F.when(F.contains(F.col(text), F.lit("```")), body).otherwise(F.col(text)), r"(?s)[\{\[].*[\}\]]", 0)
    value = F.from_json(body, schema, {"mode": "PERMISSIVE"})
    out = raw.withColumn("parsed", value)
    first = F.col("parsed").getField(schema.split()[0])
    return out.withColumn("reason", F.when(body == "", "no JSON value").when(first.isNull(), "schema mismatch"))


def identified_files(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, path, sha256, bytes) of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(document_id(F.col("path"), F.col("content")).alias("document_id"), "path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


#: fixed values: what the pipeline takes
SUFFIXES = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp"}


def accepted_files(files: DataFrame, name: Column, size: Column) -> DataFrame:
    """files with safe, unique names, a mime type, and a reject reason."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    mime = F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv))
    out = files.withColumn("mime", F.try_element_at(mime, suffix)).withColumn("reject", F.when(size <= 0, "EMPTY").when(F.col("mime").isNull(), "UNSUPPORTED"))
    safe = F.regexp_replace(F.regexp_replace(name, "^.*/", ""), r"[^A-Za-z0-9._-]+", "_")
    out = out.withColumn("safe_name", safe)
    nth = F.row_number().over(W.partitionBy(F.lower("safe_name")).orderBy(size, name))
    stem, ext = F.regexp_replace("safe_name", r"\.[^.]*$", ""), F.regexp_extract("safe_name", r"(\.[^.]*)$", 1)
    return out.withColumn("safe_name", F.when(nth > 1, F.concat(stem, F.lit("_"), nth.cast("string"), ext)).otherwise(F.col("safe_name")))


def write_comparison(rows: DataFrame, report: DataFrame, path: str) -> None:
    """Rows as JSON, report text one folder a portfolio."""
    rows.write.mode("overwrite").partitionBy("portfolio_id").json(f"{path}/rows")
    report.select("portfolio_id", F.col("report").alias("value")).write.mode("overwrite").partitionBy("portfolio_id").text(f"{path}/report")


def write_pages(pages: DataFrame, path: str, buckets: int = 64) -> None:
    pages.withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(path)


def source_checks(manifest: DataFrame, documents: DataFrame, markers: DataFrame) -> DataFrame:
    """manifest(source, expected_docs) and markers(source, marker) against documents(source, text): counts and missing markers."""
    counts = documents.groupBy("source").agg(F.count(F.lit(1)).alias("docs"))
    held = documents.join(markers, "source").groupBy("source", "marker").agg(F.max(F.contains(F.lower("text"), F.col("marker")).cast("int")).alias("held"))
    missing = markers.join(held, ["source", "marker"], "left").groupBy("source").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.coalesce("held", F.lit(0)) == 0, F.col("marker")))), ",").alias("missing"))
    out = manifest.join(counts, "source", "left").join(missing, "source", "left").withColumn("docs", F.coalesce("docs", F.lit(0)))
    return out.withColumn("ok", (F.col("docs") == F.col("expected_docs")) & (F.coalesce("missing", F.lit("")) == ""))


#: fixed values: what is kept of a file's own description
METADATA = ["title", "author", "subject", "keywords", "creator", "producer", "creationDate", "modDate"]


def kept_metadata(metadata: Column) -> Column:
    """The known entries of a map; null gives an empty map."""
    return F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, _: k.isin(METADATA))


#: one extraction run of a document: what each stage read, what was found, what became of it
RUN = "document_id string, schema_version string, selected_chunks map<string,array<string>>, facts long, valid_claims long, total_claims long, policy_json string, warnings array<string>"
#: one evaluation of a record
EVALUATION = "policy_id string, scalar_correct long, scalar_total long, financial_correct long, financial_total long, macro_f1 double, notes array<string>"


def write_json(rows: DataFrame, path: str, schema: str, mode: str = "errorifexists") -> None:
    """Rows of runs or evaluations as JSON lines, in the columns of their schema."""
    fields = rows.sparkSession.createDataFrame([], schema).schema.fields
    rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields)).write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): lines that do not fit the schema are rejects with their text."""
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    raw = spark.read.text(path).where("value <> ''").withColumn("row", parsed)
    return raw.where("row._corrupt is null").select("row.*").drop("_corrupt"), raw.where("row._corrupt is not null").select(F.col("value").alias("line"))


def add_to_manifest(jobs: DataFrame, path: str) -> None:
    """Appends one row a processed document (job_id, document_id, source_file, sha256, pages, status) to a job manifest."""
    jobs.select("job_id", "document_id", "source_file", "sha256", "pages", "status").write.mode("append").partitionBy("status").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each job and document; a run that is repeated after a loss adds equal rows."""
    return spark.read.schema("job_id string, document_id string, source_file string, sha256 string, pages int, status string").parquet(path).distinct()
