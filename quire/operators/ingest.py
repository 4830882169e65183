"""Set-based ingest: what becomes of incoming files, given what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.catalog import query
from quire.functions import paths
from quire.operators.aggregates import canonical
from quire.sources.tables import VIEWS, documents, pages, table

V = f"WITH {VIEWS}"


def outcome(existing: Column, mode: Column, source_present: Column) -> Column:
    """What is done with a file whose content is known or not."""
    return F.when(~existing, "created").when(mode == 0, "duplicate_created").when(source_present, "duplicate").otherwise("repaired")


def scheduled(result: Column, mode: Column) -> Column:
    return F.when(result != "duplicate", "default").when(mode == 2, "repair").when(mode == 3, "redo").otherwise("none")


def ingest(files: DataFrame, existing: DataFrame) -> DataFrame:
    """files (content_hash, mode, ...) against existing documents (doc_id, content_hash, source_present).

    One row for each file: canonical_id of its content before the batch, outcome, duplicate status and schedule.
    """
    known = existing.groupBy("content_hash").agg(F.min("doc_id").alias("canonical_id"), F.min_by("source_present", "doc_id").alias("_present"))
    met = files.join(known, "content_hash", "left")
    result = outcome(F.col("canonical_id").isNotNull(), F.col("mode"), F.coalesce("_present", F.lit(False)))
    met = met.withColumn("outcome", result).drop("_present")
    status = F.when(F.col("outcome") == "created", "unique").when(F.col("outcome") == "duplicate_created", "member").when(F.col("outcome") == "repaired", "canonical")
    return met.withColumn("duplicate_status", status).withColumn("schedule", scheduled(F.col("outcome"), F.col("mode")))


@query(
    "dml_ingest",
    f"""{V}, known AS (SELECT content_hash, min(doc_id) AS c FROM d WHERE doc_id % 3 = 0 GROUP BY content_hash),
    r AS (SELECT d.doc_id, d.doc_id % 4 AS mode, known.c AS canonical_id, CASE WHEN known.c IS NULL THEN 'created' WHEN d.doc_id % 4 = 0 THEN 'duplicate_created' WHEN known.c % 2 = 0 THEN 'duplicate' ELSE 'repaired' END AS outcome
          FROM d LEFT JOIN known USING (content_hash) WHERE d.doc_id % 3 <> 0)
    SELECT doc_id, canonical_id, outcome, CASE outcome WHEN 'created' THEN 'unique' WHEN 'duplicate_created' THEN 'member' WHEN 'repaired' THEN 'canonical' END AS duplicate_status,
           CASE WHEN outcome <> 'duplicate' THEN 'default' WHEN mode = 2 THEN 'repair' WHEN mode = 3 THEN 'redo' ELSE 'none' END AS schedule FROM r""",
)
def dml_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the documents is there, the others come in; sources of even ids are still present."""
    d = documents(spark, sf_dir).select("doc_id", "content_hash")
    there = d.filter("doc_id % 3 = 0").withColumn("source_present", F.col("doc_id") % 2 == 0)
    files = d.filter("doc_id % 3 <> 0").withColumn("mode", F.col("doc_id") % 4)
    return ingest(files, there).select("doc_id", "canonical_id", "outcome", "duplicate_status", "schedule")


@query(
    "dml_schedule",
    """SELECT outcome, mode, CASE WHEN outcome <> 'duplicate' THEN 'default' WHEN mode = 2 THEN 'repair' WHEN mode = 3 THEN 'redo' ELSE 'none' END AS schedule
    FROM (SELECT unnest(['created', 'duplicate', 'repaired', 'duplicate_created']) AS outcome), (SELECT CAST(unnest(range(4)) AS INTEGER) AS mode)""",
)
def dml_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The truth table of outcome and mode."""
    t = spark.createDataFrame([(o, m) for o in ("created", "duplicate", "repaired", "duplicate_created") for m in range(4)], "outcome string, mode int")
    return t.withColumn("schedule", scheduled(F.col("outcome"), F.col("mode")))


@query("dml_group_upsert", f"{V} SELECT content_hash, min(doc_id) % 3 = 0 AS there FROM (SELECT content_hash, CASE WHEN bool_or(doc_id % 3 = 0) THEN 0 ELSE 1 END AS doc_id FROM d GROUP BY content_hash) GROUP BY content_hash")
def dml_group_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of a batch: new hashes are added, known ones stay as they are. One aggregation decides both."""
    d = documents(spark, sf_dir).select("content_hash", (F.col("doc_id") % 3 == 0).alias("old"))
    return d.groupBy("content_hash").agg(F.bool_or("old").alias("there"))


@query("dml_cleanup", "SELECT doc_id FROM documents WHERE doc_id % 10 <> 9")
def dml_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a staged batch, only complete copies are committed."""
    staged = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 10 != 9).alias("complete"))
    return staged.filter("complete").select("doc_id")


@query("src_upload", "SELECT doc_id, 'doc_' || doc_id || '.pdf' AS filename, sha256(text) AS content_hash FROM documents WHERE octet_length(encode(text)) > 0")
def src_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads: base names only, empty files rejected."""
    name = F.concat(F.lit("/tmp/up/doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    d = documents(spark, sf_dir).filter("byte_size > 0").withColumn("filename", F.regexp_extract(name, "([^/]*)$", 1))
    return d.filter(paths.accepted(F.col("filename"))).select("doc_id", "filename", "content_hash")


@query("api_documents", f"{V} SELECT d.doc_id, d.source AS filename, count(p.page_id) AS n_pages FROM d LEFT JOIN p USING (doc_id) GROUP BY d.doc_id, d.source")
def api_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of documents with page counts; pages are counted before the join."""
    n = pages(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return documents(spark, sf_dir).select("doc_id", F.col("source").alias("filename")).join(n, "doc_id", "left").select("doc_id", "filename", F.coalesce("n", F.lit(0).cast("long")).alias("n_pages"))


@query("api_document", f"{V} SELECT page_id, page_number, lang FROM p WHERE doc_id = 12")
def api_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_detail(spark, sf_dir, 12)


def document_detail(spark: SparkSession, sf_dir: str, doc_id: int) -> DataFrame:
    if table(spark, sf_dir, "documents").filter(F.col("doc_id") == doc_id).isEmpty():
        raise LookupError(f"no document {doc_id}")
    return pages(spark, sf_dir).filter(F.col("doc_id") == doc_id).select("page_id", "page_number", "lang").orderBy("page_number")


def page_detail(spark: SparkSession, sf_dir: str, doc_id: int, page_number: int) -> DataFrame:
    found = document_detail(spark, sf_dir, doc_id).filter(F.col("page_number") == page_number)
    if found.isEmpty():
        raise LookupError(f"document {doc_id} has no page {page_number}")
    return found


@query("api_page", f"{V} SELECT page_id, page_number, lang FROM p WHERE doc_id = 12 AND page_number = 1")
def api_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_detail(spark, sf_dir, 12, 1)


def groups_of(docs: DataFrame) -> DataFrame:
    return canonical(docs)
