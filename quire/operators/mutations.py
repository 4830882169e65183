"""Mutations as plans that give the table's new rows; a caller overwrites the table or the partitions concerned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.catalog import query
from quire.sources.tables import VIEWS, blocks, page_mt, pages, table

V = f"WITH {VIEWS}"


def deleted(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """documents, pages, blocks, page_mt and block_mt without what hangs on the documents in ids; groups are kept."""
    out = {"documents": tables["documents"].join(ids, "doc_id", "left_anti"), "pages": tables["pages"].join(ids, "doc_id", "left_anti")}
    gone = tables["pages"].join(ids, "doc_id", "left_semi").select("page_id")
    for name in ("blocks", "page_mt"):
        if name in tables:
            out[name] = tables[name].join(gone, "page_id", "left_anti")
    if "block_mt" in tables:
        out["block_mt"] = tables["block_mt"].join(tables["blocks"].join(gone, "page_id", "left_semi").select("block_id"), "block_id", "left_anti")
    return out


@query("dml_delete_cascade", f"{V} SELECT block_id, page_id FROM b WHERE doc_id % 4 <> 1")
def dml_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {"documents": table(spark, sf_dir, "documents").select("doc_id"), "pages": pages(spark, sf_dir).select("doc_id", "page_id"), "blocks": blocks(spark, sf_dir).select("block_id", "page_id")}
    return deleted(t, t["documents"].filter("doc_id % 4 = 1"))["blocks"].select("block_id", "page_id")


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys that new has, and new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


@query("dml_replace_blocks", f"{V} SELECT page_id, block_index, text FROM b WHERE page_number <> 1 UNION ALL SELECT page_id, 0, 'new' FROM b WHERE page_number = 1 AND block_index = 0")
def dml_replace_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = blocks(spark, sf_dir).select("page_id", "block_index", "text")
    new = pages(spark, sf_dir).filter("page_number = 1").select("page_id", F.lit(0).alias("block_index"), F.lit("new").alias("text"))
    return replaced(old, new, ["page_id"])


@query("dml_replace_mt", f"{V} SELECT page_id, 'en' AS lang, CASE WHEN page_number = 2 THEN 'again' ELSE upper(replace(markdown, 'ß', 'ss')) END AS text FROM p UNION ALL SELECT page_id, 'fr', 'neuf' FROM p WHERE page_number = 3")
def dml_replace_mt(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = page_mt(spark, sf_dir).select("page_id", "lang", "text")
    p = pages(spark, sf_dir)
    new = p.filter("page_number = 2").select("page_id", F.lit("en").alias("lang"), F.lit("again").alias("text"))
    new = new.unionByName(p.filter("page_number = 3").select("page_id", F.lit("fr").alias("lang"), F.lit("neuf").alias("text")))
    return replaced(old, new, ["page_id", "lang"])


def latest(events: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last event's columns for each key."""
    return events.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("x")).select(*keys, "x.*")


@query("dml_stage_mark", "SELECT user_id, event_type AS stage, arg_max(value, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS detail FROM events GROUP BY user_id, event_type")
def dml_stage_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "stage").withColumn("detail", F.col("value"))
    return latest(e, ["user_id", "stage"], ["ts", "event_id"], ["detail"])


@query("dml_job_row", "SELECT user_id AS job_id, count(*) AS n_events, arg_max(event_type, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS status FROM events GROUP BY user_id")
def dml_job_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs got or created by id, with their last status."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("job_id")).agg(F.count(F.lit(1)).alias("n_events"), F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


@query("pending_work", f"{V} SELECT p.page_id FROM p WHERE page_number % 7 <> 0 AND lang <> 'en'")
def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that have no translation yet: what an idempotent stage still has to do."""
    p = pages(spark, sf_dir).select("page_id", "page_number", "lang")
    done = p.filter("page_number % 7 = 0 or lang = 'en'").select("page_id")
    return p.join(done, "page_id", "left_anti").select("page_id")




@query("snk_queue", f"{V} SELECT doc_id AS job_id, 'queued' AS status, doc_id % 4 AS mode FROM d WHERE doc_id % 4 <> 1")
def snk_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs to be enqueued: documents whose ingest schedules work. Appending them to the job table is the trigger."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), F.lit("queued").alias("status"), (F.col("doc_id") % 4).alias("mode"))
    return d.filter("mode <> 1")


@query("src_queue", f"{V} SELECT doc_id AS job_id, doc_id % 4 AS mode FROM d WHERE doc_id % 4 <> 1 AND doc_id % 3 <> 0")
def src_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that a consumer still has to run: queued, without a row in the log of finished ones."""
    done = table(spark, sf_dir, "documents").filter("doc_id % 3 = 0").select(F.col("doc_id").alias("job_id"))
    return snk_queue(spark, sf_dir).select("job_id", "mode").join(done, "job_id", "left_anti")
