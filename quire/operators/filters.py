"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.catalog import query
from quire.functions import geometry
from quire.functions import languages as L
from quire.sources.tables import VIEWS, blocks, documents, pages, table

_STATUS = "CASE doc_id % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' WHEN 3 THEN 'deleting' ELSE 'deleted' END"


def with_status(df: DataFrame) -> DataFrame:
    return df.withColumn("status", F.expr(_STATUS))


@query("prj_label", f"WITH {VIEWS} SELECT doc_id AS document_id, page_id, page_number, markdown AS context FROM p")
def prj_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select(F.col("doc_id").alias("document_id"), "page_id", "page_number", F.col("markdown").alias("context"))


@query("prj_literal", f"WITH {VIEWS} SELECT 'original' AS source, doc_id AS document_id, page_id, CAST(NULL AS VARCHAR) AS lang FROM p")
def prj_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select(F.lit("original").alias("source"), F.col("doc_id").alias("document_id"), "page_id", F.lit(None).cast("string").alias("lang"))


@query("prj_subset", f"WITH {VIEWS} SELECT block_id, block_index FROM b")
def prj_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("block_id", "block_index")


@query("prj_urls", f"WITH {VIEWS} SELECT page_id, '/ui/pages/' || page_id AS original_page_url, '/ui/pages/' || page_id || '/translation/en' AS translated_page_url FROM p")
def prj_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", *page_links(F.col("page_id"), F.lit("en")))


def page_links(page_id, lang) -> list:
    base = F.concat(F.lit("/ui/pages/"), page_id.cast("string"))
    return [base.alias("original_page_url"), F.concat(base, F.lit("/translation/"), lang).alias("translated_page_url")]


@query("prj_coalesce", f"WITH {VIEWS} SELECT block_id, coalesce(CASE WHEN block_index % 3 = 0 THEN NULL ELSE text END, '') AS text FROM b")
def prj_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("block_index") % 3 != 0, F.col("text"))
    return blocks(spark, sf_dir).select("block_id", F.coalesce(t, F.lit("")).alias("text"))


@query("flt_pk", "SELECT doc_id, lang, source FROM documents WHERE doc_id = 7")
def flt_pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_key(table(spark, sf_dir, "documents"), "doc_id", 7).select("doc_id", "lang", "source")


def by_key(df: DataFrame, key: str, value: int) -> DataFrame:
    return df.filter(F.col(key) == value)


@query("flt_eq", "SELECT doc_id, lang FROM documents WHERE source = 'src3'")
def flt_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("source = 'src3'").select("doc_id", "lang")


@query("flt_and", f"WITH {VIEWS} SELECT page_id, markdown FROM p WHERE doc_id = 42 AND page_number = 1")
def flt_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).filter("doc_id = 42 and page_number = 1").select("page_id", "markdown")


@query("flt_status", f"SELECT doc_id, {_STATUS} AS status FROM documents WHERE {_STATUS} NOT IN ('deleting', 'deleted')")
def flt_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_status(table(spark, sf_dir, "documents").select("doc_id")).filter(~F.col("status").isin("deleting", "deleted"))


@query("flt_any_text", "SELECT doc_id, coalesce(bool_or(text <> ''), false) AS has_text FROM conv GROUP BY doc_id".replace("conv", "(SELECT conv_id AS doc_id, text FROM conversations)"))
def flt_any_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.coalesce(F.bool_or(F.col("text") != ""), F.lit(False)).alias("has_text"))


@query("flt_all_img", f"WITH {VIEWS} SELECT doc_id, count(*) > 0 AND bool_and(CASE WHEN page_number % 4 = 0 THEN '' ELSE 'x' END <> '') AS done FROM p GROUP BY doc_id")
def flt_all_img(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = F.when(F.col("page_number") % 4 == 0, "").otherwise("x")
    return pages(spark, sf_dir).groupBy("doc_id").agg(((F.count(F.lit(1)) > 0) & F.bool_and(uri != "")).alias("done"))


@query("flt_same_lang", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'skipped' ELSE 'pending' END AS mt_status, CASE WHEN lang = 'en' THEN 'source language equals target' END AS reason FROM documents")
def flt_same_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = L.language_key(F.col("lang")) == "en"
    return table(spark, sf_dir, "documents").select("doc_id", F.when(same, "skipped").otherwise("pending").alias("mt_status"), F.when(same, "source language equals target").alias("reason"))


@query("flt_minlen", f"WITH {VIEWS} SELECT block_id FROM b WHERE length(text) >= 20")
def flt_minlen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).filter(F.length("text") >= 20).select("block_id")


@query("flt_small_img", "SELECT vec_id, len(list_filter(list_transform(range(8), lambda i: CAST(vec_id % 50 + i * 40 AS DOUBLE)), lambda s: s * s / (2481.0 * 3508.0) > 0.002)) AS kept FROM embeddings")
def flt_small_img(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.col("vec_id") % 50 + i * 40).cast("double"))
    kept = F.filter(sides, lambda s: s * s / F.lit(2481.0 * 3508.0) > geometry.SMALL_IMAGE)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(kept).cast("long").alias("kept"))


@query("flt_bbox_valid", "SELECT vec_id FROM embeddings WHERE vec_id % 6 = 4")
def flt_bbox_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose box has four numbers."""
    bbox = F.slice(F.array(*map(F.lit, range(6))), 1, (F.col("vec_id") % 6).cast("int"))
    return table(spark, sf_dir, "embeddings").filter(F.size(bbox) == 4).select("vec_id")


@query("flt_blank", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS kept FROM documents")
def flt_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.filter(F.split("text", "\n", -1), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(kept).cast("long").alias("kept"))


@query("json_get", "SELECT event_id, json_extract_string(props, '$.k') AS v FROM events")
def json_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("v"))


@query("json_first_key", "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN 'a' || doc_id WHEN doc_id % 3 = 1 THEN '' END, ''), nullif(lang, 'fr'), source) AS uri FROM documents")
def json_first_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a"), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 3 == 1, "")
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.nullif(first, F.lit("")), F.nullif("lang", F.lit("fr")), "source").alias("uri"))


@query("json_merge", "SELECT doc_id, 'pdf' AS input_kind, lang AS language, CASE WHEN doc_id % 2 = 0 THEN 'kept' ELSE 'new' END AS stage FROM documents")
def json_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata maps: set a key, and set another one only where it is missing."""
    old = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("stage"), F.lit("kept"), F.lit("input_kind"), F.lit("image"))).otherwise(F.create_map(F.lit("input_kind"), F.lit("image")))
    new = set_key(set_key(set_default(old, "stage", F.lit("new")), "input_kind", F.lit("pdf")), "language", F.col("lang"))
    m = table(spark, sf_dir, "documents").select("doc_id", new.alias("m"))
    return m.select("doc_id", m["m"]["input_kind"].alias("input_kind"), m["m"]["language"].alias("language"), m["m"]["stage"].alias("stage"))


def set_key(m, key: str, value):
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(F.lit(key), value))


def set_default(m, key: str, value):
    return F.when(F.map_contains_key(m, key), m).otherwise(set_key(m, key, value))


SCOPES, LEVELS, TARGETS = ("original", "mt", "both"), ("block", "page"), ("all", "original", "page_mt", "block_mt", "block_original")


def check_search(q: str, scope: str, level: str, limit: int, most: int = 50) -> None:
    if len(q) < 1:
        raise ValueError("q must not be empty")
    if scope not in SCOPES or level not in LEVELS:
        raise ValueError(f"no such scope or level: {scope}, {level}")
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be 1 to {most}")


def check_mode(mode: int) -> None:
    if mode not in (0, 1, 2, 3):
        raise ValueError("mode must be 0 to 3")


@query("val_params", "SELECT doc_id, doc_id % 6 BETWEEN 0 AND 3 AS mode_ok, doc_id BETWEEN 1 AND 50 AS limit_ok FROM documents")
def val_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", (F.col("doc_id") % 6).between(0, 3).alias("mode_ok"), F.col("doc_id").between(1, 50).alias("limit_ok"))
