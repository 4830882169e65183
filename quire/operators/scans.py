"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.catalog import query
from quire.functions import paths
from quire.sources.tables import VIEWS, blocks, documents, pages, table


@query("src_table", "SELECT doc_id, lang, source, n_chars FROM documents")
def src_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


@query("src_path", "SELECT doc_id, 'doc_' || doc_id || '.pdf' AS filename, sha256(text) AS content_hash, octet_length(encode(text)) AS byte_size FROM documents")
def src_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as they come in: name, content hash, size."""
    d = documents(spark, sf_dir)
    return d.select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), "content_hash", "byte_size")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.split(F.lit(".pdf,.PDF,.tif,.jpeg,.docx,.bmp,,.Png"), ","), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("scan"), F.col("doc_id").cast("string"), ext).alias("filename"))


_NAMES = "names AS (SELECT doc_id, 'scan' || doc_id || string_split('.pdf,.PDF,.tif,.jpeg,.docx,.bmp,,.Png', ',')[doc_id % 8 + 1] AS filename FROM documents)"


@query("src_ext_filter", f"WITH {_NAMES} SELECT doc_id, filename FROM names WHERE lower(regexp_extract(filename, '\\.[^.]+$', 0)) IN ('.pdf', '.tif', '.tiff', '.png', '.jpg', '.jpeg')")
def src_ext_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).filter(paths.accepted(F.col("filename")))


@query(
    "src_kind",
    f"""WITH {_NAMES} SELECT doc_id, CASE WHEN e = '.pdf' THEN 'pdf' WHEN e IN ('.png','.jpg','.jpeg','.tif','.tiff','.bmp','.webp') THEN 'image' ELSE 'unknown' END AS kind
    FROM (SELECT doc_id, lower(regexp_extract(filename, '\\.[^.]+$', 0)) AS e FROM names)""",
)
def src_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("doc_id", paths.kind(F.col("filename")).alias("kind"))


@query("src_pages", f"WITH {VIEWS} SELECT page_id, doc_id, page_number, lang, markdown FROM p")
def src_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir)


@query("src_blocks", f"WITH {VIEWS} SELECT block_id, page_id, doc_id, page_number, block_index, category, lang, text FROM b")
def src_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir)


@query(
    "src_artifact_md",
    f"WITH {VIEWS} SELECT page_id, CASE WHEN page_number = 1 THEN markdown END AS marked_md FROM p",
)
def src_artifact_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marked text of a page is a column; a page without one has null."""
    return pages(spark, sf_dir).select("page_id", F.when(F.col("page_number") == 1, F.col("markdown")).alias("marked_md"))


def uploaded(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files under path as (filename, content_hash, byte_size); empty files are left out."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    f = f.filter("length > 0").select(F.regexp_extract("path", "([^/]*)$", 1).alias("filename"), F.sha2("content", 256).alias("content_hash"), F.col("length").alias("byte_size"))
    return f.filter(paths.accepted(F.col("filename")))


def write_json(blocks_: DataFrame, path: str) -> None:
    blocks_.write.mode("overwrite").partitionBy("doc_id").json(path)


def write_markdown(pages_: DataFrame, path: str) -> None:
    pages_.select("page_id", "markdown").write.mode("overwrite").parquet(path)


@query("snk_json", f"WITH {VIEWS} SELECT page_id, count(*) AS n_blocks, string_agg(text, chr(10) ORDER BY block_index) AS body FROM b GROUP BY page_id")
def snk_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page's block file holds: its blocks in order."""
    p = pages(spark, sf_dir)
    return p.select("page_id", F.size(F.split("markdown", "\n", -1)).cast("long").alias("n_blocks"), F.col("markdown").alias("body"))


@query("snk_md", f"WITH {VIEWS} SELECT page_id, printf('documents/%09d/%04d/p%04d_text.md', doc_id, page_number, page_number) AS uri, markdown FROM p")
def snk_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    return p.select("page_id", F.concat(paths.page_dir(F.col("doc_id"), F.col("page_number")), F.format_string("/p%04d_text.md", "page_number")).alias("uri"), "markdown")


@query("snk_empty", f"WITH {VIEWS} SELECT page_id, false AS parse_ok, '' AS markdown FROM p WHERE page_number % 7 = 0")
def snk_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders of pages whose parsing failed."""
    return pages(spark, sf_dir).filter("page_number % 7 = 0").select("page_id", F.lit(False).alias("parse_ok"), F.lit("").alias("markdown"))


@query(
    "snk_images",
    "SELECT page_id, src AS filename FROM (SELECT page_id, unnest(regexp_extract_all(html, '<img[^>]* src=\"([^\"]*)\"', 1)) AS src FROM pages)",
)
def snk_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image references of pages, one row each."""
    found = F.regexp_extract_all("html", F.lit('<img[^>]* src="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("filename"))


@query("snk_png", f"WITH {VIEWS} SELECT page_id, 'output:///' || printf('documents/%09d/%04d/p%04d_source.png', doc_id, page_number, page_number) AS uri FROM p")
def snk_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    return p.select("page_id", paths.to_uri(paths.page_image(F.col("doc_id"), F.col("page_number"))).alias("uri"))
