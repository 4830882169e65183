"""Table scans, and the views of documents, pages, blocks and translations that are derived from raw texts.

A document's lines are its blocks, ten blocks make a page, and the stub translation of a text is its upper case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_PER_PAGE = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "text", "lang", "source", F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("byte_size"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("block_index", "text"))
    page = F.floor(F.col("block_index") / LINES_PER_PAGE).cast("int") + 1
    return lines.select(
        (F.col("doc_id") * 100000000 + F.col("block_index")).alias("block_id"),
        (F.col("doc_id") * 10000000 + page).alias("page_id"),
        "doc_id",
        page.alias("page_number"),
        "block_index",
        F.when(F.col("block_index") == 0, "Title").otherwise("Text").alias("category"),
        "lang",
        "text",
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages sliced from the text's lines within the row: no shuffle gathers them."""
    d = table(spark, sf_dir, "documents")
    d = d.select("doc_id", "lang", F.split("text", "\n", -1).alias("lines"))
    numbers = F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / LINES_PER_PAGE).cast("int"))
    p = d.select("doc_id", "lang", F.explode(F.transform(numbers, lambda n: F.struct((n + 1).alias("page_number"), F.slice("lines", n * LINES_PER_PAGE + 1, LINES_PER_PAGE).alias("part")))).alias("x"))
    return p.select(
        (F.col("doc_id") * 10000000 + F.col("x.page_number")).alias("page_id"),
        "doc_id",
        F.col("x.page_number").alias("page_number"),
        "lang",
        F.array_join("x.part", "\n").alias("markdown"),
    )


def page_mt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", "doc_id", "page_number", F.lit("en").alias("lang"), F.upper("markdown").alias("text"), F.lit("stub").alias("model"))


def block_mt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select(
        F.col("block_id").alias("block_mt_id"), "block_id", "page_id", "doc_id", "page_number", "block_index", F.lit("en").alias("lang"), F.upper("text").alias("text"), F.lit("stub").alias("model")
    )


#: The same views as SQL: d (documents), b (blocks), p (pages).
VIEWS = """
d AS (SELECT doc_id, text, lang, source, sha256(text) AS content_hash, octet_length(encode(text)) AS byte_size FROM documents),
lines AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS text,
                 CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS block_index FROM documents),
b AS (SELECT doc_id * 100000000 + block_index AS block_id, doc_id * 10000000 + block_index // 10 + 1 AS page_id, doc_id,
             CAST(block_index // 10 + 1 AS INTEGER) AS page_number, block_index,
             CASE WHEN block_index = 0 THEN 'Title' ELSE 'Text' END AS category, lang, text FROM lines),
p AS (SELECT page_id, doc_id, page_number, any_value(lang) AS lang, string_agg(text, chr(10) ORDER BY block_index) AS markdown
      FROM b GROUP BY page_id, doc_id, page_number)
"""
