"""Sorting, limits, window-shaped behaviour and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.catalog import query
from quire.sources.tables import VIEWS, blocks, documents, pages, table

V = f"WITH {VIEWS}"


@query("top_page", f"{V} SELECT page_id, doc_id, page_number FROM p ORDER BY doc_id DESC, page_number LIMIT 50")
def top_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", "doc_id", "page_number").orderBy(F.desc("doc_id"), "page_number").limit(50)


@query("top_block_mt", f"{V} SELECT block_id, doc_id, page_number, upper(replace(text, 'ß', 'ss')) AS text FROM b ORDER BY doc_id DESC, page_number, block_id LIMIT 50")
def top_block_mt(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir).select("block_id", "doc_id", "page_number", F.upper("text").alias("text"))
    return b.orderBy(F.desc("doc_id"), "page_number", "block_id").limit(50)


@query("top_block", f"{V} SELECT block_id, doc_id, page_number FROM b ORDER BY doc_id DESC, page_number, block_id LIMIT 50")
def top_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("block_id", "doc_id", "page_number").orderBy(F.desc("doc_id"), "page_number", "block_id").limit(50)


@query("sort_pages", f"{V} SELECT page_id, page_number FROM p WHERE doc_id = 3 ORDER BY page_number")
def sort_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).filter("doc_id = 3").select("page_id", "page_number").orderBy("page_number")


@query("sort_blocks", f"{V} SELECT block_id, block_index FROM b WHERE page_id = 30001 ORDER BY block_index")
def sort_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).filter("page_id = 30001").select("block_id", "block_index").orderBy("block_index")


_ORDER = "CASE WHEN block_index % 3 = 0 THEN NULL ELSE (block_index * 7) % 10 END"


@query("sort_reading", f"{V} SELECT block_id, row_number() OVER (PARTITION BY page_id ORDER BY {_ORDER} NULLS LAST, block_index) AS place FROM b")
def sort_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("page_id").orderBy(F.col("o").asc_nulls_last(), "block_index")
    return blocks(spark, sf_dir).withColumn("o", F.expr(_ORDER)).select("block_id", F.row_number().over(w).cast("long").alias("place"))


def markdown_key(order, bbox):
    """Reading order first; blocks without it by their corner, top to bottom."""
    return F.struct(order.isNull().cast("int").alias("class"), F.coalesce(order, F.get(bbox, F.lit(1)) * 100000 + F.get(bbox, F.lit(0))).alias("k"))


@query("sort_md", f"{V} SELECT block_id, row_number() OVER (PARTITION BY page_id ORDER BY {_ORDER} IS NULL, coalesce({_ORDER}, (100 - block_index) * 100000 + 5), block_id) AS place FROM b")
def sort_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    bbox = F.array(F.lit(5), 100 - F.col("block_index"))
    w = Window.partitionBy("page_id").orderBy(markdown_key(F.col("o"), bbox), "block_id")
    return blocks(spark, sf_dir).withColumn("o", F.expr(_ORDER)).select("block_id", F.row_number().over(w).cast("long").alias("place"))


@query("sort_marked", f"{V} SELECT block_id, CASE WHEN block_index % 4 < 2 THEN block_index WHEN block_index % 4 = 2 THEN block_index * 100000 + 7 ELSE 999999 END AS k FROM b")
def sort_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("block_index")
    number, bbox = F.when(i % 4 < 2, i), F.when(i % 4 == 2, F.array(F.lit(7), i))
    return blocks(spark, sf_dir).select("block_id", marked_key(number, bbox).alias("k"))


def marked_key(number, bbox):
    return F.coalesce(number, F.get(bbox, F.lit(1)) * 100000 + F.get(bbox, F.lit(0)), F.lit(999999))


@query("lim_one", f"{V} SELECT content_hash, min(doc_id) AS doc_id FROM d GROUP BY content_hash HAVING count(*) > 1")
def lim_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")


@query("lim_global", f"{V} SELECT doc_id FROM d ORDER BY byte_size DESC, doc_id LIMIT 20")
def lim_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).orderBy(F.desc("byte_size"), "doc_id").limit(20).select("doc_id")


@query("sort_langs", "SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY source")
def sort_langs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("win_canonical_flag", f"{V} SELECT doc_id, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) = 1 AS is_canonical FROM d")
def win_canonical_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("content_hash").orderBy("doc_id")
    return documents(spark, sf_dir).select("doc_id", (F.row_number().over(w) == 1).alias("is_canonical"))


def keep_first(hits: DataFrame, keys: list[str], arrival: list) -> DataFrame:
    """The first hit of each key in order of arrival."""
    w = Window.partitionBy(*keys).orderBy(*arrival)
    return hits.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


@query("win_keep_first", f"{V} SELECT doc_id, page_number, min(block_id) AS block_id FROM b GROUP BY doc_id, page_number")
def win_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_first(blocks(spark, sf_dir).select("doc_id", "page_number", "block_id"), ["doc_id", "page_number"], ["block_id"])


@query("win_enumerate", "SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS block_index FROM documents")
def win_enumerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("block_index", "_")).drop("_")


@query("win_order_check", f"{V} SELECT page_id, coalesce(bool_and(o > prev) FILTER (prev IS NOT NULL), true) AS ok FROM (SELECT page_id, o, lag(o) OVER (PARTITION BY page_id ORDER BY block_index) AS prev FROM (SELECT page_id, block_index, CASE WHEN page_id % 3 = 0 THEN block_index ELSE (block_index * 7) % 10 END AS o FROM b) WHERE block_index % 4 <> 1) GROUP BY page_id")
def win_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether block orders rise along block numbers; blocks without an order are skipped."""
    o = F.when(F.col("page_id") % 3 == 0, F.col("block_index")).otherwise(F.col("block_index") * 7 % 10)
    b = blocks(spark, sf_dir).filter("block_index % 4 <> 1").select("page_id", "block_index", o.alias("o"))
    b = b.withColumn("prev", F.lag("o").over(Window.partitionBy("page_id").orderBy("block_index")))
    return b.groupBy("page_id").agg(F.coalesce(F.bool_and(F.when(F.col("prev").isNotNull(), F.col("o") > F.col("prev"))), F.lit(True)).alias("ok"))


@query("win_branch_limit", f"{V} (SELECT 'page' AS source, page_id AS id FROM p ORDER BY page_id LIMIT 5) UNION ALL (SELECT 'block', block_id FROM b ORDER BY block_id LIMIT 5)")
def win_branch_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = pages(spark, sf_dir).select(F.lit("page").alias("source"), F.col("page_id").alias("id")).orderBy("id").limit(5)
    return one.unionByName(blocks(spark, sf_dir).select(F.lit("block").alias("source"), F.col("block_id").alias("id")).orderBy("id").limit(5))


@query("set_concat_hits", f"{V} SELECT 'page' AS source, page_id, NULL::BIGINT AS block_id FROM p UNION ALL SELECT 'block', page_id, block_id FROM b")
def set_concat_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = pages(spark, sf_dir).select(F.lit("page").alias("source"), "page_id")
    return one.unionByName(blocks(spark, sf_dir).select(F.lit("block").alias("source"), "page_id", "block_id"), allowMissingColumns=True)


@query("set_dedup_hits", f"{V} SELECT source, page_id FROM (SELECT 'a' AS source, page_id FROM p UNION ALL SELECT 'a', page_id FROM p WHERE page_number = 1) GROUP BY source, page_id")
def set_dedup_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Injected duplicates go; hits of one search never have any."""
    p = pages(spark, sf_dir).select(F.lit("a").alias("source"), "page_id", "page_number")
    both = p.withColumn("k", F.lit(0)).unionByName(p.filter("page_number = 1").withColumn("k", F.lit(1)))
    return keep_first(both, ["source", "page_id"], ["k"]).select("source", "page_id")


@query("set_ordered_distinct", "SELECT doc_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS words FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def set_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different words of a text in the order in which they first occur."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_distinct(F.split("text", " ", -1)), " ").alias("words"))


@query("set_coords", "SELECT vec_id, len(list_distinct([vec_id % 7, vec_id % 5, vec_id % 3])) AS n FROM embeddings")
def set_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(F.array_distinct(F.array(v % 7, v % 5, v % 3))).cast("long").alias("n"))


