"""Stages of the document pipeline as plans; errors are status columns, not exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.catalog import query
from quire.functions import geometry, imaging, paths
from quire.functions import text as X
from quire.operators import aggregates as A
from quire.operators.scalars import page_type
from quire.sources.tables import VIEWS, blocks, documents, pages, table

V = f"WITH {VIEWS}"


def classify(pages_: DataFrame) -> DataFrame:
    """pages (doc_id, page_id, kind, readable, has_text, boxes, width, height) with page_type and the document's type.

    Pages that can't be read are image-pdf with an issue; documents that aren't PDFs are `image` throughout.
    """
    ratio = geometry.cover_ratio(F.col("boxes"), F.col("width"), F.col("height"))
    t = F.when(F.col("kind") != "pdf", "image").when(~F.col("readable"), "image-pdf").otherwise(page_type(F.col("has_text"), ratio))
    issue = F.when((F.col("kind") == "pdf") & ~F.col("readable"), F.array(F.struct(F.lit("unreadable").alias("code")))).otherwise(F.array().cast("array<struct<code:string>>"))
    typed = pages_.withColumn("page_type", t).withColumn("issues", issue)
    docs = typed.groupBy("doc_id").agg(A.document_type(F.col("page_type")).alias("sourcetype"))
    return typed.join(docs, "doc_id")


_SIDE = "((page_id * 13) % 60)"


@query(
    "stg_classify",
    f"""{V}, t AS (SELECT doc_id, page_id, CASE WHEN doc_id % 5 = 4 THEN 'image' WHEN page_id % 11 = 0 THEN 'image-pdf' WHEN page_number % 3 = 0 THEN 'image-pdf'
      WHEN (CASE WHEN {_SIDE} * {_SIDE} / 8000.0 > 0.002 THEN {_SIDE} * {_SIDE} / 8000.0 ELSE 0 END) < 0.05 THEN 'native-pdf' ELSE 'ocr-pdf' END AS page_type FROM p)
    SELECT page_id, page_type, CASE WHEN n = 1 THEN page_type ELSE 'mixed-pdf' END AS sourcetype FROM t JOIN (SELECT doc_id, count(DISTINCT page_type) AS n FROM t GROUP BY doc_id) USING (doc_id)""",
)
def stg_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.expr(_SIDE).cast("double")
    p = pages(spark, sf_dir).select(
        "doc_id", "page_id", F.when(F.col("doc_id") % 5 == 4, "image").otherwise("pdf").alias("kind"), (F.col("page_id") % 11 != 0).alias("readable"),
        (F.col("page_number") % 3 != 0).alias("has_text"), F.array(F.array(F.lit(0.0), F.lit(0.0), s, s)).alias("boxes"), F.lit(100.0).alias("width"), F.lit(80.0).alias("height"),
    )
    return classify(p).select("page_id", "page_type", "sourcetype")


@query("stg_classify_img", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'image' END AS sourcetype FROM documents")
def stg_classify_img(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = paths.kind(F.when(F.col("doc_id") % 2 == 0, "a.png").otherwise("a.pdf"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(kind != "pdf", "image").alias("sourcetype"))


@query("stg_classify_bytes", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'image-pdf' ELSE 'native-pdf' END AS sourcetype FROM documents")
def stg_classify_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that can't be opened are image-pdf without pages."""
    readable = F.col("doc_id") % 2 != 0
    return table(spark, sf_dir, "documents").select("doc_id", F.when(readable, page_type(F.lit(True), F.lit(0.0))).otherwise("image-pdf").alias("sourcetype"))


@query(
    "stg_materialise",
    f"""{V} SELECT doc_id, page_id, printf('output:///documents/%09d/%04d/p%04d_source.png', doc_id, page_number, page_number) AS image_uri,
    (list_sort(list(150 + CAST((page_id * 37) % 450 AS INTEGER)) OVER (PARTITION BY doc_id)))[CAST(count(*) OVER (PARTITION BY doc_id) AS BIGINT) // 2 + 1] AS doc_dpi FROM p""",
)
def stg_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its image and the document's resolution."""
    p = pages(spark, sf_dir).withColumn("dpi", imaging.clamp(150 + F.col("page_id") * 37 % 450))
    docs = p.groupBy("doc_id").agg(A.upper_median(F.col("dpi")).alias("doc_dpi"))
    return p.select("doc_id", "page_id", paths.to_uri(paths.page_image(F.col("doc_id"), F.col("page_number"))).alias("image_uri")).join(docs, "doc_id")


@query(
    "stg_detect",
    f"""{V}, s AS (SELECT doc_id, page_number, lang FROM p WHERE length(trim(regexp_replace(markdown, '\\s+', ' ', 'g'))) >= 20)
    SELECT d.doc_id, max(s.lang) AS primary_lang, count(s.lang) AS pages_with_lang, CASE WHEN count(s.lang) > 0 THEN 'Latn' END AS primary_script FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id""",
)
def stg_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by page, then by document; short pages have none. The stub scorer returns the declared language."""
    long_ = F.length(X.collapse(F.col("markdown"))) >= 20
    p = pages(spark, sf_dir).select("doc_id", "page_number", F.when(long_, F.col("lang")).alias("code"))
    scores = p.filter("code is not null").select("doc_id", "page_number", F.lit(0).alias("k"), "code", F.lit(1.0).alias("w"))
    best = A.language_shares(A.language_sums(scores)).select("doc_id", "primary_lang")
    n = p.groupBy("doc_id").agg(F.count("code").alias("pages_with_lang"))
    return n.join(best, "doc_id", "left").select("doc_id", "primary_lang", "pages_with_lang", F.when(F.col("primary_lang").isNotNull(), "Latn").alias("primary_script"))


@query("stg_parse", f"{V} SELECT page_id, count(*) AS n_blocks, nullif(string_agg(trim(text), chr(10) ORDER BY block_index) FILTER (trim(text) <> ''), '') AS text_layer FROM b GROUP BY page_id")
def stg_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the parser into text layers. The stub parser takes lines for blocks."""
    b = blocks(spark, sf_dir)
    return b.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_blocks"), A.text_layer(F.lit(None).cast("int"), F.col("block_index"), F.col("text")).alias("text_layer"))


@query(
    "stg_pipeline",
    f"""{V} SELECT d.doc_id, count(p.page_id) AS n_pages, CAST(sum(len(string_split(p.markdown, chr(10)))) AS BIGINT) AS n_blocks, CAST(sum(CASE WHEN p.lang = 'en' THEN 0 ELSE 1 END) AS BIGINT) AS translated, 'completed' AS status
    FROM d JOIN p USING (doc_id) WHERE d.doc_id % 5 NOT IN (3, 4) GROUP BY d.doc_id""",
)
def stg_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the documents that aren't being deleted, one aggregation at the end."""
    live = documents(spark, sf_dir).filter("doc_id % 5 not in (3, 4)").select("doc_id")
    p = pages(spark, sf_dir).join(live, "doc_id", "left_semi")
    n = F.size(F.split("markdown", "\n", -1))
    out = p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(n).alias("n_blocks"), F.sum(F.when(F.col("lang") == "en", 0).otherwise(1)).alias("translated"))
    return out.withColumn("status", F.lit("completed"))
