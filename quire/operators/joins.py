"""Joins of the entities, and look-ups as map literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.catalog import query
from quire.functions import languages as L
from quire.functions import text as X
from quire.sources.tables import VIEWS, block_mt, blocks, documents, page_mt, pages, table

V = f"WITH {VIEWS}"


@query("jn_doc_page", f"{V} SELECT d.doc_id, d.source, p.page_id, p.page_number FROM d JOIN p ON p.doc_id = d.doc_id")
def jn_doc_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "source").join(pages(spark, sf_dir).select("doc_id", "page_id", "page_number"), "doc_id")


@query("jn_page_mt", f"{V} SELECT d.doc_id, d.source, p.page_id, upper(replace(p.markdown, 'ß', 'ss')) AS text FROM p JOIN d ON p.doc_id = d.doc_id")
def jn_page_mt(spark: SparkSession, sf_dir: str) -> DataFrame:
    mt = page_mt(spark, sf_dir).select("page_id", "text")
    return mt.join(pages(spark, sf_dir).select("page_id", "doc_id"), "page_id").join(documents(spark, sf_dir).select("doc_id", "source"), "doc_id")


@query("jn_block_mt", f"{V} SELECT d.doc_id, d.source, p.page_id, b.block_id, upper(replace(b.text, 'ß', 'ss')) AS text FROM b JOIN p USING (page_id) JOIN d ON d.doc_id = p.doc_id")
def jn_block_mt(spark: SparkSession, sf_dir: str) -> DataFrame:
    mt, b = block_mt(spark, sf_dir).select("block_id", "text"), blocks(spark, sf_dir).select("block_id", "page_id")
    up = pages(spark, sf_dir).select("page_id", "doc_id").join(documents(spark, sf_dir).select("doc_id", "source"), "doc_id")
    return mt.join(b, "block_id").join(up, "page_id")


@query("jn_block", f"{V} SELECT d.doc_id, d.source, p.page_id, b.block_id, b.category FROM b JOIN p USING (page_id) JOIN d ON d.doc_id = p.doc_id")
def jn_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = pages(spark, sf_dir).select("page_id", "doc_id").join(documents(spark, sf_dir).select("doc_id", "source"), "doc_id")
    return blocks(spark, sf_dir).select("block_id", "page_id", "category").join(up, "page_id")


@query("jn_nest", f"{V} SELECT d.doc_id, count(p.page_id) AS n_pages, coalesce(string_agg(p.page_number::VARCHAR, ',' ORDER BY p.page_number), '') AS numbers FROM d LEFT JOIN p ON p.doc_id = d.doc_id AND p.page_number > 1 GROUP BY d.doc_id")
def jn_nest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their pages beyond the first; documents without any stay."""
    p = pages(spark, sf_dir).filter("page_number > 1").select("doc_id", "page_number")
    nested = documents(spark, sf_dir).select("doc_id").join(p, "doc_id", "left").groupBy("doc_id").agg(F.count("page_number").alias("n_pages"), F.array_sort(F.collect_list("page_number")).alias("n"))
    return nested.select("doc_id", "n_pages", F.array_join(F.col("n").cast("array<string>"), ",").alias("numbers"))


@query("jn_block_id", f"{V} SELECT b.block_id, b.page_id, b.block_index FROM b WHERE b.block_index % 10 < 8")
def jn_block_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker numbers 0 to 7 of every page met with the page's blocks; a marker without a block is dropped."""
    p = pages(spark, sf_dir).select("page_id", "page_number")
    markers = p.select("page_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"), "page_number").select("page_id", ((F.col("page_number") - 1) * 10 + F.col("k")).alias("block_index"))
    return markers.join(blocks(spark, sf_dir).select("block_id", "page_id", "block_index"), ["page_id", "block_index"])


@query(
    "jn_page_upsert",
    f"""{V}, old AS (SELECT doc_id, page_number, CASE WHEN page_number % 2 = 1 THEN 0 ELSE 100 END AS width FROM p WHERE page_number <= 2),
    fresh AS (SELECT doc_id, page_number, 2481 AS width FROM p)
    SELECT doc_id, page_number, coalesce(nullif(old.width, 0), fresh.width) AS width, old.doc_id IS NULL AS inserted FROM old FULL JOIN fresh USING (doc_id, page_number)""",
)
def jn_page_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).select("doc_id", "page_number")
    old = p.filter("page_number <= 2").withColumn("width", F.when(F.col("page_number") % 2 == 1, 0).otherwise(100))
    return upserted(old, p.withColumn("width", F.lit(2481)), ["doc_id", "page_number"], ["width"])


def upserted(old: DataFrame, new: DataFrame, keys: list[str], filled: list[str]) -> DataFrame:
    """old and new rows by key; what is null or zero in old is taken from new."""
    o = old.select(*keys, F.lit(False).alias("_new"), *(F.col(c).alias(f"_{c}") for c in filled))
    met = o.join(new.select(*keys, *filled), keys, "full")
    return met.select(*keys, *(F.coalesce(F.nullif(f"_{c}", F.lit(0)), c).alias(c) for c in filled), F.coalesce("_new", F.lit(True)).alias("inserted"))


@query("jn_zip", f"{V} SELECT page_id, CAST(i AS INTEGER) AS page_number, 'p' || i AS uri, 150 + i * 10 AS dpi FROM (SELECT page_id, unnest(range(1, 4)) AS i FROM p)")
def jn_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    uris, dpis = F.array(*(F.lit(f"p{i}") for i in (1, 2, 3))), F.array(*(F.lit(150 + i * 10).cast("long") for i in (1, 2, 3)))
    z = pages(spark, sf_dir).select("page_id", F.posexplode(F.arrays_zip(uris.alias("uri"), dpis.alias("dpi"))).alias("i", "x"))
    return z.select("page_id", (F.col("i") + 1).alias("page_number"), F.col("x.uri").alias("uri"), F.col("x.dpi").alias("dpi"))


@query(
    "jn_pages_pdf",
    f"{V} SELECT p.page_id, coalesce(f.label, 'image-pdf') AS sourcetype, f.label IS NULL AS mismatch FROM p LEFT JOIN (SELECT doc_id, page_number, 'native-pdf' AS label FROM p WHERE page_number <= 3) f ON f.doc_id = p.doc_id AND f.page_number = p.page_number",
)
def jn_pages_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).select("page_id", "doc_id", "page_number")
    f = p.filter("page_number <= 3").select("doc_id", "page_number", F.lit("native-pdf").alias("label"))
    return p.join(f, ["doc_id", "page_number"], "left").select("page_id", F.coalesce("label", F.lit("image-pdf")).alias("sourcetype"), F.col("label").isNull().alias("mismatch"))


def _case(values: dict, column: str, otherwise: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + f" ELSE {otherwise} END"


@query("jn_lookup_lang3", f"SELECT doc_id, {_case(L.THREE_LETTERS, 'lang', 'lang')} AS code FROM documents")
def jn_lookup_lang3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", L.three_letters(F.col("lang")).alias("code"))


_SCRIPT = "CASE doc_id % 5 WHEN 0 THEN 'Latin' WHEN 1 THEN 'cyrillic' WHEN 2 THEN 'Thai' WHEN 3 THEN '  ' END"


@query("jn_lookup_script", f"SELECT doc_id, CASE WHEN trim(coalesce(s, '')) <> '' THEN {_case(L.SCRIPTS, 'lower(trim(s))', 's')} END AS script FROM (SELECT doc_id, {_SCRIPT} AS s FROM documents)")
def jn_lookup_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", L.script_code(F.expr(_SCRIPT)).alias("script"))


_LABEL = "CASE doc_id % 6 WHEN 0 THEN 'figure' WHEN 1 THEN ' Stamp ' WHEN 2 THEN 'doc_title' WHEN 3 THEN '' WHEN 4 THEN 'TABLE' END"


@query(
    "jn_lookup_label",
    f"SELECT doc_id, CASE WHEN coalesce(l, '') = '' THEN 'Unknown' ELSE {_case(X.LABELS, 'lower(trim(l))', 'upper(left(trim(l), 1)) || lower(substr(trim(l), 2))')} END AS category FROM (SELECT doc_id, {_LABEL} AS l FROM documents)",
)
def jn_lookup_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.category_of(F.expr(_LABEL)).alias("category"))


@query("jn_lookup_model", f"SELECT doc_id, {_case({k: v for k, v in L.CT2_MODELS.items() if k != '*'}, 'lang', repr(L.CT2_MODELS['*']))} AS model FROM documents")
def jn_lookup_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", L.model_of(F.col("lang")).alias("model"))


_MODEL = "CASE doc_id % 6 WHEN 0 THEN 'opus_fr_en_ct2' WHEN 1 THEN 'google/TranslateGemma-12b' WHEN 2 THEN 'gemma-2' WHEN 3 THEN 'nllb-200' WHEN 4 THEN 'other' ELSE 'mbart50' END"
_BACKEND = "CASE WHEN doc_id % 12 < 6 THEN 'vllm' ELSE 'ct2' END"


@query(
    "jn_lookup_limits",
    f"SELECT doc_id, CASE WHEN m LIKE '%opus%' THEN 1575 WHEN m LIKE '%gemma%' THEN 7392 WHEN m LIKE '%nllb%' OR m LIKE '%m2m100%' OR m LIKE '%mbart%' THEN 3800 WHEN be = 'vllm' THEN 7680 ELSE 1575 END AS max_chars FROM (SELECT doc_id, lower({_MODEL}) AS m, {_BACKEND} AS be FROM documents)",
)
def jn_lookup_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", L.limit_of(F.expr(_MODEL), F.expr(_BACKEND)).alias("limit"))
    return d.select("doc_id", L.most_characters(F.col("limit")).alias("max_chars"))
