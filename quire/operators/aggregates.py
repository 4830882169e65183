"""Aggregations over documents, pages and blocks; ties are broken by explicit keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.catalog import query
from quire.functions import text as X
from quire.sources.tables import VIEWS, blocks, documents, pages, table

V = f"WITH {VIEWS}"


def canonical(docs: DataFrame) -> DataFrame:
    """(content_hash, canonical_id, n_docs): the least id of each hash stands for it."""
    return docs.groupBy("content_hash").agg(F.min("doc_id").alias("canonical_id"), F.count(F.lit(1)).alias("n_docs"))


@query("agg_canonical", f"{V} SELECT content_hash, min(doc_id) AS canonical_id, count(*) AS n_docs FROM d GROUP BY content_hash")
def agg_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(documents(spark, sf_dir))


@query("agg_group_size", f"{V} SELECT g.content_hash, count(d.doc_id) AS n_docs FROM (SELECT DISTINCT content_hash FROM d) g LEFT JOIN (SELECT * FROM d WHERE doc_id % 2 = 0) d ON d.content_hash = g.content_hash GROUP BY g.content_hash")
def agg_group_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups are never removed: one whose documents are gone has none. One pass, no join."""
    d = documents(spark, sf_dir)
    return d.groupBy("content_hash").agg(F.count_if(F.col("doc_id") % 2 == 0).alias("n_docs"))


@query("agg_page_count", f"{V} SELECT doc_id, count(*) AS n_pages FROM p GROUP BY doc_id")
def agg_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))


def _page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stub scorer: weights in quarters, so that sums are exact."""
    p = pages(spark, sf_dir).select("doc_id", "page_number", "lang")
    other = F.when(F.col("page_number") % 2 == 0, "en").otherwise("nl")
    pairs = F.array(F.struct(F.col("lang").alias("code"), F.lit(0.75).alias("w")), F.struct(other.alias("code"), F.lit(0.25).alias("w")))
    return p.select("doc_id", "page_number", F.posexplode(pairs).alias("k", "x")).select("doc_id", "page_number", "k", F.col("x.code").alias("code"), F.col("x.w").alias("w"))


_SCORES = f"""{V}, scores AS (SELECT doc_id, page_number, 0 AS k, lang AS code, 0.75::DOUBLE AS w FROM p
  UNION ALL SELECT doc_id, page_number, 1, CASE WHEN page_number % 2 = 0 THEN 'en' ELSE 'nl' END, 0.25::DOUBLE FROM p)"""


def language_sums(scores: DataFrame) -> DataFrame:
    """(doc_id, code, weight, first): first is the place of the first mention, which breaks ties."""
    return scores.groupBy("doc_id", "code").agg(F.sum("w").alias("weight"), F.min(F.struct("page_number", "k")).alias("first"))


@query("agg_lang_sum", f"{_SCORES} SELECT doc_id, code, sum(w) AS weight FROM scores GROUP BY doc_id, code")
def agg_lang_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_sums(_page_scores(spark, sf_dir)).drop("first")


def language_shares(sums: DataFrame) -> DataFrame:
    """(doc_id, shares map, primary_lang): weights over their total to six places; no row without a positive total."""
    g = sums.groupBy("doc_id").agg(F.collect_list(F.struct("code", "weight")).alias("x"), F.sum("weight").alias("t"), F.min_by("code", F.struct((-F.col("weight")).alias("w"), "first")).alias("primary_lang"))
    shares = F.map_from_entries(F.transform(F.array_sort("x"), lambda e: F.struct(e["code"], F.round(e["weight"] / F.col("t"), 6))))
    return g.filter("t > 0").select("doc_id", shares.alias("shares"), "primary_lang")


@query("agg_lang_share", f"{_SCORES} SELECT doc_id, code, round(sum(w) / sum(sum(w)) OVER (PARTITION BY doc_id), 6) AS share FROM scores GROUP BY doc_id, code")
def agg_lang_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_shares(language_sums(_page_scores(spark, sf_dir))).select("doc_id", F.explode("shares").alias("code", "share"))


@query(
    "agg_lang_argmax",
    f"""{_SCORES} SELECT doc_id, code AS primary_lang FROM (SELECT doc_id, code, row_number() OVER (PARTITION BY doc_id ORDER BY sum(w) DESC, min(page_number * 10 + k)) AS r FROM scores GROUP BY doc_id, code) WHERE r = 1""",
)
def agg_lang_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_shares(language_sums(_page_scores(spark, sf_dir))).select("doc_id", "primary_lang")


_SCRIPT = "CASE WHEN (page_id * 7) % 5 < 2 THEN 'Cyrl' WHEN (page_id * 7) % 5 < 4 THEN 'Latn' END"


def script_mode(p: DataFrame) -> DataFrame:
    """(doc_id, primary_script): the most frequent script, of equal ones the one seen first; null if no page has one."""
    each = p.groupBy("doc_id", "script").agg(F.count("script").alias("n"), F.min("page_number").alias("first"))
    return each.groupBy("doc_id").agg(F.min_by("script", F.struct(F.col("script").isNull(), -F.col("n"), "first")).alias("primary_script"))


@query(
    "agg_script_mode",
    f"""{V} SELECT doc_id, script AS primary_script FROM (SELECT doc_id, script, row_number() OVER (PARTITION BY doc_id ORDER BY script IS NULL, count(script) DESC, min(page_number)) AS r
    FROM (SELECT doc_id, page_number, {_SCRIPT} AS script FROM p) GROUP BY doc_id, script) WHERE r = 1""",
)
def agg_script_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return script_mode(pages(spark, sf_dir).select("doc_id", "page_number", F.expr(_SCRIPT).alias("script")))


@query("agg_lang_counts", f"{V} SELECT doc_id, count(*) FILTER (length(markdown) >= 20) AS pages_with_lang, count(*) FILTER ({_SCRIPT} IS NOT NULL) AS pages_with_script FROM p GROUP BY doc_id")
def agg_lang_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    return p.groupBy("doc_id").agg(F.count_if(F.length("markdown") >= 20).alias("pages_with_lang"), F.count_if(F.expr(_SCRIPT).isNotNull()).alias("pages_with_script"))


_PAGE_TYPE = "CASE doc_id % 4 WHEN 0 THEN 'native-pdf' WHEN 1 THEN 'ocr-pdf' WHEN 2 THEN 'image-pdf' ELSE CASE WHEN page_number % 2 = 0 THEN 'ocr-pdf' ELSE 'native-pdf' END END"


def document_type(types: Column) -> Column:
    """Unanimous page type, else mixed; image-pdf without pages. An aggregate."""
    n = F.count_distinct(types)
    return F.when(n == 0, "image-pdf").when(n == 1, F.min(types)).otherwise("mixed-pdf")


@query("agg_doc_type", f"{V} SELECT doc_id, CASE WHEN count(DISTINCT t) = 0 THEN 'image-pdf' WHEN count(DISTINCT t) = 1 THEN min(t) ELSE 'mixed-pdf' END AS sourcetype FROM (SELECT doc_id, {_PAGE_TYPE} AS t FROM p) GROUP BY doc_id")
def agg_doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).select("doc_id", F.expr(_PAGE_TYPE).alias("t"))
    return p.groupBy("doc_id").agg(document_type(F.col("t")).alias("sourcetype"))


def upper_median(values: Column) -> Column:
    """sorted[n div 2]: of an even number, the upper of the middle two. An aggregate."""
    s = F.array_sort(F.collect_list(values))
    return F.try_element_at(s, F.floor(F.size(s) / 2).cast("int") + 1)


@query("agg_median_dpi", f"{V} SELECT doc_id, list_sort(list(CAST(150 + (page_id * 37) % 450 AS INTEGER)))[count(*) // 2 + 1] AS dpi FROM p GROUP BY doc_id")
def agg_median_dpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).select("doc_id", (150 + F.col("page_id") * 37 % 450).cast("int").alias("dpi"))
    return p.groupBy("doc_id").agg(upper_median(F.col("dpi")).alias("dpi"))


def text_layer(order: Column, index: Column, text: Column) -> Column:
    """Texts in reading order, then index; nulls come last, blanks are dropped, nothing is null. An aggregate."""
    rows = F.array_sort(F.collect_list(F.struct(F.coalesce(order, F.lit(10**9)).alias("o"), F.coalesce(index, F.lit(10**9)).alias("i"), X.strip(F.coalesce(text, F.lit(""))).alias("t"))))
    return F.nullif(F.array_join(F.filter(F.transform(rows, lambda x: x["t"]), lambda t: t != ""), "\n"), F.lit(""))


_ORDER = "CASE WHEN block_index % 3 = 0 THEN NULL ELSE (block_index * 7) % 10 END"


@query("agg_text_layer", f"{V} SELECT page_id, nullif(string_agg(t, chr(10) ORDER BY coalesce(o, 1000000000), block_index) FILTER (t <> ''), '') AS text_layer FROM (SELECT page_id, block_index, {_ORDER} AS o, trim(text) AS t FROM b) GROUP BY page_id")
def agg_text_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).groupBy("page_id").agg(text_layer(F.expr(_ORDER), F.col("block_index"), F.col("text")).alias("text_layer"))


def markdown_of(category: Column, text: Column) -> Column:
    low, t = F.lower(F.coalesce(category, F.lit(""))), X.strip(F.coalesce(text, F.lit("")))
    line = lambda c: F.concat(c, F.lit("\n"))
    out = F.when(low.isin("title", "header"), line(F.concat(F.lit("# "), t))).when(low == "table", F.lit("\n<!-- TABLE: see page.json or crops -->\n"))
    out = out.when(low.isin("picture", "figure", "image"), F.lit("\n<!-- IMAGE: see crops -->\n")).otherwise(line(t))
    return F.when(t != "", out)


@query(
    "agg_markdown",
    f"""{V} SELECT page_id, coalesce(trim(string_agg(m, chr(10) ORDER BY block_index), chr(10)) || chr(10), '') AS markdown
    FROM (SELECT page_id, block_index, CASE WHEN trim(text) = '' THEN NULL WHEN category = 'Title' THEN '# ' || trim(text) || chr(10) ELSE trim(text) || chr(10) END AS m FROM b) GROUP BY page_id""",
)
def agg_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir).select("page_id", "block_index", markdown_of(F.col("category"), F.col("text")).alias("m"))
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("m").isNotNull(), F.struct("block_index", "m")))), lambda x: x["m"])
    joined = X.strip(F.array_join(parts, "\n"))
    return b.groupBy("page_id").agg(F.when(joined != "", F.concat(joined, F.lit("\n"))).otherwise("").alias("markdown"))


def marked(order: Column, block_id: Column, label: Column, content: Column, bbox: Column, width: Column) -> Column:
    """The page's blocks between markers, parted by blank lines. An aggregate."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), X.wrap_block(block_id, label, content, bbox, width).alias("m"))))
    return F.array_join(F.transform(rows, lambda x: x["m"]), "\n\n")


@query(
    "agg_marked",
    f"""{V} SELECT page_id, string_agg(m, chr(10) || chr(10) ORDER BY k) AS marked_md FROM (SELECT page_id, block_index % 10 AS k,
    concat_ws(chr(10), printf('[#%03d]', block_index % 10), CASE WHEN trim(text) = '' THEN NULL WHEN category = 'Title' THEN '## ' || trim(text) ELSE trim(text) END, printf('[/#%03d]', block_index % 10)) AS m FROM b) GROUP BY page_id""",
)
def agg_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir).withColumn("k", F.col("block_index") % 10)
    none = F.array().cast("array<int>")
    return b.groupBy("page_id").agg(marked(F.col("k"), F.col("k"), F.col("category"), F.col("text"), none, F.lit(2481)).alias("marked_md"))


@query("agg_parse_summary", f"{V} SELECT doc_id, count(*) FILTER (page_number % 7 <> 0) AS pages_parsed, count(*) FILTER (page_number % 7 = 0) AS pages_failed, CAST(sum(CASE WHEN page_number % 7 <> 0 THEN len(string_split(markdown, chr(10))) ELSE 0 END) AS BIGINT) AS n_blocks FROM p GROUP BY doc_id")
def agg_parse_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, n = F.col("page_number") % 7 != 0, F.size(F.split("markdown", "\n", -1))
    return pages(spark, sf_dir).groupBy("doc_id").agg(F.count_if(ok).alias("pages_parsed"), F.count_if(~ok).alias("pages_failed"), F.sum(F.when(ok, n).otherwise(0)).alias("n_blocks"))


@query(
    "agg_mt_summary",
    f"""{V} SELECT doc_id, count(*) FILTER (s = 'translated') AS translated, count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s = 'failed') AS failed, min(m) AS model, string_agg(DISTINCT m, ',' ORDER BY m) AS models
    FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN 'skipped' WHEN page_number % 5 = 0 THEN 'failed' ELSE 'translated' END AS s, CASE WHEN lang <> 'en' THEN 'opus_' || lang END AS m FROM p) GROUP BY doc_id""",
)
def agg_mt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.when(F.col("lang") == "en", "skipped").when(F.col("page_number") % 5 == 0, "failed").otherwise("translated")
    p = pages(spark, sf_dir).select("doc_id", s.alias("s"), F.when(F.col("lang") != "en", F.concat(F.lit("opus_"), "lang")).alias("m"))
    g = p.groupBy("doc_id").agg(*(F.count_if(F.col("s") == k).alias(k) for k in ("translated", "skipped", "failed")), F.min("m").alias("model"), F.array_join(F.array_sort(F.collect_set("m")), ",").alias("models"))
    return g.withColumn("models", F.nullif("models", F.lit("")))


@query("agg_block_expected", f"{V} SELECT page_id, count(*) FILTER (trim(regexp_replace(text, '<[^>]+>', ' ', 'g')) <> '') AS expected FROM b GROUP BY page_id")
def agg_block_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that an extraction from the page's marked text will find."""
    b = blocks(spark, sf_dir).withColumn("k", F.col("block_index") % 10)
    none = F.array().cast("array<int>")
    m = b.groupBy("page_id").agg(marked(F.col("k"), F.col("k"), F.lit("text"), F.col("text"), none, F.lit(2481)).alias("md"))
    return m.select("page_id", F.size(X.extract_blocks(F.col("md"))).cast("long").alias("expected"))


@query("agg_hash_size", "SELECT doc_id, sha256(text) AS content_hash, octet_length(encode(text)) AS byte_size FROM documents")
def agg_hash_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "content_hash", "byte_size")


@query("agg_events", "SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS log FROM events GROUP BY user_id")
def agg_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a log, read in order."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("x"))
    return e.select("user_id", F.array_join(F.transform("x", lambda r: r["event_type"]), ",").alias("log"))


@query("agg_dpi_range", f"{V} SELECT doc_id, min(150 + (page_id * 37) % 450) AS least, max(150 + (page_id * 37) % 450) AS most FROM p GROUP BY doc_id")
def agg_dpi_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    dpi = 150 + F.col("page_id") * 37 % 450
    return pages(spark, sf_dir).groupBy("doc_id").agg(F.min(dpi).alias("least"), F.max(dpi).alias("most"))
