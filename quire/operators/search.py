"""Keyword search over originals and translations, at page and block level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.catalog import query
from quire.functions import fulltext
from quire.operators.filters import TARGETS, check_search, page_links
from quire.operators.ordering import keep_first
from quire.sources.tables import VIEWS, block_mt, blocks, page_mt, pages

#: The production query: three frequent words.
TERMS = "the and that"
KEYS = ["source", "document_id", "page_id", "block_id", "lang"]
COLUMNS = ["source", "document_id", "page_id", "page_number", "block_id", "block_index", "lang", "model"]


def _top(df: DataFrame, source: str, q: str, limit: int, most: int, least: int, start: str, stop: str) -> DataFrame:
    """Hits of one branch, the latest documents first. Snippets are made for the hits that are returned only."""
    last = [c for c in ("block_id",) if c in df.columns] + ["lang"]
    cols = [c for c in ("page_id", "page_number", "block_id", "block_index", "model") if c in df.columns]
    hits = df.filter(fulltext.matches(F.col("text"), q))
    hits = hits.select(F.lit(source).alias("source"), F.col("doc_id").alias("document_id"), *cols, "lang", "text")
    top = hits.orderBy(F.desc("document_id"), "page_number", *last).limit(limit)
    return top.withColumn("context", fulltext.headline(F.col("text"), q, most, least, start, stop)).drop("text")


def branch(spark: SparkSession, sf_dir: str, source: str, q: str, limit: int, block_words: tuple[int, int] = (60, 20), start: str = "<b>", stop: str = "</b>") -> DataFrame:
    """Hits of original pages, page_mt, block_mt or original blocks."""
    none = F.lit(None).cast("string")
    if source == "page_original":
        return _top(pages(spark, sf_dir).withColumn("lang", none).withColumnRenamed("markdown", "text"), "page_original", q, limit, 40, 15, start, stop)
    if source == "page_mt":
        return _top(page_mt(spark, sf_dir), "page_mt", q, limit, 40, 15, start, stop)
    if source == "block_mt":
        return _top(block_mt(spark, sf_dir), "block_mt", q, limit, *block_words, start, stop)
    return _top(blocks(spark, sf_dir).withColumn("lang", none), "block_original", q, limit, *block_words, start, stop)


def keyword(spark: SparkSession, sf_dir: str, q: str, scope: str = "both", level: str = "block", limit: int = 50) -> DataFrame:
    """Translations first, then originals; one hit of each key, `limit` in all. So many hits in translations hide originals."""
    check_search(q, scope, level, limit)
    names = {"page": ("page_mt", "page_original"), "block": ("block_mt", "block_original")}[level]
    wanted = [n for n in names if scope == "both" or n.endswith("original" if scope == "original" else "mt")]
    out = None
    for k, n in enumerate(wanted):
        b = branch(spark, sf_dir, n, q, limit).withColumn("branch", F.lit(k))
        out = b if out is None else out.unionByName(b, allowMissingColumns=True)
    if "block_id" not in out.columns:
        out = out.withColumn("block_id", F.lit(None).cast("long"))
    arrival = ["branch", F.desc("document_id"), "page_number", "block_id", "lang"]
    return keep_first(out, KEYS, arrival).orderBy(*arrival).limit(limit).drop("branch")


def ui(spark: SparkSession, sf_dir: str, q: str, target: str = "all", limit: int = 50) -> DataFrame:
    """All branches of the target, each with its own limit, hits marked; a blank query has none."""
    if target not in TARGETS or not 1 <= limit <= 100:
        raise ValueError("no such target or limit")
    names = {"original": "page_original", "page_mt": "page_mt", "block_mt": "block_mt", "block_original": "block_original"}
    out = None
    for t, n in names.items():
        if target in ("all", t):
            b = branch(spark, sf_dir, n, q.strip(), limit, (40, 15), "<mark>", "</mark>").withColumn("source", F.lit(t))
            out = b if out is None else out.unionByName(b, allowMissingColumns=True)
    return out.select("*", *page_links(F.col("page_id"), F.coalesce("lang", F.lit("en")))).withColumnRenamed("context", "snippet")


def _where(column: str, q: str = TERMS) -> str:
    return " AND ".join(f"list_contains(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}]+'), '{t}')" for t in fulltext.query_terms(q))


V = f"WITH {VIEWS}"
_BRANCHES = {
    "fts_page_original": f"SELECT 'page_original' AS source, doc_id AS document_id, page_id, page_number, NULL::VARCHAR AS lang FROM p WHERE {_where('markdown')} ORDER BY doc_id DESC, page_number LIMIT 50",
    "fts_page_mt": f"SELECT 'page_mt' AS source, doc_id AS document_id, page_id, page_number, 'en' AS lang, 'stub' AS model FROM p WHERE {_where('markdown')} ORDER BY doc_id DESC, page_number LIMIT 50",
    "fts_block_mt": f"SELECT 'block_mt' AS source, doc_id AS document_id, page_id, page_number, block_id, block_index, 'en' AS lang, 'stub' AS model FROM b WHERE {_where('text')} ORDER BY doc_id DESC, page_number, block_id LIMIT 50",
    "fts_block_original": f"SELECT 'block_original' AS source, doc_id AS document_id, page_id, page_number, block_id, block_index, NULL::VARCHAR AS lang FROM b WHERE {_where('text')} ORDER BY doc_id DESC, page_number, block_id LIMIT 50",
}


def _plain(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return branch(spark, sf_dir, name.removeprefix("fts_"), TERMS, 50).drop("context")

    return run


for _name, _sql in _BRANCHES.items():
    query(_name, f"{V} {_sql}")(_plain(_name))


@query("flt_fts", f"{V} SELECT block_id FROM b WHERE {_where('text')}")
def flt_fts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).filter(fulltext.matches(F.col("text"), TERMS)).select("block_id")


@query(
    "fts_keyword",
    f"""{V} SELECT source, document_id, page_id, page_number, block_id, block_index, lang, model FROM (
      SELECT 0 AS k, *, 'stub' AS model FROM (SELECT 'block_mt' AS source, doc_id AS document_id, page_id, page_number, block_id, block_index, 'en' AS lang FROM b WHERE {_where('text', 'heatly')} ORDER BY doc_id DESC, page_number, block_id LIMIT 50)
      UNION ALL SELECT 1, *, NULL FROM (SELECT 'block_original', doc_id, page_id, page_number, block_id, block_index, NULL::VARCHAR FROM b WHERE {_where('text', 'heatly')} ORDER BY doc_id DESC, page_number, block_id LIMIT 50))
    ORDER BY k, document_id DESC, page_number, block_id LIMIT 50""",
)
def fts_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword(spark, sf_dir, "heatly", "both", "block", 50).select(*COLUMNS)


@query(
    "fts_ui",
    f"""{V} SELECT source, document_id, page_id, '/ui/pages/' || page_id AS original_page_url FROM (
      SELECT * FROM (SELECT 'original' AS source, doc_id AS document_id, page_id FROM p WHERE {_where('markdown')} ORDER BY doc_id DESC, page_number LIMIT 20)
      UNION ALL SELECT * FROM (SELECT 'page_mt', doc_id, page_id FROM p WHERE {_where('markdown')} ORDER BY doc_id DESC, page_number LIMIT 20)
      UNION ALL SELECT * FROM (SELECT 'block_mt', doc_id, page_id FROM b WHERE {_where('text')} ORDER BY doc_id DESC, page_number, block_id LIMIT 20)
      UNION ALL SELECT * FROM (SELECT 'block_original', doc_id, page_id FROM b WHERE {_where('text')} ORDER BY doc_id DESC, page_number, block_id LIMIT 20))""",
)
def fts_ui(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ui(spark, sf_dir, TERMS, "all", 20).select("source", "document_id", "page_id", "original_page_url")


@query("fn_headline")
def fn_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of the matching blocks. There is no SQL for fragment choice; tests fix the written rules."""
    return branch(spark, sf_dir, "block_original", TERMS, 50).select("block_id", "context")


def token_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key): the inverted index as a table, to be written bucketed or sorted by token."""
    return df.select(F.explode(fulltext.terms(F.col(text))).alias("token"), key)


def write_index(index: DataFrame, path: str) -> None:
    """The token table in ranges of tokens, sorted within files: a search reads the row groups of its tokens only."""
    index.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(path)


def search_tokens(index: DataFrame, key: str, q: str) -> DataFrame:
    """Keys of the index that have all terms of the query; the token filter is pushed to the index's scan."""
    wanted = fulltext.query_terms(q)
    found = index.filter(F.col("token").isin(wanted)) if wanted else index.limit(0)
    return found.groupBy(key).agg(F.count_distinct("token").alias("n")).filter(F.col("n") == len(wanted)).select(key)


@query("fts_index", f"{V} SELECT block_id FROM b WHERE {_where('text')}")
def fts_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_tokens(token_table(blocks(spark, sf_dir), "block_id", "text"), "block_id", TERMS)


def escaped(c):
    """Text as it may stand in HTML."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def page_html(df: DataFrame, title: str, body: str) -> DataFrame:
    """df with an `html` column: title and body escaped, as markup from documents must not be rendered."""
    doc = F.concat(F.lit("<!DOCTYPE html><h1>"), escaped(F.col(title).cast("string")), F.lit("</h1><pre>"), escaped(F.coalesce(body, F.lit(""))), F.lit("</pre>"))
    return df.withColumn("html", doc)


@query("snk_html", f"{V} SELECT page_id, '<!DOCTYPE html><h1>' || page_id || '</h1><pre>' || replace(replace(replace(replace(replace(markdown, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') || '</pre>' AS html FROM p")
def snk_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_html(pages(spark, sf_dir), "page_id", "markdown").select("page_id", "html")
