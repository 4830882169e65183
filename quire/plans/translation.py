"""Machine translation: routing, the unified and the block-wise way, and the plug for backends.

A backend is a class with translate_batch(list[str]) -> list[str]. It is made once for each Python worker and fed by an
iterator, so a model is loaded once. The stub's translation is upper case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.catalog import query
from quire.functions import languages as L
from quire.functions import text as X
from quire.functions.chunk import chunks_of
from quire.operators import aggregates as A
from quire.sources.tables import VIEWS, blocks, pages, table

V = f"WITH {VIEWS}"


class Stub:
    def translate_batch(self, texts: list[str]) -> list[str]:
        return [t.upper() for t in texts]


def translator(make: Callable[[], object], max_chars: int, batch: int = 6) -> Callable[[Column], Column]:
    """A column function: texts cut into chunks, translated by batches, joined by blank lines; blank texts are empty."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        backend = make()
        for texts in parts:
            cut = [chunks_of(t, max_chars) for t in texts]
            flat = [c for x in cut for c in x]
            done: list[str] = []
            for at in range(0, len(flat), batch):
                done += backend.translate_batch(flat[at : at + batch])
            it = iter(done)
            yield pd.Series(["\n\n".join(t for _ in x if (t := next(it).strip())) for x in cut])

    return run


def route(lang: Column, target: str, marked: Column, text: Column) -> Column:
    """struct(mode, reason): same language and missing text are skipped, marked text goes the unified way."""
    made = lambda m, r=None: F.struct(F.lit(m).alias("mode"), F.lit(r).cast("string").alias("reason"))
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(L.language_key(lang) == target, made("skipped", "same_language")).when(has(marked), made("unified")).when(has(text), made("legacy")).otherwise(made("skipped", "no_text_layer_or_marked_md"))


@query("mt_route", f"{V} SELECT page_id, CASE WHEN lang = 'en' THEN 'skipped' WHEN page_number = 1 THEN 'unified' WHEN page_number % 3 <> 0 THEN 'legacy' ELSE 'skipped' END AS mode, CASE WHEN lang = 'en' THEN 'same_language' WHEN page_number > 1 AND page_number % 3 = 0 THEN 'no_text_layer_or_marked_md' END AS reason FROM p")
def mt_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_number")
    r = route(F.col("lang"), "en", F.when(n == 1, "x"), F.when(n % 3 != 0, "x"))
    return pages(spark, sf_dir).select("page_id", r.alias("r")).select("page_id", "r.mode", "r.reason")


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir).filter("lang <> 'en'").withColumn("k", F.col("block_index") % 10)
    return b.groupBy("page_id").agg(A.marked(F.col("k"), F.col("k"), F.lit("text"), F.col("text"), F.array().cast("array<int>"), F.lit(2481)).alias("md"))


def unified(marked: DataFrame, blocks_: DataFrame, translate: Callable[[Column], Column]) -> DataFrame:
    """(block_id, text): a page translated at once, its blocks found by their markers; blocks without a number are dropped."""
    t = marked.select("page_id", F.col("md"), translate(F.col("md")).alias("out"))
    found = t.select("page_id", F.explode(X.extract_blocks(F.col("out"))).alias("k", "text"))
    return found.join(blocks_, ["page_id", "k"]).select("block_id", "text")


@query("mt_unified", f"{V} SELECT block_id, trim(regexp_replace(upper(replace(text, 'ß', 'ss')), '\\s+', ' ', 'g')) AS text FROM b WHERE lang <> 'en' AND trim(text) <> ''")
def mt_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = blocks(spark, sf_dir).select("block_id", "page_id", (F.col("block_index") % 10).alias("k"))
    return unified(marked_pages(spark, sf_dir), own, translator(Stub, 10**6))


@query("mt_legacy", f"{V} SELECT block_id, regexp_replace(upper(replace(trim(text), 'ß', 'ss')), '\\s+', ' ', 'g') AS text FROM b WHERE lang <> 'en' AND trim(text) <> ''")
def mt_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block by block, long ones in chunks; white space is collapsed, as chunks may be parted anywhere in it."""
    b = blocks(spark, sf_dir).filter("lang <> 'en'").withColumn("t", X.strip(F.col("text"))).filter("t <> ''")
    return b.select("block_id", F.regexp_replace(translator(Stub, 1575)(F.col("t")), r"\s+", " ").alias("text"))


@query("mt_validate", "SELECT doc_id, ceil(length(text) / 4.0::DOUBLE) > 450 AS too_long FROM documents")
def mt_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose estimated tokens exceed the limit; a warning only."""
    return table(spark, sf_dir, "documents").select("doc_id", (F.ceil(F.length("text") / F.lit(4.0)) > 450).alias("too_long"))


@query("udf_language", "SELECT doc_id, CASE WHEN length(trim(text)) >= 20 THEN lang END AS lang FROM documents")
def udf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language plug: text to weights; the stub weighs the declared language, and short texts have none."""
    weights = F.when(F.length(F.trim("text")) >= 20, F.create_map("lang", F.lit(1.0)))
    return table(spark, sf_dir, "documents").select("doc_id", F.get(F.map_keys(weights), F.lit(0)).alias("lang"))
