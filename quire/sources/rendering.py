"""Rendering of files to page images: the plan is ours, the renderer a plug.

A renderer is a class with pages(content: bytes, name: str) -> iterable of (width_pt, height_pt, image bytes). It is made
once for each Python worker, where a library for PDF or raster files can be imported; none is needed here. The stub takes
lines for pages and makes no image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.catalog import query
from quire.functions import imaging, paths
from quire.sources.tables import table


class LinePages:
    """The stub: ten lines of text are an A4 page."""

    def pages(self, content: bytes, name: str) -> Iterator[tuple[float, float, bytes]]:
        for _ in range(0, content.count(b"\n") + 1, 10):
            yield 595.0, 842.0, b""


def rendered(files: DataFrame, make: Callable[[], object]) -> DataFrame:
    """files (doc_id, filename, content) as (doc_id, page_number, width_pt, height_pt, image); a file that fails has no page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        renderer = make()
        for b in batches:
            for doc_id, name, content in zip(b["doc_id"], b["filename"], b["content"], strict=True):
                try:
                    rows = [(doc_id, n, w, h, image) for n, (w, h, image) in enumerate(renderer.pages(content, name), 1)]
                except Exception:  # noqa: BLE001  one broken file must not stop the others
                    rows = []
                yield pd.DataFrame(rows, columns=["doc_id", "page_number", "width_pt", "height_pt", "image"])

    return files.select("doc_id", "filename", "content").mapInPandas(run, "doc_id long, page_number int, width_pt double, height_pt double, image binary")


def _pages(spark: SparkSession, sf_dir: str, suffix: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    files = d.select("doc_id", F.concat(F.lit("scan"), F.col("doc_id").cast("string"), F.lit(suffix)).alias("filename"), F.col("text").cast("binary").alias("content"))
    return rendered(files.filter(paths.accepted(F.col("filename"))), LinePages)


_SQL = "SELECT doc_id, CAST(i + 1 AS INTEGER) AS page_number, {} AS dpi FROM (SELECT doc_id, unnest(range((len(string_split(text, chr(10))) + 9) // 10)) AS i FROM documents)"


@query("src_pdf_pages", _SQL.format("300"))
def src_pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir, ".pdf")
    return p.select("doc_id", "page_number", imaging.pdf_dpi(F.col("width_pt"), F.col("height_pt")).alias("dpi"))


@query("src_tiff_frames", _SQL.format("greatest(150, least(600, 72))"))
def src_tiff_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir, ".tiff")
    return p.select("doc_id", "page_number", imaging.raster_dpi(F.lit(None).cast("double"), F.col("width_pt"), F.col("height_pt")).alias("dpi"))


@query("src_raster", _SQL.format("200") + " WHERE i = 0")
def src_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir, ".png").filter("page_number = 1")
    return p.select("doc_id", "page_number", imaging.raster_dpi(F.lit(200.0), F.col("width_pt"), F.col("height_pt")).alias("dpi"))
