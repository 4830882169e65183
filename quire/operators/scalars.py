"""Scalar functions applied to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.catalog import query
from quire.functions import chunk, geometry, imaging, paths
from quire.functions import languages as L
from quire.functions import text as X
from quire.sources.tables import VIEWS, blocks, pages, table

V = f"WITH {VIEWS}"


@query(
    "fn_strip_html",
    r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '(?m)^#+\s*', '', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '"'), '\s+', ' ', 'g')) AS text FROM pages""",
)
def fn_strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked texts of well-formed, unterminated and emptied blocks."""
    lines = F.slice(F.split("text", "\n", -1), 1, 4)
    wrapped = F.transform(lines, lambda t, i: F.concat(F.format_string("[#%03d]\n", i), t, F.format_string("\n[/#%03d]", i)))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(wrapped, "\n\n").alias("md"))


@query("fn_extract_blocks", "SELECT doc_id, CAST(i - 1 AS INTEGER) AS block_index, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))[1:4]) AS t, generate_subscripts(string_split(text, chr(10))[1:4], 1) AS i FROM documents) WHERE trim(t) <> ''")
def fn_extract_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _marked(spark, sf_dir).select("doc_id", X.extract_blocks(F.col("md")).alias("m"))
    return m.select("doc_id", F.explode("m").alias("block_index", "text"))


@query("fn_strip_markers", "SELECT doc_id, trim(regexp_replace(array_to_string(list_transform(string_split(text, chr(10))[1:4], lambda t: t), chr(10) || chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')) AS text FROM documents")
def fn_strip_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select("doc_id", X.strip_markers(F.col("md")).alias("text"))


@query("fn_marker_wrap", f"{V} SELECT block_id, concat_ws(chr(10), printf('[#%03d]', block_index), CASE WHEN trim(text) = '' THEN NULL WHEN category = 'Title' THEN '## ' || trim(text) ELSE trim(text) END, printf('[/#%03d]', block_index)) AS marked FROM b")
def fn_marker_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<int>")
    return blocks(spark, sf_dir).select("block_id", X.wrap_block(F.col("block_index"), F.col("category"), F.col("text"), none, F.lit(2481)).alias("marked"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-number boxes derived from ids: (vec_id, a, b), corners in order."""
    v = F.col("vec_id")
    a = F.array(v % 90, v % 70, v % 90 + v % 31 + 1, v % 70 + v % 17 + 1)
    b = F.array(v % 60, v % 80, v % 60 + v % 41 + 1, v % 80 + v % 23 + 1)
    return table(spark, sf_dir, "embeddings").select("vec_id", a.cast("array<double>").alias("a"), b.cast("array<double>").alias("b"))


_BOXES = """boxes AS (SELECT vec_id, CAST(vec_id % 90 AS DOUBLE) AS ax, CAST(vec_id % 70 AS DOUBLE) AS ay, CAST(vec_id % 90 + vec_id % 31 + 1 AS DOUBLE) AS ax2, CAST(vec_id % 70 + vec_id % 17 + 1 AS DOUBLE) AS ay2,
  CAST(vec_id % 60 AS DOUBLE) AS bx, CAST(vec_id % 80 AS DOUBLE) AS bz, CAST(vec_id % 60 + vec_id % 41 + 1 AS DOUBLE) AS bx2, CAST(vec_id % 80 + vec_id % 23 + 1 AS DOUBLE) AS bz2 FROM embeddings),
inter AS (SELECT *, greatest(0, least(ax2, bx2) - greatest(ax, bx)) * greatest(0, least(ay2, bz2) - greatest(ay, bz)) AS i, (ax2 - ax) * (ay2 - ay) AS sa, (bx2 - bx) * (bz2 - bz) AS sb FROM boxes)"""


@query("fn_iou", f"WITH {_BOXES} SELECT vec_id, i / (sa + sb - i) AS iou FROM inter")
def fn_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("vec_id", geometry.iou(F.col("a"), F.col("b")).alias("iou"))


@query("fn_union_area", f"WITH {_BOXES} SELECT vec_id, sa + sb - i AS area FROM inter")
def fn_union_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("vec_id", geometry.union_area(F.array("a", "b")).alias("area"))


@query("fn_cover_ratio", f"WITH {_BOXES} SELECT vec_id, least(1.0, ((CASE WHEN sa / 8000 > 0.002 THEN sa ELSE 0 END) + (CASE WHEN sb / 8000 > 0.002 THEN sb ELSE 0 END) - (CASE WHEN sa / 8000 > 0.002 AND sb / 8000 > 0.002 THEN i ELSE 0 END)) / 8000) AS ratio FROM inter")
def fn_cover_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("vec_id", geometry.cover_ratio(F.array("a", "b"), F.lit(100.0), F.lit(80.0)).alias("ratio"))


@query("fn_flip_y", f"WITH {_BOXES} SELECT vec_id, 200 - ay2 AS top, 200 - ay AS bottom FROM boxes")
def fn_flip_y(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = geometry.flipped(F.col("a"), F.lit(200.0))
    return _boxes(spark, sf_dir).select("vec_id", f[1].alias("top"), f[3].alias("bottom"))


@query("fn_merge_intervals", f"WITH {_BOXES} SELECT vec_id, CASE WHEN greatest(ax, bx) <= least(ax2, bx2) THEN 1 ELSE 2 END AS n, CASE WHEN greatest(ax, bx) <= least(ax2, bx2) THEN greatest(ax2, bx2) - least(ax, bx) ELSE ax2 - ax + bx2 - bx END AS covered FROM boxes")
def fn_merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array(F.array(F.col("a")[0], F.col("a")[2]), F.array(F.col("b")[0], F.col("b")[2]))
    m = _boxes(spark, sf_dir).select("vec_id", geometry.merged_intervals(spans).alias("m"))
    return m.select("vec_id", F.size("m").alias("n"), F.aggregate("m", F.lit(0.0), lambda acc, x: acc + x[1] - x[0]).alias("covered"))


@query("fn_crop", f"WITH {_BOXES} SELECT vec_id, least(50, CAST(floor(ax2 / 100 * 50) AS INTEGER)) AS x1, least(40, CAST(floor(ay2 / 80 * 40) AS INTEGER)) AS y1 FROM boxes")
def fn_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = geometry.normalised(F.col("a"), F.lit(100), F.lit(80))
    c = geometry.crop_bounds(n, F.lit(50), F.lit(40))
    return _boxes(spark, sf_dir).select("vec_id", c[2].alias("x1"), c[3].alias("y1"))


@query("fn_norm_bbox", f"WITH {_BOXES} SELECT vec_id, ax / 2481 AS x0, ay2 / 3508 AS y1 FROM boxes")
def fn_norm_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = geometry.normalised(F.col("a"), F.lit(2481), F.lit(3508))
    return _boxes(spark, sf_dir).select("vec_id", n[0].alias("x0"), n[3].alias("y1"))


@query("fn_denorm_bbox", f"WITH {_BOXES} SELECT vec_id, CAST(trunc(ax / 128 * 2481) AS INTEGER) AS x0, CAST(trunc(ay2 / 128 * 3508) AS INTEGER) AS y1 FROM boxes")
def fn_denorm_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = geometry.denormalised(F.transform("a", lambda x: x / 128), F.lit(2481), F.lit(3508))
    return _boxes(spark, sf_dir).select("vec_id", n[0].alias("x0"), n[3].alias("y1"))


@query("fn_norm_bbox4", f"WITH {_BOXES} SELECT vec_id, CAST(least(ax, bx) AS INTEGER) AS x0, CAST(greatest(ay2, bz2) AS INTEGER) AS y1 FROM boxes")
def fn_norm_bbox4(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    points = F.array(F.array(a[0], a[1]), F.array(a[2], a[3]), F.array(b[0], b[1]), F.array(b[2], b[3]))
    box = geometry.bounds_of(points)
    return _boxes(spark, sf_dir).select("vec_id", box[0].alias("x0"), box[3].alias("y1"))


@query("fn_image_name", f"WITH {_BOXES} SELECT vec_id, printf('imgs/img_in_image_box_%d_%d_%d_%d.jpg', ax::INT, ay::INT, ax2::INT, ay2::INT) AS name FROM boxes")
def fn_image_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("vec_id", X.image_name(F.col("a").cast("array<int>")).alias("name"))


@query("fn_image_pct", f"WITH {_BOXES} SELECT vec_id, greatest(10, least(100, CAST(trunc((ax2 - ax) / 24 * 100) AS INTEGER))) AS pct FROM boxes")
def fn_image_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("vec_id", X.image_percent(F.col("a"), F.lit(24)).alias("pct"))


@query("fn_norm_label", "SELECT doc_id, CASE lang WHEN 'en' THEN 'Picture' WHEN 'fr' THEN 'Seal' WHEN 'de' THEN 'Footnote' ELSE 'Unknown' END AS category FROM documents")
def fn_norm_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("lang") == "en", "IMAGE").when(F.col("lang") == "fr", "stamp").when(F.col("lang") == "de", "footnote").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", X.category_of(raw).alias("category"))


@query("fn_ws_collapse", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def fn_ws_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.collapse(F.col("text")).alias("text"))


_LANG = "CASE doc_id % 4 WHEN 0 THEN 'sr-Cyrl' WHEN 1 THEN 'EN-us' WHEN 2 THEN '' ELSE lang END"


@query("fn_lang_key", f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'sr' WHEN 1 THEN 'en' WHEN 2 THEN '__default__' ELSE lang END AS k FROM documents")
def fn_lang_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", L.language_key(F.expr(_LANG)).alias("k"))


@query("fn_lang_fallback", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN 'de' WHEN doc_id % 2 = 0 THEN 'nl' ELSE 'en' END AS lang FROM documents")
def fn_lang_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    page, doc = F.when(i % 3 == 0, F.col("lang")).when(i % 3 == 1, ""), F.when(i % 3 == 1, "de")
    declared = F.when(i % 2 == 0, F.array(F.lit("nl"), F.lit("fr"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select("doc_id", L.language_fallback(page, doc, declared).alias("lang"))


@query("fn_tess_arg", "SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' END || CASE WHEN lang = 'nl' THEN '' ELSE '+nld+xx' END AS arg FROM documents")
def fn_tess_arg(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = F.array("lang", F.lit(" NL "), F.lit("xx"), "lang")
    return table(spark, sf_dir, "documents").select("doc_id", L.ocr_argument(langs).alias("arg"))


@query("fn_chunk")
def fn_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at most 1575 characters. Greedy filling has no SQL form; tests hold it against a plain version."""
    d = table(spark, sf_dir, "documents").select("doc_id", chunk.chunks(F.col("text"), F.lit(1575)).alias("c"))
    return d.select("doc_id", F.posexplode("c").alias("chunk_index", "chunk"))


@query("fn_sentence_split")
def fn_sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every text. Look-behind can't be said in the oracle's dialect; tests hold it against a plain version."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("k", "sentence"))


@query("fn_batched", "SELECT doc_id, n, CAST(ceil(n / 6) AS INTEGER) AS batches, CAST(CASE WHEN n % 6 = 0 THEN 6 ELSE n % 6 END AS INTEGER) AS last FROM (SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n FROM documents)")
def fn_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("x")).select("doc_id", F.size("x").alias("n"), chunk.batches(F.col("x"), 6).alias("b"))
    return d.select("doc_id", "n", F.size("b").alias("batches"), F.size(F.element_at("b", -1)).alias("last"))


@query("fn_reassemble", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM documents")
def fn_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", chunk.reassembled(F.split("text", "\n", -1)).alias("text"))


@query("fn_max_chars", "SELECT 'opus' AS family, 1575 AS max_chars UNION ALL SELECT 'translategemma', 7392 UNION ALL SELECT 'gemma', 7392 UNION ALL SELECT 'nllb', 3800 UNION ALL SELECT 'm2m100', 3800 UNION ALL SELECT 'mbart', 3800 UNION ALL SELECT 'unknown', 1575 UNION ALL SELECT 'vllm', 7680 UNION ALL SELECT 'google/TranslateGemma-12b-it', 7392 UNION ALL SELECT '__default__', 1575")
def fn_max_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spark.createDataFrame([(n,) for n in ("opus", "translategemma", "gemma", "nllb", "m2m100", "mbart", "unknown", "vllm", "google/TranslateGemma-12b-it", "__default__")], "family string")
    f = f.select("family", L.limit_of(F.col("family"), F.lit("ct2")).alias("limit"))
    return f.select("family", L.most_characters(F.col("limit")).alias("max_chars"))


@query("fn_script_cpt", "SELECT doc_id, CAST(CASE doc_id % 4 WHEN 0 THEN 4.0 WHEN 1 THEN 3.0 WHEN 2 THEN 1.5 ELSE 3.5 END AS DOUBLE) AS cpt FROM documents")
def fn_script_cpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.expr("CASE doc_id % 4 WHEN 0 THEN 'Latn' WHEN 1 THEN 'Cyrl' WHEN 2 THEN 'Hans' END")
    return table(spark, sf_dir, "documents").select("doc_id", L.script_characters(s).alias("cpt"))


@query("fn_output_uri", f"{V} SELECT page_id, printf('documents/%09d/a+b c.md', doc_id) AS rel FROM p")
def fn_output_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both slash forms lead to one relative path."""
    rel = F.concat(F.format_string("documents/%09d", "doc_id"), F.lit("/a+b%20c.md"))
    uri = F.when(F.col("page_id") % 2 == 0, paths.to_uri(rel)).otherwise(F.concat(F.lit("output://"), rel))
    return pages(spark, sf_dir).select("page_id", paths.from_uri(uri).alias("rel"))


@query("fn_traversal", "SELECT doc_id, doc_id % 3 <> 1 AS ok FROM documents")
def fn_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = F.expr("CASE doc_id % 3 WHEN 0 THEN 'documents/safe.txt' WHEN 1 THEN 'a/../../etc/passwd' ELSE 'a/./b/../c' END")
    return table(spark, sf_dir, "documents").select("doc_id", paths.depth_ok(rel).alias("ok"))


@query("fn_doc_path", f"{V} SELECT page_id, printf('documents/%09d/%04d', doc_id, page_number) AS path FROM p")
def fn_doc_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", paths.page_dir(F.col("doc_id"), F.col("page_number")).alias("path"))


@query("fn_doc_key", "SELECT doc_id, '20240615T103045_my_report__' || doc_id || '_.pdf' AS doc_key FROM documents")
def fn_doc_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("in/my report ("), F.col("doc_id").cast("string"), F.lit(").pdf"))
    return table(spark, sf_dir, "documents").select("doc_id", paths.document_key(name, F.lit("2024-06-15 10:30:45").cast("timestamp")).alias("doc_key"))


@query("fn_clamp_dpi", "SELECT doc_id, greatest(150, least(600, CAST(doc_id AS INTEGER))) AS dpi FROM documents")
def fn_clamp_dpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", imaging.clamp(F.col("doc_id")).alias("dpi"))


@query("fn_pdf_dpi", "SELECT vec_id, CASE WHEN 300 * w * 300 * h <= 25000000 THEN 300 ELSE greatest(150, least(600, CAST(floor(sqrt(25000000.0 / (w * h))) AS INTEGER))) END AS dpi FROM (SELECT vec_id, greatest(0.01, (vec_id * 13) % 4000 / 72.0::DOUBLE) AS w, greatest(0.01, (vec_id * 29) % 4000 / 72.0::DOUBLE) AS h FROM embeddings)")
def fn_pdf_dpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("vec_id") * 13 % 4000, F.col("vec_id") * 29 % 4000
    return table(spark, sf_dir, "embeddings").select("vec_id", imaging.pdf_dpi(w, h).alias("dpi"))


@query("fn_raster_dpi", "SELECT vec_id, greatest(150, least(600, CASE WHEN vec_id % 3 = 0 THEN 200 ELSE CAST(round((1000 + vec_id * 7) / 11.69::DOUBLE) AS INTEGER) END)) AS dpi FROM embeddings")
def fn_raster_dpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.when(F.col("vec_id") % 3 == 0, 200.0)
    return table(spark, sf_dir, "embeddings").select("vec_id", imaging.raster_dpi(meta, 1000 + F.col("vec_id") * 7, F.lit(900)).alias("dpi"))


@query("fn_page_type", f"WITH {_BOXES} SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'image-pdf' WHEN (sa + sb - i) / 8000 < 0.05 THEN 'native-pdf' ELSE 'ocr-pdf' END AS page_type FROM inter")
def fn_page_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = geometry.union_area(F.array("a", "b")) / 8000
    return _boxes(spark, sf_dir).select("vec_id", page_type(F.col("vec_id") % 3 != 0, ratio).alias("page_type"))


def page_type(has_text, ratio):
    return F.when(~has_text, "image-pdf").when(ratio < 0.05, "native-pdf").otherwise("ocr-pdf")


@query("fn_utcnow", "SELECT doc_id, true AS recent FROM documents")
def fn_utcnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (F.current_timestamp() > F.lit("2024-01-01").cast("timestamp")).alias("recent"))


def stable_json(config: dict) -> str:
    """Equal configurations have equal texts."""
    import json

    return json.dumps(config, sort_keys=True, default=str, separators=(",", ":"))


MODES = ("default", "repair", "redo")


def parse_mode(value: str) -> str:
    if value not in MODES:
        raise ValueError(f"mode must be one of {MODES}: {value!r}")
    return value


@query("fn_mode_parse", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'default' WHEN 1 THEN 'repair' WHEN 2 THEN 'redo' END AS mode FROM documents")
def fn_mode_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE doc_id % 4 WHEN 0 THEN 'default' WHEN 1 THEN 'repair' WHEN 2 THEN 'redo' ELSE 'DEFAULT' END")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(raw.isin(*MODES), raw).alias("mode"))


@query("fn_stable_json", """SELECT doc_id, '{"a":' || doc_id || ',"b":"' || lang || '"}' AS j FROM documents""")
def fn_stable_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("a"), F.col("lang").alias("b"))).alias("j"))
