"""Artifact paths and output URIs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed list: input extensions.
EXTENSIONS = [".pdf", ".tif", ".tiff", ".png", ".jpg", ".jpeg"]
#: Fixed list: raster extensions of the input kind.
RASTER = [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp"]


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^./\\](\.[^.]+)$", 1))


def accepted(name: Column) -> Column:
    return extension(name).isin(EXTENSIONS)


def kind(name: Column) -> Column:
    return F.when(extension(name) == ".pdf", "pdf").when(extension(name).isin(RASTER), "image").otherwise("unknown")


def depth_ok(rel: Column) -> Column:
    """Whether a relative path never leaves its root."""
    step = lambda acc, s: F.when(acc < 0, acc).when(s == "..", acc - 1).when(s.isin("", "."), acc).otherwise(acc + 1)
    return F.aggregate(F.split(rel, "/"), F.lit(0), step) >= 0


def to_uri(rel: Column) -> Column:
    return F.concat(F.lit("output:///"), rel)


def _plain(c: Column) -> Column:
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def from_uri(uri: Column) -> Column:
    """The relative path of a URI with two or three slashes; raises on another scheme, an empty path or one that leaves the root."""
    host = F.trim(_plain(F.regexp_extract(uri, "^output://([^/?#]*)", 1)))
    path = F.ltrim(_plain(F.regexp_extract(uri, "^output://[^/?#]*([^?#]*)", 1)), F.lit("/"))
    rel = F.concat_ws("/", F.nullif(host, F.lit("")), F.nullif(path, F.lit("")))
    wrong = F.raise_error(F.concat(F.lit("Not an output:// URI: "), uri))
    return F.when(~uri.startswith("output://"), wrong).when(rel == "", F.raise_error(F.lit("Malformed output:// URI"))).when(~depth_ok(rel), F.raise_error(F.lit("path escapes OUTPUT_ROOT"))).otherwise(rel)


def page_dir(doc_id: Column, page_number: Column) -> Column:
    ok = F.format_string("documents/%09d/%04d", doc_id, page_number)
    return F.when(page_number < 1, F.raise_error(F.lit("page_number must be >= 1"))).otherwise(ok)


def page_image(doc_id: Column, page_number: Column, ext: str = ".png") -> Column:
    ext = ext if ext.startswith(".") else f".{ext}"
    return F.concat(page_dir(doc_id, page_number), F.format_string(f"/p%04d_source{ext}", page_number))


def document_key(filename: Column, now: Column) -> Column:
    base = F.coalesce(F.nullif(F.regexp_extract(filename, r"([^/]*)$", 1), F.lit("")), F.lit("document"))
    safe = F.regexp_replace(F.regexp_replace(base, r"[^\p{L}\p{N}._-]", "_"), r"^[._-]+|[._-]+$", "")
    return F.concat(F.date_format(now, "yyyyMMdd'T'HHmmss"), F.lit("_"), F.coalesce(F.nullif(safe, F.lit("")), F.lit("document")))
