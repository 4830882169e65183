"""Resolutions of rendered pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_DPI, MOST_DPI, PIXELS = 150, 600, 25_000_000
A4_LONG_EDGE = 11.69


def clamp(dpi: Column) -> Column:
    return F.greatest(F.lit(LEAST_DPI), F.least(F.lit(MOST_DPI), dpi.cast("int")))


def pdf_dpi(width_pt: Column, height_pt: Column, requested: int = 300) -> Column:
    """The requested resolution, or what keeps the page within the pixel budget."""
    w, h = F.greatest(F.lit(0.01), width_pt / 72.0), F.greatest(F.lit(0.01), height_pt / 72.0)
    want = clamp(F.lit(requested))
    return F.when(want * w * want * h <= PIXELS, want).otherwise(clamp(F.floor(F.sqrt(F.lit(float(PIXELS)) / (w * h)))))


def raster_dpi(meta_dpi: Column, width: Column, height: Column, default: int = 300) -> Column:
    """Metadata first, else as if the long edge were that of A4; halves round to even."""
    guess = F.rint(F.greatest(width, height) / A4_LONG_EDGE).cast("int")
    return clamp(F.coalesce(F.rint(F.nullif(meta_dpi.cast("double"), F.lit(0.0))).cast("int"), F.nullif(guess, F.lit(0)), F.lit(default)))
