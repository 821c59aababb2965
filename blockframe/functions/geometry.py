"""Column functions on boxes and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col


def absolute_box(left, top, width, height, page_width, page_height) -> dict[str, Column]:
    """Corners in page units of a box given as fractions of the page."""
    left, top, width, height = map(_col, (left, top, width, height))
    page_width, page_height = _col(page_width), _col(page_height)
    return {
        "abs_left": left * page_width,
        "abs_top": top * page_height,
        "abs_right": left * page_width + width * page_width,
        "abs_bottom": top * page_height + height * page_height,
    }


def page_in_range(page, page_count) -> Column:
    """Whether a one-based page number exists in the document; never null."""
    page = _col(page)
    return F.coalesce((page >= 1) & (page <= _col(page_count)), F.lit(False))


def box_columns(box: Column, prefix: str) -> list[Column]:
    """Flatten a bounding-box struct into ``<prefix>_width, _height, _left, _top``."""
    return [
        box.getField(name).alias(f"{prefix}_{name.lower()}")
        for name in ("Width", "Height", "Left", "Top")
    ]
