"""The end-to-end jobs: from detected items to stored boxes, and from boxes to a redaction list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubframe.functions.boxes import box, rect_area
from scrubframe.operators import allowlist, pii, rects
from scrubframe.operators.redact import collect_box_sources


def items_to_rects(items: DataFrame, entities: DataFrame | None = None, engine: str | None = "allowlist",
                   regions: DataFrame | None = None) -> DataFrame:
    """Stored boxes from detected items: certain items, flagged for personal data, without huge fonts
    and, when image regions are given, without boxes inside them.

    The allowlist and registered detectors flag row by row; entities found elsewhere come as a
    table keyed by ``text_id``. Without an engine nothing is checked.
    """
    kept = rects.confidence_filter(items)
    if engine is None:
        flagged = kept.withColumn("nerpii", F.lit(-1))
    elif entities is None:
        flagged = kept.withColumn("nerpii", pii.sensitivity(F.col("ocrtext"), engine))
    else:
        named = kept.withColumn("text", F.col("ocrtext"))
        flagged = pii.pii_flag(named, entities, engine).withColumn("nerpii", F.col("is_sensitive")).drop("text", "is_sensitive")
    plain = rects.drop_huge_font(flagged)
    return rects.drop_inside_regions(plain, regions) if regions is not None else plain


def boxes_to_redact(found: DataFrame, glossary: DataFrame | None = None, **more: DataFrame) -> DataFrame:
    """Boxes to apply: stored boxes whose text is not safe, boxes of other sources, none hidden in another.

    A text is safe when the allowlist has stored it as such or matches it now.
    """
    stored = rects.drop_huge_font(rects.rects_valid(found))
    unsafe = allowlist.apply_allowlist_before_redaction(stored, glossary)
    sources = collect_box_sources(stored=unsafe, **more)
    return rects.maximal_rects(sources, counted=collect_box_sources(stored=found, **more))


def redaction_summary(boxes: DataFrame) -> DataFrame:
    """Boxes and covered area per file."""
    return boxes.groupBy("filename").agg(F.count(F.lit(1)).alias("n_boxes"), F.sum(rect_area(box())).alias("area"))
