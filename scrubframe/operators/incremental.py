"""Skip what is already stored or already written."""

from __future__ import annotations

from pyspark.sql import DataFrame

from scrubframe.operators.rects import rect_filenames


def skip_processed(files: DataFrame, rects: DataFrame, resolved: str | None = None) -> DataFrame:
    """Files without stored boxes, under their given name and, if named, their resolved path."""
    seen = rect_filenames(rects)
    left = files.join(seen, "filename", "left_anti")
    if resolved:
        left = left.join(seen.withColumnRenamed("filename", resolved), resolved, "left_anti")
    return left


def redact_all_known(rects: DataFrame, outputs: DataFrame) -> DataFrame:
    """Files having boxes whose redacted copy does not exist yet."""
    return rect_filenames(rects).join(outputs.select("filename"), "filename", "left_anti")
