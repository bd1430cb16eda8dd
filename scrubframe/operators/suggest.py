"""Boxes suggested for a file from reviewed files of the same device, image type and size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubframe.functions.boxes import BOX_COLUMNS, box, rect_is_valid
from scrubframe.operators.rects import fold_rects

SIMILAR_KEYS = ["modality", "image_type", "n_rows", "n_cols", "model"]


def _reviewed_boxes(review: DataFrame, rects: DataFrame, frame: int | None, overlay: int | None,
                    only_done: bool) -> DataFrame:
    rows = rects.where(rect_is_valid(box()))
    if frame is not None and overlay is not None and not (frame == -1 and overlay == -1):
        rows = rows.where((F.col("frame") == frame) & (F.col("overlay") == overlay))
    files = review.where(~F.col("mark")) if only_done else review
    return rows.join(files.select("filename", *SIMILAR_KEYS), "filename")


def device_suggestions(review: DataFrame, rects: DataFrame, frame: int | None = None, overlay: int | None = None,
                       only_done: bool = False) -> DataFrame:
    """Distinct boxes per device key with the number of files showing each and, if it is one, its name.

    A popular device costs one combinable record per distinct box, not one per pair of files.
    """
    pairs = _reviewed_boxes(review, rects, frame, overlay, only_done)
    shown = pairs.groupBy(*SIMILAR_KEYS, *BOX_COLUMNS).agg(
        F.min("filename").alias("_a"), F.max("filename").alias("_z"))
    return shown.select(*SIMILAR_KEYS, *BOX_COLUMNS,
                        F.when(F.col("_a") == F.col("_z"), F.col("_a")).alias("only_file"))


def suggestion_counts(targets: DataFrame, review: DataFrame, rects: DataFrame, frame: int | None = None,
                      overlay: int | None = None, only_done: bool = False) -> DataFrame:
    """Distinct boxes available to each target from *other* files of its device.

    That is the device's distinct boxes less those only the target itself shows, so whole
    archives are answered without pairing files.
    """
    found = device_suggestions(review, rects, frame, overlay, only_done)
    per_device = found.groupBy(*SIMILAR_KEYS).agg(F.count(F.lit(1)).alias("_all"))
    own = (found.where(F.col("only_file").isNotNull()).groupBy("only_file")
           .agg(F.count(F.lit(1)).alias("_own")).withColumnRenamed("only_file", "filename"))
    rows = targets.select("filename", *SIMILAR_KEYS).join(per_device, SIMILAR_KEYS, "left").join(own, "filename", "left")
    n: Column = F.coalesce("_all", F.lit(0)) - F.coalesce("_own", F.lit(0))
    return rows.select("filename", n.cast("bigint").alias("n_suggested"))


def suggest_similar_rects(targets: DataFrame, review: DataFrame, rects: DataFrame, frame: int | None = None,
                          overlay: int | None = None, coalesce: bool = True, only_done: bool = False) -> DataFrame:
    """The suggested boxes themselves for a worklist of targets.

    The result holds every target's own list, so it grows with targets times boxes of their
    device; ask for the files at hand, and use ``suggestion_counts`` for a whole archive.
    """
    if not coalesce:
        found = device_suggestions(review, rects, frame, overlay, only_done)
        pairs = targets.select("filename", *SIMILAR_KEYS).join(found, SIMILAR_KEYS)
        other = F.col("only_file").isNull() | (F.col("only_file") != F.col("filename"))
        return pairs.where(other).select("filename", *BOX_COLUMNS)
    boxes = (_reviewed_boxes(review, rects, frame, overlay, only_done)
             .withColumnRenamed("filename", "_from"))
    wanted = targets.select("filename", *SIMILAR_KEYS)
    pairs = wanted.join(boxes, SIMILAR_KEYS).where(F.col("_from") != F.col("filename"))
    order = F.concat_ws("|", "_from", F.col("ord").cast("string"))
    keyed = pairs.select("filename", "frame", "overlay", *BOX_COLUMNS, "ocrtext", order.alias("_order"))
    return fold_rects(keyed, order="_order", coalesce=True, group=["filename", "frame", "overlay"])
