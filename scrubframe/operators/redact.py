"""Redaction over a table of frames: one row per (filename, frame, overlay) with its pixels as an array.

Boxes never travel to a frame as a list. Each box adds four signed corner marks; marks at
the same place are summed before the shuffle, and the running sums of the marks along both
axes tell how many boxes cover a pixel. A frame with any number of boxes receives at most
one mark per pixel, so its redaction needs no more memory than the frame itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubframe.functions import pixels as P
from scrubframe.functions.boxes import BOX_COLUMNS
from scrubframe.operators.rects import FRAME_KEYS, rects_valid
from scrubframe.session import only_wanted, split_hot_groups

MARKS = ["mark_x", "mark_y", "mark_d"]


def store_frames(frames: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """Write frames as a table in ``buckets`` buckets by frame, and read it.

    Redaction joins on the same keys, so only the marks move to the buckets and the pixels stay where they are; frames of one
    file lie in many buckets. Choose the number so that a bucket fits a task. ``path`` is a shared folder, or the warehouse.
    """
    writer = frames.write.mode("overwrite").bucketBy(buckets, *FRAME_KEYS).sortBy(*FRAME_KEYS)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return frames.sparkSession.table(table)


def collect_box_sources(**sources: DataFrame) -> DataFrame:
    """Union of boxes from several sources, with the source's name in ``source``."""
    keep = [*FRAME_KEYS, *BOX_COLUMNS]
    parts = [df.select(*keep).withColumn("source", F.lit(name)) for name, df in sources.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def rects_to_frames(rects: DataFrame, frames: DataFrame) -> DataFrame:
    """Boxes with the frames they apply to; frame and overlay -1 means every frame and overlay of the file.

    Frame -1 with an overlay means that overlay on every frame. Three equality joins and a union, so every part hashes or
    sorts on its keys.
    """
    targets = frames.select(*FRAME_KEYS)
    out = None
    for cond, keys in _reach():
        part = rects.where(cond).select(*keys, *BOX_COLUMNS).join(targets, keys).select(*FRAME_KEYS, *BOX_COLUMNS)
        out = part if out is None else out.unionByName(part)
    return out


def _reach() -> list[tuple[Column, list[str]]]:
    """Which boxes meet frames on which keys: one frame, all frames of an overlay, or the whole file."""
    any_frame, any_overlay = F.col("frame") == -1, F.col("overlay") == -1
    return [(~any_frame, FRAME_KEYS), (any_frame & ~any_overlay, ["filename", "overlay"]), (any_frame & any_overlay, ["filename"])]


def _marks(few: DataFrame, many: DataFrame | None, keys: list[str], sizes: DataFrame) -> DataFrame:
    """Corner marks per key as three parallel arrays, clipped to the frame size.

    Boxes of ``few`` meet the frame sizes first and their marks are summed where they lie,
    after a single shuffle. Those of ``many`` sum their marks before the shuffle instead.
    """
    left, top = F.col("box_left").cast("int"), F.col("box_top").cast("int")
    right, bottom = F.col("box_right").cast("int") + 1, F.col("box_bottom").cast("int") + 1
    corners = F.array(*(F.struct(x.alias("x"), y.alias("y"), F.lit(d).alias("d"))
                        for x, y, d in ((left, top, 1), (right, top, -1), (left, bottom, -1), (right, bottom, 1))))
    size = ["n_rows", "n_cols"]

    def summed(marks: DataFrame, extra: list[str]) -> DataFrame:
        return marks.groupBy(*keys, *extra, "x", "y").agg(F.sum("d").alias("d")).where("d <> 0")

    placed = few.join(sizes, keys).select(*keys, *size, F.inline(corners))
    if many is not None:
        before = summed(many.select(*keys, F.inline(corners)), []).join(sizes, keys)
        placed = placed.unionByName(before)
    clipped = (placed.withColumn("x", F.least("x", "n_cols")).withColumn("y", F.least("y", "n_rows"))
               .where((F.col("x") < F.col("n_cols")) & (F.col("y") < F.col("n_rows"))))
    listed = summed(clipped, size).groupBy(*keys).agg(F.collect_list(F.struct("x", "y", "d")).alias("_m"))
    return listed.select(*keys, *(F.col(f"_m.{c}").alias(n) for c, n in zip("xyd", MARKS)))


def frame_marks(rects: DataFrame, frames: DataFrame, hot: int = 4096) -> DataFrame:
    """Marks of every frame that has boxes: its own, those of boxes on all frames of its overlay and of whole-file boxes."""
    inside = ((F.col("box_left") >= 0) & (F.col("box_top") >= 0) & (F.col("box_right") >= F.col("box_left"))
              & (F.col("box_bottom") >= F.col("box_top")))
    sizes = frames.select(*FRAME_KEYS, "n_rows", "n_cols")
    boxes = only_wanted(rects.where(inside).select(*FRAME_KEYS, *BOX_COLUMNS), frames, "filename")
    few, many = split_hot_groups(boxes, FRAME_KEYS, hot)
    both, have = sizes.select(*FRAME_KEYS), []
    for i, (cond, keys) in enumerate(_reach()):
        size = sizes if keys == FRAME_KEYS else sizes.groupBy(*keys).agg(F.max("n_rows").alias("n_rows"), F.max("n_cols").alias("n_cols"))
        marks = _marks(few.where(cond), None if many is None else many.where(cond), keys, size)
        both = both.join(marks.select(*keys, *(F.col(c).alias(f"{c}_{i}") for c in MARKS)), keys, "left")
        have.append(F.col(f"mark_x_{i}").isNotNull())
    none = F.array().cast("array<bigint>")
    return both.where(have[0] | have[1] | have[2]).select(*FRAME_KEYS, *(F.concat(
        *(F.coalesce(F.col(f"{c}_{i}").cast("array<bigint>"), none) for i in range(len(have)))).alias(c) for c in MARKS))


def _covered(rows: int, cols: int, x: np.ndarray, y: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Boolean (rows, cols): the pixel lies in at least one box."""
    grid = np.zeros((rows + 1, cols + 1), dtype=np.int64)
    np.add.at(grid, (np.minimum(y, rows), np.minimum(x, cols)), d)
    return grid.cumsum(axis=0).cumsum(axis=1)[:rows, :cols] > 0


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _mask_pixels(pixels: pd.Series, rows: pd.Series, cols: pd.Series, samples: pd.Series, keep: pd.Series,
                 x: pd.Series, y: pd.Series, d: pd.Series) -> pd.Series:
    def one(p, h, w, s, k, mx, my, md):
        if p is None:
            return None
        shaped = np.array(p, dtype=np.int32).reshape(h, w, s)
        shaped[_covered(h, w, mx, my, md)] &= np.int32(k)
        return shaped.ravel()

    return pd.Series([one(*row) for row in zip(pixels, rows, cols, samples, keep, x, y, d)], dtype=object)


@F.pandas_udf(T.LongType())
def _count_left(pixels: pd.Series, rows: pd.Series, cols: pd.Series, samples: pd.Series, watch: pd.Series,
                x: pd.Series, y: pd.Series, d: pd.Series) -> pd.Series:
    def one(p, h, w, s, bits, mx, my, md):
        shaped = np.array(p, dtype=np.int32).reshape(h, w, s)
        return int(np.count_nonzero(shaped[_covered(h, w, mx, my, md)] & np.int32(bits)))

    return pd.Series([one(*row) for row in zip(pixels, rows, cols, samples, watch, x, y, d)], dtype="int64")


def _apply(frames: DataFrame, marks: DataFrame, keep: Column) -> DataFrame:
    """Frames with ``pixels & keep`` inside the marked area; frames without marks skip the Python step."""
    joined = frames.join(marks, FRAME_KEYS, "left")
    marked = F.col("mark_x").isNotNull()
    masked = _mask_pixels(F.when(marked, F.col("pixels")), "n_rows", "n_cols", "samples", keep.cast("int"),
                          *(F.when(marked, F.col(c)) for c in MARKS))
    return joined.withColumn("_new", masked).select(
        *(F.coalesce("_new", "pixels").alias("pixels") if c == "pixels" else c for c in frames.columns))


def stored_bits(bits: Column) -> Column:
    """Mask of the bits that hold the image."""
    return F.call_function("shiftleft", F.lit(1), bits.cast("int")) - 1


def redact_frames(frames: DataFrame, rects: DataFrame) -> DataFrame:
    """Blacken the boxes of plain frames; bits above ``bits_stored`` survive. Overlay frames are not touched."""
    plain = rects.where((F.col("overlay") == -1))
    images = frames.where(F.col("overlay") == -1)
    done = _apply(images, frame_marks(plain, images), F.bitwise_not(stored_bits(F.col("bits_stored"))))
    return done.unionByName(frames.where(F.col("overlay") != -1))


def redact_overlay_frame(frames: DataFrame, rects: DataFrame) -> DataFrame:
    """Zero the boxes of stand-alone overlay frames; image frames are not touched."""
    overlays = frames.where(F.col("overlay") >= 0)
    boxes = rects.where((F.col("overlay") >= 0) | ((F.col("frame") == -1) & (F.col("overlay") == -1)))
    done = _apply(overlays, frame_marks(boxes, overlays), F.lit(0))
    return done.unionByName(frames.where(F.col("overlay") < 0))


def overlay_masks(overlays: DataFrame) -> DataFrame:
    """Per file the bits that its overlays occupy in the image: (filename, high). ``overlays`` has filename, overlay and
    bit_position; an overlay without a position stands alone and takes no bit."""
    bit = P.overlay_bit(F.col("bit_position"))
    return overlays.groupBy("filename").agg(F.bit_or(F.when(bit > 0, F.call_function("shiftleft", F.lit(1), bit)).otherwise(0)).alias("high"))


def _with_masks(marks: DataFrame, overlays: DataFrame) -> DataFrame:
    """Marks with their file's bits; marks are small beside the frames, which are not joined for it."""
    return marks.join(overlay_masks(overlays), "filename", "left").withColumn("high", F.coalesce("high", F.lit(0)))


def redact_highbit_overlay(frames: DataFrame, rects: DataFrame, overlay: int, bit: int | DataFrame) -> DataFrame:
    """Clear an overlay's high bit inside its boxes, on every single-sample image frame of the file.

    ``bit`` is one position for all files, or a table (filename, overlay, bit_position): files may keep the overlay in
    different bits, and where it stands alone the image is left as it is.
    """
    boxes = rects.where(F.col("overlay") == overlay).withColumn("frame", F.lit(-1)).withColumn("overlay", F.lit(-1))
    images = frames.where((F.col("overlay") == -1) & (F.col("samples") == 1))
    if isinstance(bit, DataFrame):
        marks = _with_masks(frame_marks(boxes, images), bit.where(F.col("overlay") == overlay))
        done = _apply(images, marks, F.bitwise_not(F.col("high")))
    else:
        done = _apply(images, frame_marks(boxes, images), F.lit(~(1 << bit)))
    return done.unionByName(frames.where((F.col("overlay") != -1) | (F.col("samples") != 1)))


def redact_all(frames: DataFrame, rects: DataFrame, high_bits: int | DataFrame = 0) -> DataFrame:
    """Apply whole-file boxes to every frame, the named high-bit overlays and every overlay frame.

    ``high_bits`` is the mask of overlay bits hidden in the image, or a table (filename, overlay, bit_position) that tells
    them per file; they are cleared with the image.
    """
    whole = rects.where((F.col("frame") == -1) & (F.col("overlay") == -1))
    marks = frame_marks(whole, frames)
    if isinstance(high_bits, DataFrame):
        marks, high = _with_masks(marks, high_bits), F.col("high")
    else:
        high = F.lit(high_bits)
    image_keep = F.bitwise_not(stored_bits(F.col("bits_stored"))).bitwiseAND(F.bitwise_not(high.cast("int")))
    keep = F.when(F.col("overlay") == -1, image_keep).otherwise(0)
    return _apply(frames, marks, keep)


def strip_highbits(frames: DataFrame) -> DataFrame:
    """Remove everything above the stored bits."""
    return frames.withColumn("pixels", P.strip_highbits(F.col("pixels"), F.col("bits_stored")))


def extract_bitplane(frames: DataFrame, bit: int) -> DataFrame:
    return frames.withColumn("pixels", P.extract_bitplane(F.col("pixels"), bit))


def contrast_stretch(frames: DataFrame, invert: str | None = None) -> DataFrame:
    """Rescale every frame to 0..255; ``invert`` names a boolean column."""
    flag = F.col(invert) if invert else None
    return frames.withColumn("pixels", P.contrast_stretch(F.col("pixels"), flag))


def blank_frames(frames: DataFrame) -> DataFrame:
    return frames.withColumn("pixels", P.blank_frame(F.col("pixels")))


def export_rects_no_pii(rects: DataFrame, strip_prefix: str | None = None) -> DataFrame:
    """Box list for publication: never the text, never summaries, and without a private path prefix."""
    name = F.col("filename")
    if strip_prefix:
        prefix = strip_prefix if strip_prefix.endswith("/") or len(strip_prefix) < 2 else strip_prefix + "/"
        name = F.replace(name, F.lit(prefix), F.lit(""))
    return rects_valid(rects).select(name.alias("filename"), *BOX_COLUMNS, "frame", "overlay")


def redaction_report(after: DataFrame, rects: DataFrame) -> DataFrame:
    """Per frame with boxes: boxes, boxes applied, and non-zero image pixels left inside them (0 when redacted).

    Boxes that meet no frame are told too, under the frame they name, with ``n_applied`` 0: their frame or file is missing.
    ``after`` is read several times, so it should be the written result of the redaction.
    """
    images = after.where(F.col("overlay") == -1)
    plain = rects_valid(rects).where(F.col("overlay") == -1)
    left = _count_left("pixels", "n_rows", "n_cols", "samples", stored_bits(F.col("bits_stored")), *MARKS)
    marked = images.join(frame_marks(plain, images), FRAME_KEYS).select(*FRAME_KEYS, left.alias("n_left"))
    # Counted per key first, so the join back to the frames is one to one.
    every = F.col("frame") == -1
    own = plain.where(~every).groupBy(*FRAME_KEYS).agg(F.count(F.lit(1)).alias("_own"))
    whole = plain.where(every).groupBy("filename").agg(F.count(F.lit(1)).alias("_whole"))
    counted = marked.join(own, FRAME_KEYS, "left").join(whole, "filename", "left")
    total = F.coalesce("_own", F.lit(0)) + F.coalesce("_whole", F.lit(0))
    found = counted.select(*FRAME_KEYS, total.alias("n_boxes"), total.alias("n_applied"), "n_left")
    nowhere = own.withColumnRenamed("_own", "n_boxes").join(images.select(*FRAME_KEYS), FRAME_KEYS, "left_anti")
    missing = whole.join(images.select("filename"), "filename", "left_anti").select(
        "filename", F.lit(-1).alias("frame"), F.lit(-1).alias("overlay"), F.col("_whole").alias("n_boxes"))
    none = F.lit(0).cast("bigint")
    return found.unionByName(nowhere.unionByName(missing).select(*FRAME_KEYS, "n_boxes", none.alias("n_applied"), none.alias("n_left")))
