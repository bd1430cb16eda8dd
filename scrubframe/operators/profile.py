"""Profiles of a tag table and of text detection results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubframe.functions.tags import imagetype_parts


# Columns of the flat tag table that are profiled, and those that hold numbers as text.
PROFILE_COLUMNS = [
    "BurnedInAnnotation", "RecognizableVisualFeatures", "Manufacturer", "ManufacturerModelName", "ModelName",
    "SoftwareVersions", "CodeMeaning", "CommentsOnRadiationDose", "ImageType2", "ImageType",
    "ImplementationVersionName", "SeriesDescription", "WindowWidth", "Rows", "Columns", "BitsStored", "BitsAllocated",
    "NumberOfFrames", "OverlayRows", "OverlayColumns", "OverlayType", "NumberOfFramesInOverlay",
    "OverlayDescription", "OverlayBitsAllocated", "OverlayBitPosition",
]
NUMERIC_COLUMNS = ["Rows", "Columns", "NumberOfFrames", "OverlayRows", "OverlayColumns", "NumberOfFramesInOverlay"]


def _long(df: DataFrame, cols: list[str]) -> DataFrame:
    texts = df.select(*(F.col(c).cast("string").alias(c) for c in cols))
    return texts.unpivot([], cols, "column", "value")


def profile_value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows per value of every column, in one pass and one combined shuffle."""
    return _long(df, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def profile_distinct_counts(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """Distinct values of every column; ``approx`` keeps one sketch per column instead of the values."""
    if approx:
        return _long(df, cols).groupBy("column").agg(F.approx_count_distinct("value").alias("n_distinct"))
    return profile_value_counts(df, cols).groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))


def profile_imagetype_short(df: DataFrame, col: str = "image_type") -> DataFrame:
    """Counts of well-formed two-word image types; everything else counts as BAD."""
    words = F.split(F.col(col), r"\\")
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    good = first.isin("ORIGINAL", "DERIVED") & second.isin("PRIMARY", "SECONDARY")
    short = F.when(good, F.concat(first, F.lit("\\"), second)).otherwise("BAD")
    return df.groupBy(short.alias("image_type_short")).agg(F.count(F.lit(1)).alias("n"))


def profile_numeric_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per text column: non-numeric rows, numeric rows, min, max, mean and total; brackets are ignored."""
    bare = F.trim(F.translate(F.col("value"), "[]", ""))
    number = F.expr("try_cast(_text as bigint)")
    long = _long(df, cols).withColumn("_text", F.when(bare.rlike(r"^[+-]?[0-9]+$"), bare)).withColumn("_n", number)
    return long.groupBy("column").agg(
        F.count_if(F.col("_n").isNull()).alias("n_na"), F.count("_n").alias("n"),
        F.min("_n").alias("min"), F.max("_n").alias("max"),
        F.avg("_n").alias("mean"), F.coalesce(F.sum("_n"), F.lit(0)).alias("total"))


def unique_column(df: DataFrame, col: str, by: str = "modality") -> DataFrame:
    """Sorted distinct values of one column per modality."""
    return df.select(by, col).distinct().orderBy(by, col)


def count_per_column(df: DataFrame, cols: list[str]) -> DataFrame:
    """Non-null values of every column as one row per column."""
    return _long(df, cols).groupBy("column").agg(F.count("value").alias("n"))


def text_free_manufacturers(ocr: DataFrame) -> DataFrame:
    """Manufacturers none of whose images contain text."""
    longest = ocr.groupBy("manufacturer").agg(F.max(F.length("ocr_text")).alias("longest"))
    return longest.where(F.col("longest") == 0).select("manufacturer")


def text_length_bands(ocr: DataFrame, at: int = 10) -> DataFrame:
    """Rows and sensitive rows per band; a text of exactly ``at`` characters is in neither outer band."""
    size = F.length("ocr_text")
    band = F.when(size < at, "short").when(size > at, "long").otherwise("exact")
    return ocr.groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_sensitive") == 1).alias("n_sensitive"))


def filter_frame_summaries(ocr: DataFrame) -> DataFrame:
    """Summary rows of plain frames of original images."""
    return ocr.where((F.col("overlay") == -1) & (F.col("box_left") == -1)
                     & F.col("image_type").startswith("ORIG"))


def filter_no_text_frames(ocr: DataFrame) -> DataFrame:
    """Of those, the frames in which nothing was read."""
    return filter_frame_summaries(ocr).where(F.col("ocr_text") == "")


def filter_orig_prim(df: DataFrame, overlay: str = "absent") -> DataFrame:
    """Original primary images whose overlay type tag is ``absent`` or ``present``."""
    if overlay not in ("absent", "present"):
        raise ValueError("overlay is 'absent' or 'present'")
    empty = F.col("overlay_type") == ""
    return df.where(F.col("image_type").contains("ORIGINAL") & F.col("image_type").contains("PRIMARY")
                    & (empty if overlay == "absent" else ~empty))


def normalise_combo_imagetype(df: DataFrame, col: str = "image_type") -> DataFrame:
    """Cut the image type to its known-good two-word prefix; rows with another image type are dropped."""
    prefix = F.regexp_extract(F.col(col), r"^((?:ORIGINAL|DERIVED)\\(?:PRIMARY|SECONDARY))", 1)
    return df.withColumn(col, prefix).where(F.col(col) != "")


def project_with_groupcols(df: DataFrame, group: list[str], cols: list[str]) -> DataFrame:
    """Select columns where ``+`` stands for the group-by columns."""
    return df.select(*(c for name in cols for c in (group if name == "+" else [name])))


def imagetype_words(df: DataFrame, col: str = "image_type") -> DataFrame:
    """The image type as an array column ``image_type_parts``."""
    return df.withColumn("image_type_parts", imagetype_parts(F.col(col)))
