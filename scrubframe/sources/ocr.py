"""Text detection results as CSV and the stored box table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubframe.functions.boxes import BOX_COLUMNS
from scrubframe.functions.text import ner_enum, ner_enum_name, ocr_enum, ocr_enum_name
from scrubframe.session import sorted_by

# Columns of a detection result file.
OCR_COLUMNS = ["filename", "frame", "overlay", "imagetype", "manufacturer", "burnedinannotation", "ocr_engine",
               "left", "top", "right", "bottom", "ocr_text", "ner_engine", "is_sensitive"]
OCR_SCHEMA = ", ".join(f"`{c}` string" for c in OCR_COLUMNS)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OCR_SCHEMA).option("header", True).option("escape", '"').csv(path)


def src_ocr_csv(spark: SparkSession, path: str, filename: str | None = None, frame: int = -1,
                overlay: int = -1) -> DataFrame:
    """Boxes of a result file; rows without a box are dropped and engine names become codes."""
    rows = drop_repeated_headers(_read(spark, path), "filename")
    typed = rows.select(
        "filename", *(F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(c) for c in ("frame", "overlay")),
        *(F.col(n[4:]).cast("int").alias(n) for n in BOX_COLUMNS),
        ocr_enum(F.col("ocr_engine")).alias("ocrengine"), F.coalesce("ocr_text", F.lit("")).alias("ocrtext"),
        ner_enum(F.col("ner_engine")).alias("nerengine"),
        F.coalesce(F.col("is_sensitive").cast("int"), F.lit(-1)).alias("nerpii"))
    kept = typed.where(F.col("box_left") >= 0)
    if filename:
        kept = kept.where(F.col("filename") == filename)
    if frame != -1:
        kept = kept.where(F.col("frame") == frame)
    if overlay != -1:
        kept = kept.where(F.col("overlay") == overlay)
    return kept


def snk_ocr_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """Write boxes in the layout of a result file."""
    optional = {c: F.col(c) if c in df.columns else F.lit("") for c in ("imagetype", "manufacturer", "burnedinannotation")}
    rows = df.select(
        "filename", "frame", "overlay", *(optional[c].alias(c) for c in OCR_COLUMNS[3:6]),
        ocr_enum_name(F.col("ocrengine")).alias("ocr_engine"), *(F.col(n).alias(n[4:]) for n in BOX_COLUMNS),
        F.col("ocrtext").alias("ocr_text"), ner_enum_name(F.col("nerengine")).alias("ner_engine"),
        F.col("nerpii").alias("is_sensitive"))
    rows.write.mode("overwrite").option("header", header).option("escape", '"').option("emptyValue", "").csv(path)


def drop_repeated_headers(df: DataFrame, col: str) -> DataFrame:
    """Concatenated result files repeat their header; a row whose value equals its column name is one."""
    return df.where(~F.coalesce(F.col(col) == col, F.lit(False)))


def ingest_rects_csv(df: DataFrame, imagetype: str | None = None, manufacturer: str | None = None) -> DataFrame:
    """Rows with a full box whose image type and maker match a pattern from the start of the text."""
    kept = df
    for c in BOX_COLUMNS:
        kept = kept.where(F.col(c) != -1)
    if imagetype:
        kept = kept.where(F.col("imagetype").rlike(f"^(?:{imagetype})"))
    if manufacturer:
        kept = kept.where(F.col("manufacturer").rlike(f"^(?:{manufacturer})"))
    return kept.select("filename", "frame", "overlay", *BOX_COLUMNS)


def append_rects(df: DataFrame, path: str) -> None:
    """Append boxes to the stored table with defaults for missing text columns and audit columns."""
    defaults = {"frame": -1, "overlay": -1, "ocrengine": -1, "ocrtext": "", "nerengine": -1, "nerpii": -1}
    rows = df
    for name, value in defaults.items():
        if name not in df.columns:
            rows = rows.withColumn(name, F.lit(value))
    audited = rows.withColumn("last_modified", F.current_timestamp()).withColumn("last_modified_by", F.current_user())
    audited.write.mode("append").parquet(path)


def dump_rects_csv(rects: DataFrame) -> DataFrame:
    """All box rows, oldest change first."""
    return sorted_by(rects, "last_modified")


def dump_review_csv(review: DataFrame) -> DataFrame:
    return sorted_by(review, "last_modified")


def dump_db_json(rects: DataFrame, review: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables as JSON lines, oldest change first; a quoted image type text becomes an array again."""
    listed = review
    if "image_type" in review.columns:
        fixed = F.regexp_replace("image_type", "'", '"')
        listed = review.withColumn("image_type", F.from_json(fixed, "array<string>"))

    def lines(df: DataFrame) -> DataFrame:
        return sorted_by(df, "last_modified").select(F.to_json(F.struct("*")).alias("value"))

    return lines(rects), lines(listed)
