"""Tag documents and the flat tag table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubframe.functions import tags as G

# Columns of the flat tag table, the tag each is read from and its default.
FLAT_COLUMNS = [
    ("Modality", "Modality", ""),
    ("DicomFilePath", None, ""),
    ("BurnedInAnnotation", "BurnedInAnnotation", "NOBIATAG"),
    ("RecognizableVisualFeatures", "RecognizableVisualFeatures", "NORVFTAG"),
    ("Manufacturer", "Manufacturer", ""),
    ("ManufacturerModelName", "ManufacturerModelName", ""),
    ("SoftwareVersions", "SoftwareVersions", ""),
    ("SecondaryCaptureDeviceManufacturer", "SecondaryCaptureDeviceManufacturer", ""),
    ("SecondaryCaptureDeviceManufacturerModelName", "SecondaryCaptureDeviceManufacturerModelName", ""),
    ("ModelName", None, ""),
    ("CodeMeaning", "CodeMeaning", ""),
    ("CommentsOnRadiationDose", "CommentsOnRadiationDose", ""),
    ("ImageType2", None, ""),
    ("ImageType", None, ""),
    ("ImplementationVersionName", "ImplementationVersionName", ""),
    ("SeriesDescription", "SeriesDescription", ""),
    ("WindowWidth", "WindowWidth", ""),
    ("Rows", "Rows", ""),
    ("Columns", "Columns", ""),
    ("BitsStored", "BitsStored", ""),
    ("BitsAllocated", "BitsAllocated", ""),
    ("NumberOfFrames", "NumberOfFrames", "1"),
    ("OverlayRows", "(6000,0010)-OverlayRows", ""),
    ("OverlayColumns", "(6000,0011)-OverlayColumns", ""),
    ("OverlayType", "(6000,0040)-OverlayType", ""),
    ("NumberOfFramesInOverlay", "(6000,0015)-NumberOfFramesInOverlay", ""),
    ("OverlayDescription", "(6000,0022)-OverlayDescription", ""),
    ("OverlayBitsAllocated", "(6000,0100)-OverlayBitsAllocated", ""),
    ("OverlayBitPosition", "(6000,0102)-OverlayBitPosition", ""),
    ("ZeihmCreator", "(0019,0010)-PrivateCreator", ""),
    ("ZeihmImageCaptureData", "(0019,1201:ZIEHM_1_0 ImageCaptureData)-Unknown", ""),
]
DOCUMENT_TAGS = [tag for _, tag, _ in FLAT_COLUMNS if tag] + ["SOPClassUID", "DateOfSecondaryCapture"]
# ImageType is read as text: a JSON array keeps its brackets and is parsed on flattening.
DOCUMENT_SCHEMA = T.StructType(
    [T.StructField("header", T.StructType([T.StructField("DicomFilePath", T.StringType())])),
     T.StructField("ImageType", T.StringType())]
    + [T.StructField(tag, T.StringType()) for tag in DOCUMENT_TAGS])


#: The same as read from JSON: tags keep the type they have in each document, so the number 0 and the text ``0`` differ.
READ_SCHEMA = T.StructType(
    [*DOCUMENT_SCHEMA.fields[:2]] + [T.StructField(tag, T.VariantType()) for tag in DOCUMENT_TAGS]
    + [T.StructField("collection", T.StringType())])
OTHER = "OTHER"


def src_tags(spark: SparkSession, path: str, modalities: list[str] | None = None) -> DataFrame:
    """Tag documents from JSON lines, in one folder or in folders ``collection=<name>``.

    A collection is named by the modality it holds, ``OTHER`` holds all that have none of their own. ``modalities`` takes a
    collection of that name whole, whatever its documents say, and of ``OTHER`` and of documents without a collection those
    that say so themselves. Unread collections are pruned. A document without a modality has that of its collection.
    """
    docs = spark.read.schema(READ_SCHEMA).json(path)
    own = G.variant_default(_tag("Modality"), "")
    mixed = F.col("collection").isNull() | (F.col("collection") == OTHER)
    if modalities:
        docs = docs.where(F.coalesce(F.col("collection").isin(*modalities), F.lit(False)) | (mixed & own.isin(*modalities)))
    named = F.when(own != "", own).when(~mixed, F.col("collection"))
    return docs.withColumn("Modality", named).drop("collection")


def _tag(name: str) -> Column:
    return F.col(f"`{name}`")


def flatten_documents(docs: DataFrame, keep_zero: bool = False) -> DataFrame:
    """The flat tag table: text columns, missing tags replaced by their defaults. Tags are texts or VARIANT values."""
    typed = {f.name for f in docs.schema.fields if isinstance(f.dataType, T.VariantType)}

    def default_of(tag: str, default: str) -> Column:
        return (G.variant_default if tag in typed else G.tag_default)(_tag(tag), default, keep_zero)

    def text_of(tag: str) -> Column:
        return F.try_variant_get(_tag(tag), "$", "string") if tag in typed else _tag(tag)

    d = {name: default_of(tag, default) for name, tag, default in FLAT_COLUMNS if tag}
    text = F.coalesce("ImageType", F.lit(""))
    listed = text.startswith("[")
    parts = F.when(listed, F.from_json(text, "array<string>")).otherwise(G.imagetype_parts(text))
    secondary = G.is_secondary_capture(*map(text_of, ("SOPClassUID", "SecondaryCaptureDeviceManufacturer",
                                                      "SecondaryCaptureDeviceManufacturerModelName", "DateOfSecondaryCapture")))
    d["DicomFilePath"] = F.col("header.DicomFilePath")
    d["ModelName"] = G.derived_model_name(
        d["Manufacturer"], d["ManufacturerModelName"], d["SecondaryCaptureDeviceManufacturer"],
        d["SecondaryCaptureDeviceManufacturerModelName"], d["SoftwareVersions"])
    d["ImageType2"] = G.fix_imagetype(G.imagetype_summary(parts), secondary)
    d["ImageType"] = text
    return docs.select(*(d[name].alias(name) for name, _, _ in FLAT_COLUMNS))


def dump_tags_json(df: DataFrame, path: str) -> None:
    """Every document as a JSON line, without the store's own key."""
    df.drop("_id").write.mode("overwrite").json(path)


def snk_tags_csv(df: DataFrame, path: str) -> None:
    """The flat table as CSV, one folder per modality."""
    (df.withColumn("_part", F.col("Modality")).write.mode("overwrite").option("header", True)
     .option("escape", '"').option("emptyValue", "").partitionBy("_part").csv(path))


def partition_by_device(df: DataFrame, path: str) -> None:
    """Lay the tag table out by maker, software and image size for review.

    The salt spreads a popular device over several files instead of one task.
    """
    keys = ["Manufacturer", "SoftwareVersions", "Rows", "Columns"]
    salt = F.pmod(F.xxhash64("DicomFilePath"), F.lit(16))
    df.repartition(*keys, salt).write.mode("overwrite").partitionBy(*keys).parquet(path)


def src_csv_text(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV as text columns; an empty field stays an empty string."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", False)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path).na.fill("")


def selected_metadata(df: DataFrame) -> DataFrame:
    """Six review columns with sentinels; the image type as JSON text, sizes as integers."""
    parts = G.imagetype_parts(F.col("image_type"))
    secondary = G.is_secondary_capture(F.col("sop_class"), F.col("sc_manufacturer"), F.col("sc_model"), F.lit(""))
    guessed = F.when(secondary, F.array(F.lit("DERIVED"), F.lit("SECONDARY"))).otherwise(F.array(F.lit("NoImageType")))
    listed = F.when(F.col("image_type") == "", guessed).otherwise(parts)
    return df.select(
        "filename", F.coalesce("modality", F.lit("NoModality")).alias("modality"),
        G.imagetype_json(listed).alias("image_type"),
        F.coalesce(F.col("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.col("n_cols"), F.lit(0)).alias("n_cols"),
        model_name().alias("model"), F.coalesce("burned_in", F.lit("NoBIA")).alias("burned_in"))


def model_name() -> Column:
    """Derived model name from the short column names."""
    return G.derived_model_name(*(F.col(c) for c in ("manufacturer", "model", "sc_manufacturer", "sc_model", "software")))


def tag_overview(df: DataFrame) -> DataFrame:
    """One overview line per image."""
    meta = selected_metadata(df)
    line = G.tag_overview(F.col("modality"), F.col("burned_in"), F.from_json("image_type", "array<string>"), F.col("model"))
    return meta.select("filename", line.alias("overview"))


def project_overlay_cols(df: DataFrame) -> DataFrame:
    """Overlay columns of the flat table."""
    return df.select("OverlayRows", "OverlayColumns", "OverlayType", "NumberOfFramesInOverlay", "OverlayDescription")


def frame_sequence(df: DataFrame) -> DataFrame:
    """Flat frame numbers: image frames first, then the frames of overlay 0, 1, ...

    ``overlay_frames`` is the array of frame counts per overlay; an unused overlay counts 0.
    """
    images = F.transform(F.sequence(F.lit(0), F.col("n_frames") - 1),
                         lambda f: F.struct(f.alias("frame"), F.lit(-1).alias("overlay")))
    none = F.array().cast("array<struct<frame:int,overlay:int>>")
    overlays = F.flatten(F.transform("overlay_frames", lambda n, o: F.when(n > 0, F.transform(
        F.sequence(F.lit(0), n - 1), lambda f: F.struct(f.alias("frame"), o.alias("overlay")))).otherwise(none)))
    return df.select("filename", F.posexplode(F.concat(images, overlays)).alias("idx", "_f")).select(
        "filename", "idx", "_f.frame", "_f.overlay")


def count_frames(df: DataFrame) -> DataFrame:
    """Frames, overlays in use, frames in overlays and their total per file."""
    used = F.size(F.filter("overlay_frames", lambda n: n > 0))
    inside = F.aggregate("overlay_frames", F.lit(0), lambda a, n: a + n)
    return df.select("filename", "n_frames", used.alias("n_overlays"), inside.alias("n_overlay_frames"),
                     (F.col("n_frames") + inside).alias("n_total"))
