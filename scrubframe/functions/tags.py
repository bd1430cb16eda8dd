"""Column expressions over image tags. Missing tags are empty strings or named sentinels, not nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: SOP class prefix of secondary capture images.
SECONDARY_CAPTURE_CLASS = "1.2.840.10008.5.1.4.1.1.7"
#: Texts of numbers and truth values that count as nothing.
ZERO = r"^-?0(?:\.0*)?(?:[eE][+-]?[0-9]+)?$|^false$"


def tag_default(value: Column, default: str | int, keep_zero: bool = False) -> Column:
    """The tag, or ``default`` when it is missing, empty or (unless ``keep_zero``) a numeric zero or false.

    The type of ``value`` tells numbers from texts, so the text ``0`` stays.
    """
    kind = F.typeof(value)
    text = value.cast("string")
    missing = text.isNull() | (text == "")
    if not keep_zero:
        missing = missing | ((kind != "string") & text.rlike(ZERO))
    return F.when(missing, F.lit(str(default))).otherwise(text)


def variant_default(value: Column, default: str | int, keep_zero: bool = False) -> Column:
    """``tag_default`` of a VARIANT column, whose rows may hold numbers or texts."""
    text = F.try_variant_get(value, "$", "string")
    missing = text.isNull() | (text == "")
    if not keep_zero:
        missing = missing | ((F.schema_of_variant(value) != "STRING") & text.rlike(ZERO))
    return F.when(missing, F.lit(str(default))).otherwise(text)


def imagetype_parts(image_type: Column) -> Column:
    """Split the text form of the image type on single or on doubled backslashes.

    Doubled backslashes separate only when no single backslash stands between two words.
    """
    single_between_words = image_type.rlike(r"[^\\]+\\[^\\]+")
    doubled = image_type.contains("\\\\") & ~single_between_words
    return F.when(doubled, F.split(image_type, r"\\\\")).otherwise(F.split(image_type, r"\\"))


def imagetype_summary(parts: Column) -> Column:
    """First two elements of an image type array joined by a slash."""
    return F.coalesce(F.array_join(F.slice(parts, 1, 2), "/"), F.lit(""))


def imagetype_summary_text(image_type: Column) -> Column:
    return imagetype_summary(imagetype_parts(image_type))


def is_secondary_capture(sop_class: Column, sc_manufacturer: Column, sc_model: Column, sc_date: Column) -> Column:
    def filled(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) != ""

    return (F.coalesce(sop_class, F.lit("")).startswith(SECONDARY_CAPTURE_CLASS)
            | filled(sc_manufacturer) | filled(sc_model) | filled(sc_date))


def fix_imagetype(summary: Column, secondary: Column, otherwise: str = "") -> Column:
    """Guess an empty image type from the secondary capture flag."""
    return F.when(F.coalesce(summary, F.lit("")) != "", summary).when(
        secondary, F.lit("DERIVED/SECONDARY")).otherwise(F.lit(otherwise))


def derived_model_name(manufacturer: Column, model: Column, sc_manufacturer: Column,
                       sc_model: Column, software: Column) -> Column:
    """The device model, else the capture device's model, else maker and software version, else ``NoModel``."""
    def text(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    maker = F.when(text(manufacturer) != "", manufacturer).otherwise(text(sc_manufacturer))
    fallback = F.concat(maker, F.lit(" "), text(software))
    name = (F.when(text(model) != "", model).when(text(sc_model) != "", sc_model)
            .when(fallback == " ", F.lit("NoModel")).otherwise(fallback))
    return F.trim(F.when(name == " ", F.lit("NoModel")).otherwise(name))


def imagetype_json(parts: Column) -> Column:
    """Image type array as JSON text, the form kept in the review table."""
    return F.to_json(parts)


def tag_overview(modality: Column, burned_in: Column, parts: Column, model: Column) -> Column:
    """One line for a reviewer, with the usual words shortened and cut to a fixed width."""
    short = F.array_join(parts, "\\")
    # Abbreviations of the overview line.
    for word, brief in (("ORIGINAL", "ORIG"), ("PRIMARY", "PRIM"), ("SECONDARY", "SEC"), ("DERIVED", "DER")):
        short = F.replace(short, F.lit(word), F.lit(brief))
    return F.concat(modality, F.lit(", BIA="), burned_in, F.lit(", ImType="), F.substring(short, 1, 11),
                    F.lit(", Model="), F.substring(model, 1, 16))
