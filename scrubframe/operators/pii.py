"""Decisions on detected entities, text summaries per frame, and pluggable detectors."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubframe.operators.allowlist import is_safe_text
from scrubframe.operators.numbering import with_group_position
from scrubframe.operators.rects import FRAME_KEYS
from scrubframe.session import split_hot_groups

# Labels of each entity detector and their common names; other labels are dropped.
ENTITY_LABELS = {
    "spacy": {"PERSON": "PER", "PER": "PER", "GPE": "LOC", "LOC": "LOC", "DATE": "MISC", "ORG": "ORG"},
    "flair": {"PER": "PER", "LOC": "LOC", "MISC": "MISC", "ORG": "ORG"},
    "stanford": {"PERSON": "PER", "DATE": "MISC", "ORGANIZATION": "ORG"},
    "stanza": {"PER": "PER", "PERSON": "PER", "LOC": "LOC", "LOCATION": "LOC", "FAC": "ORG", "ORG": "ORG",
               "ORGANIZATION": "ORG", "DATE": "MISC"},
    "allowlist": {"MISC": "MISC"},
}
SENSITIVE = ("PER", "ORG", "LOC")

ENTITY_TYPE = "array<struct<text:string,label:string>>"


def entity_label_map(entities: DataFrame) -> DataFrame:
    """Replace the engine's ``label`` by the common one; entities without one are dropped."""
    pairs = [F.lit(x) for engine, labels in ENTITY_LABELS.items()
             for label, common in labels.items() for x in (f"{engine}|{label}", common)]
    common = F.try_element_at(F.create_map(*pairs), F.concat_ws("|", "engine", "label"))
    return entities.withColumn("label", common).where(F.col("label").isNotNull())


def pii_flag(texts: DataFrame, entities: DataFrame, engine: str | None, key: str = "text_id") -> DataFrame:
    """Add ``is_sensitive``: -1 not checked, 0 nothing found, 1 a person, place or organisation.

    Under the allowlist engine any entity counts. Entities are folded to one record per text
    before the join, so a text with very many entities is no hot spot.
    """
    counts = F.col("label").isin(*SENSITIVE) if engine != "allowlist" else F.lit(True)
    found = entities.groupBy(key).agg(F.bool_or(counts).alias("_hit"))
    unchecked = F.lit(engine is None) | (F.col("text") == "")
    flag = F.when(unchecked, -1).when(F.coalesce("_hit", F.lit(False)), 1).otherwise(0)
    return texts.join(found, key, "left").withColumn("is_sensitive", flag).drop("_hit")


def sensitivity(text: Column, engine: str = "allowlist") -> Column:
    """Decision of a registered detector on each text: -1 for an empty text, else 0 or 1.

    The allowlist is a plain projection; other detectors run in Arrow batches.
    """
    if engine == "allowlist":
        return F.when(text == "", -1).when(is_safe_text(text), 0).otherwise(1)
    found = F.exists(detector_plugin(engine)(text), lambda e: e["label"].isin(*SENSITIVE))
    return F.when(text == "", -1).when(found, 1).otherwise(0)


def frame_text_summary(items: DataFrame, order: str = "ord", piece: int = 1000,
                       engine: str = "allowlist") -> DataFrame:
    """One row per frame: its texts joined by blanks, their number, and the detector's decision on the joined text.

    The items of large frames are numbered by a range shuffle that splits them over tasks, and joined in pieces of ``piece``
    items first, so what meets in one task is the frame's text itself and not its rows. The size of a piece changes no result.
    """
    few, many = split_hot_groups(items, FRAME_KEYS, piece)

    def joined(rows: DataFrame, keys: list[str], by: str, text: Column, count: Column) -> DataFrame:
        ordered = F.sort_array(F.collect_list(F.struct(F.col(by), text.alias("_text"))))
        return rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda s: s["_text"]), "").alias("ocrtext"), count.alias("n_items"))

    blank = F.concat(F.coalesce("ocrtext", F.lit("")), F.lit(" "))
    rows = joined(few, FRAME_KEYS, order, blank, F.count(F.lit(1)))
    if many is not None:
        placed = with_group_position(many.select(*FRAME_KEYS, order, "ocrtext"), FRAME_KEYS, [order], "_pos")
        placed = placed.withColumn("_piece", F.floor((F.col("_pos") - 1) / piece).cast("bigint"))
        pieces = joined(placed, [*FRAME_KEYS, "_piece"], "_pos", blank, F.count(F.lit(1)))
        rows = rows.unionByName(joined(pieces, FRAME_KEYS, "_piece", F.col("ocrtext"), F.sum("n_items")))
    flag = sensitivity(F.col("ocrtext"), engine)
    null_box = [F.lit(-1).alias(c) for c in ("box_left", "box_top", "box_right", "box_bottom")]
    return rows.select(*FRAME_KEYS, *null_box, "ocrtext", "n_items", flag.alias("nerpii"))


_DETECTORS: dict[str, Callable[[Column], Column]] = {}


def detector_plugin(name: str, fn: Callable[[str], list[tuple[str, str]]] | None = None) -> Callable[[Column], Column]:
    """Register or look up a detector by name.

    ``fn`` takes one text and returns (text, label) pairs; it runs in Arrow batches. The
    result is a column function giving an array of entities.
    """
    if fn is not None:
        @F.pandas_udf(ENTITY_TYPE)
        def detect(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: [{"text": e, "label": label} for e, label in fn(t or "")])

        _DETECTORS[name] = detect
    if name not in _DETECTORS:
        raise KeyError(f"no detector named {name}")
    return _DETECTORS[name]


def _allowlist_detector(text: Column) -> Column:
    whole = F.array(F.struct(text.alias("text"), F.lit("MISC").alias("label")))
    return F.when((text == "") | is_safe_text(text), F.array().cast(ENTITY_TYPE)).otherwise(whole)


_DETECTORS["allowlist"] = _allowlist_detector
