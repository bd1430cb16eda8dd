"""Tag-based redaction rules: matching them, applying them and deriving them from reviewed boxes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubframe.functions import boxes as B
from scrubframe.functions.boxes import BOX_COLUMNS, BOX_TYPE
from scrubframe.operators.rects import rects_valid
from scrubframe.session import sorted_by


class Rule(NamedTuple):
    """A label, predicates ``(op, tag, value)`` that must all hold, and boxes ``(kind, coords)``.

    ``op`` is contains (regex search), equals or present; ``kind`` is redact or keep;
    ``coords`` is ``l,t,r,b``, ``all`` or ``from:<regions tag>``.
    """

    label: str
    predicates: tuple[tuple[str, str, str], ...]
    boxes: tuple[tuple[str, str], ...]


DEVICE_TAGS = ["manufacturer", "model", "sc_manufacturer", "sc_model", "software"]
DEVICE_KEYS = ["modality", "n_rows", "n_cols", *DEVICE_TAGS]

# Names used for the device tags in rule text.
RULE_TAG_NAMES = {
    "manufacturer": "Manufacturer",
    "model": "ManufacturerModelName",
    "sc_manufacturer": "SecondaryCaptureDeviceManufacturer",
    "sc_model": "SecondaryCaptureDeviceManufacturerModelName",
    "software": "SoftwareVersions",
}


def _holds(predicate: tuple[str, str, str], columns: dict[str, str]) -> Column:
    op, tag, value = predicate
    if tag not in columns:
        return F.lit(False)
    tag_column = F.col(columns[tag])
    if op == "present":
        return tag_column.isNotNull()
    if op == "equals":
        return F.coalesce(tag_column.cast("string") == value, F.lit(False))
    if op == "contains":
        return F.coalesce(tag_column.cast("string").rlike(value), F.lit(False))
    raise ValueError(f"unknown predicate {op}")


def _known(tags: DataFrame, columns: dict[str, str]) -> dict[str, str]:
    return {tag: c for tag, c in columns.items() if c in tags.columns}


def _rule_hits(rules: Sequence[Rule], columns: dict[str, str]) -> Column:
    """Array of the numbers (from 1) of the rules an image matches."""
    hits = [F.when(reduce(lambda a, b: a & b, (_holds(p, columns) for p in rule.predicates), F.lit(True)), F.lit(i))
            for i, rule in enumerate(rules, 1)]
    return F.array_compact(F.array(*hits))


def match_rules(tags: DataFrame, rules: Sequence[Rule], columns: dict[str, str]) -> DataFrame:
    """One row per image and matching rule: (filename, rule_id, label).

    ``columns`` maps tag names to columns; a tag without a column counts as absent. A rule file is configuration, so its rules become
    one projection over the tag scan: no join, no shuffle, and each pattern compiles once.
    """
    columns = _known(tags, columns)
    labels = F.array(*(F.lit(r.label) for r in rules))
    hits = tags.select("filename", F.explode(_rule_hits(rules, columns)).alias("rule_id"))
    return hits.withColumn("label", F.get(labels, F.col("rule_id") - 1))


def _fixed_box(coords: str) -> Column:
    """Box of a rule's own numbers, or of the whole frame for ``all``."""
    if "all" in coords:
        return B.parse_rule_coords(F.lit(coords), F.col("n_cols"), F.col("n_rows"))
    return B.box_struct(B.Box(*(F.lit(int(n)) for n in coords.strip("() ").split(","))))


def rule_boxes(tags: DataFrame, rules: Sequence[Rule], columns: dict[str, str]) -> DataFrame:
    """Matching images with array columns ``keep`` and ``redact``, in rule order."""
    columns = _known(tags, columns)

    def boxes_of(rule: Rule, kind: str) -> Column:
        parts = []
        for k, coords in rule.boxes:
            if k != kind or (kind == "redact" and coords == "all"):
                continue
            if coords.startswith("from:") and coords[5:] not in columns:
                continue
            if coords.startswith("from:"):
                parts.append(F.transform(F.col(columns[coords[5:]]), lambda r: F.struct(
                    r["x0"].cast("int").alias("box_left"), r["y0"].cast("int").alias("box_top"),
                    r["x1"].cast("int").alias("box_right"), r["y1"].cast("int").alias("box_bottom"))))
            else:
                parts.append(F.array(_fixed_box(coords)))
        return F.concat(*parts) if parts else F.array().cast(f"array<{BOX_TYPE}>")

    def collected(kind: str) -> Column:
        per_rule = [F.when(F.array_contains("_hits", i), boxes_of(rule, kind))
                    .otherwise(F.array().cast(f"array<{BOX_TYPE}>")) for i, rule in enumerate(rules, 1)]
        return F.concat(*per_rule)

    hit = tags.withColumn("_hits", _rule_hits(rules, columns)).where(F.size("_hits") > 0)
    return hit.select("filename", "n_rows", "n_cols", collected("keep").alias("keep"),
                      collected("redact").alias("redact"))


def keep_redact_combine(boxes: DataFrame) -> DataFrame:
    """Boxes to redact per image: everything outside the ``keep`` boxes, then the ``redact`` boxes merged in.

    Both arrays come from one rule file and one tag document, so each image is one row and
    the fold is an expression over that row.
    """
    outside = B.complement_boxes(F.col("keep"), F.col("n_cols"), F.col("n_rows"))
    folded = B.fold_box_array(F.col("redact"), outside)
    return (boxes.select("filename", F.explode(folded).alias("_b"))
            .select("filename", F.lit(-1).alias("frame"), F.lit(-1).alias("overlay"), "_b.*"))


def rects_join_review(rects: DataFrame, review: DataFrame) -> DataFrame:
    """Boxes with the review row of their file."""
    extra = [c for c in review.columns if c == "filename" or c not in rects.columns]
    return rects.join(review.select(*extra), "filename")


def order_by_device(df: DataFrame) -> DataFrame:
    return sorted_by(df, "modality", "model", "n_rows", "n_cols")


def rects_of_done_files(rects: DataFrame, review: DataFrame) -> DataFrame:
    """Boxes of files whose review is complete."""
    return rects.join(review.where(~F.col("mark")).select("filename"), "filename", "left_semi")


def device_rect_sets(rects: DataFrame, review: DataFrame, tags: DataFrame) -> DataFrame:
    """Distinct boxes per device and image size, one row per box."""
    found = rects_valid(rects).select("filename", *BOX_COLUMNS).distinct()
    reviewed = found.join(review.select("filename"), "filename", "left_semi")
    return reviewed.join(tags.select("filename", *DEVICE_KEYS), "filename").select(
        *DEVICE_KEYS, *BOX_COLUMNS).distinct()


def rule_lines(sets: DataFrame) -> DataFrame:
    """Rule text: (rule_key, part, line). A rule's lines follow each other when sorted by these columns."""
    key = F.md5(F.concat_ws("|", *DEVICE_KEYS))
    keyed = sets.withColumn("rule_key", key)
    device = keyed.select("rule_key", *DEVICE_KEYS).distinct()
    head = [F.concat(F.lit("LABEL device "), F.col("rule_key")), F.concat(F.lit("  contains Modality "), F.col("modality"))]
    head += [F.when(F.col(c) != "", F.concat(F.lit(f"  + contains {n} "), F.col(c))) for c, n in RULE_TAG_NAMES.items()]
    head += [F.concat(F.lit("  + equals Rows "), F.col("n_rows")),
             F.concat(F.lit("  + equals Columns "), F.col("n_cols"))]
    heads = device.select("rule_key", F.posexplode(F.array(*head)).alias("part", "line"))
    body = keyed.select("rule_key", F.lit(len(head)).alias("part"), F.concat(F.lit("  coordinates "), F.concat_ws(",", *BOX_COLUMNS)).alias("line"))
    return heads.where("line is not null").unionByName(body)


def line_part(line: Column) -> Column:
    """The part of a written line, as ``rule_lines`` numbers them."""
    begins = ["LABEL device ", "  contains Modality ", *(f"  + contains {n} " for n in RULE_TAG_NAMES.values()), "  + equals Rows ", "  + equals Columns ", "  coordinates "]
    return F.coalesce(*(F.when(line.startswith(b), F.lit(k)) for k, b in enumerate(begins)))


def snk_rules(sets: DataFrame, path: str) -> None:
    """Write the rule text in order over numbered files. The range shuffle cuts anywhere, so a rule with very many boxes goes on
    in the next file; ``src_rules`` reads such files as one sequence."""
    lines = rule_lines(sets).repartitionByRange("rule_key", "part", "line")
    ordered = lines.sortWithinPartitions("rule_key", "part", "line")
    ordered.select("line").write.mode("overwrite").text(path)
