"""Registered queries that write whole tables to the shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubframe.functions import pixels as P
from scrubframe.functions.boxes import BOX_COLUMNS
from scrubframe.operators import allowlist, rects, rules
from scrubframe.plans.catalog import query
from scrubframe.plans.fixtures import Tables
from scrubframe.plans.queries_boxes import BOX, FRAME, RULES, safe_sql
from scrubframe.plans.queries_tags import MODEL, SECONDARY, SUMMARY, tag_documents
from scrubframe.session import checkpoint_root
from scrubframe.sources import files, ocr
from scrubframe.sources import tags as src


def scratch(t: Tables) -> str:
    """A new folder every executor can reach."""
    return f"{checkpoint_root(t.spark)}/written-{uuid.uuid4().hex}"


FLAT = f"""
select modality as Modality, path as DicomFilePath, burned_in as BurnedInAnnotation, manufacturer as Manufacturer, {MODEL} as ModelName,
  case when {SUMMARY} <> '' then {SUMMARY} when {SECONDARY} then 'DERIVED/SECONDARY' else '' end as ImageType2,
  image_type as ImageType, cast(n_frames as varchar) as NumberOfFrames, overlay_type as OverlayType from {{fx_tags}}"""
FLAT_NAMES = ["Modality", "DicomFilePath", "BurnedInAnnotation", "Manufacturer", "ModelName", "ImageType2", "ImageType",
              "NumberOfFrames", "OverlayType"]


@query("dump_tags_json", FLAT)
def _(t: Tables) -> DataFrame:
    path = scratch(t)
    src.dump_tags_json(tag_documents(t).withColumn("_id", F.lit(1)), path)
    return src.flatten_documents(src.src_tags(t.spark, path)).select(*FLAT_NAMES)


@query("snk_tags_csv", FLAT)
def _(t: Tables) -> DataFrame:
    path = scratch(t)
    src.snk_tags_csv(src.flatten_documents(tag_documents(t)), path)
    return src.src_csv_text(t.spark, path).select(*FLAT_NAMES)


@query("src_csv_text", "select Modality, count(*) as n, count(*) filter (where Manufacturer = '') as n_empty from (" + FLAT + ") group by 1")
def _(t: Tables) -> DataFrame:
    path = scratch(t)
    src.snk_tags_csv(src.flatten_documents(tag_documents(t)), path)
    return src.src_csv_text(t.spark, path).groupBy("Modality").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("Manufacturer") == "").alias("n_empty"))


@query("partition_by_device", """
select manufacturer as Manufacturer, cast(n_rows as varchar) as n_rows, count(*) as n from {fx_tags} group by 1, 2""")
def _(t: Tables) -> DataFrame:
    path = scratch(t)
    src.partition_by_device(src.flatten_documents(tag_documents(t)), path)
    back = t.spark.read.parquet(path)
    return back.groupBy(F.coalesce("Manufacturer", F.lit("")).alias("Manufacturer"), F.col("Rows").cast("string").alias("n_rows")).agg(
        F.count(F.lit(1)).alias("n"))


_STORED = f"""
select {FRAME}, {BOX}, 2 as ocrengine, ocrtext, nerengine, nerpii from {{fx_rects}} where box_left >= 0"""


@query("src_ocr_csv", _STORED + " and overlay = 1")
def _(t: Tables) -> DataFrame:
    path = scratch(t)
    ocr.snk_ocr_csv(t.fx_rects.withColumn("ocrengine", F.lit(2)), path)
    return ocr.src_ocr_csv(t.spark, path, overlay=1)


@query("snk_ocr_csv", _STORED)
def _(t: Tables) -> DataFrame:
    path = scratch(t)
    ocr.snk_ocr_csv(t.fx_rects.withColumn("ocrengine", F.lit(2)), path)
    return ocr.src_ocr_csv(t.spark, path)


@query("append_rects", f"""
select {FRAME}, {BOX}, ocrtext, nerengine, nerpii from {{fx_rects}} where box_left <> -1
union all select filename, -1, -1, {BOX}, '', -1, -1 from {{fx_region_rows}}""")
def _(t: Tables) -> DataFrame:
    path = scratch(t)
    ocr.append_rects(rects.rects_valid(t.fx_rects).drop("ord", "conf", "last_modified"), path)
    ocr.append_rects(t.fx_region_rows.select("filename", *BOX_COLUMNS), path)
    return t.spark.read.parquet(path).select("filename", "frame", "overlay", *BOX_COLUMNS, "ocrtext", "nerengine", "nerpii")


@query("src_rules", f"""
with s as (select * from {RULES})
select concat('device ', rule_key) as label,
  3 + cast(max((manufacturer <> '')::int + (model <> '')::int + (sc_manufacturer <> '')::int
  + (sc_model <> '')::int + (software <> '')::int) as int) as n_predicates, cast(count(*) as int) as n_boxes,
  string_agg(concat_ws(',', {BOX}), ';' order by concat_ws(',', {BOX})) as boxes from s group by rule_key""")
def _(t: Tables) -> DataFrame:
    path = scratch(t)
    rules.snk_rules(rules.device_rect_sets(t.fx_rects, t.fx_review, t.fx_tags), path)
    boxes = F.array_join(F.array_sort(F.transform("boxes", lambda b: b["coords"])), ";")
    return files.src_rules(t.spark, f"{path}/part-*").select(
        "label", F.size("predicates").alias("n_predicates"), F.size("boxes").alias("n_boxes"), boxes.alias("boxes"))


@query("build_view_rules", f"""
with {safe_sql('{fx_texts}')}
select ocrtext, ocrtext in (select t from safe_text) as safe, count(*) as n from {{fx_texts}} where ocrtext <> '' group by 1""")
def _(t: Tables) -> DataFrame:
    """Every text against the expanded rule list; the text is grouped first, so each is tested once."""
    once = t.fx_texts.where("ocrtext <> ''").groupBy("ocrtext").agg(F.count(F.lit(1)).alias("n"))
    expanded = allowlist.any_of(allowlist.build_view_rules())
    return once.select("ocrtext", F.col("ocrtext").rlike(expanded).alias("safe"), "n")


@query("overlay_bit", """
select filename, ord, case when nerpii > 0 then nerpii else 0 end as bit from {fx_rects}""")
def _(t: Tables) -> DataFrame:
    return t.fx_rects.select("filename", "ord", P.overlay_bit(F.col("nerpii")).alias("bit"))


@query("list_files", "select n_regionkey as region, count(*) as n from {nation} group by 1")
def _(t: Tables) -> DataFrame:
    """One file per nation in a folder per region; listed without being read, the marker file of the writer left out."""
    path = scratch(t)
    t.nation.repartitionByRange(25, "n_nationkey").write.option("maxRecordsPerFile", 1).partitionBy("n_regionkey").parquet(path)
    listed = files.list_files(t.spark, [path], skip=f"{files.NOT_IMAGES}|_SUCCESS$")
    region = F.regexp_extract("path", r"n_regionkey=([0-9]+)/", 1).cast("bigint")
    return listed.groupBy(region.alias("region")).agg(F.count(F.lit(1)).alias("n"))
