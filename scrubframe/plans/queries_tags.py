"""Registered queries over tags: projections, profiles, samples, numbering, files and identifiers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubframe.functions import tags as G
from scrubframe.functions import text as X
from scrubframe.operators import classify, identify, numbering, profile, sample
from scrubframe.plans.catalog import query
from scrubframe.plans.fixtures import Tables
from scrubframe.session import checkpoint_root
from scrubframe.sources import files, ocr
from scrubframe.sources import tags as src

# ---------------------------------------------------------------- shared SQL pieces

PARTS = r"""case when contains(image_type, chr(92) || chr(92)) and not regexp_matches(image_type, '[^\\]+\\[^\\]+')
  then string_split(image_type, chr(92) || chr(92)) else string_split(image_type, chr(92)) end"""
SUMMARY = f"array_to_string(list_slice({PARTS}, 1, 2), '/')"
SECONDARY = "(starts_with(sop_class, '1.2.840.10008.5.1.4.1.1.7') or sc_manufacturer <> '' or sc_model <> '')"
MODEL = """case when model <> '' then trim(model) when sc_model <> '' then trim(sc_model)
  when concat(case when manufacturer <> '' then manufacturer else sc_manufacturer end, ' ', software) = ' ' then 'NoModel'
  else trim(concat(case when manufacturer <> '' then manufacturer else sc_manufacturer end, ' ', software)) end"""
LISTED = f"""case when image_type = '' then case when {SECONDARY} then ['DERIVED', 'SECONDARY'] else ['NoImageType'] end
  else {PARTS} end"""

COMBO = ["model_name", "image_type_2", "burned_in"]


def with_derived(t: Tables) -> DataFrame:
    """Tag table with the derived model name and image type summary."""
    return t.fx_tags.withColumn("model_name", src.model_name()).withColumn(
        "image_type_2", G.imagetype_summary_text(F.col("image_type")))


DERIVED = f"(select *, {MODEL} as model_name, {SUMMARY} as image_type_2 from {{fx_tags}})"
COMBINATION = "concat(model_name, ',', image_type_2, ',', burned_in, ',')"

# ---------------------------------------------------------------- projections


@query("tag_default", """
select filename, case when manufacturer = '' then 'NoMaker' else manufacturer end as maker,
  case when device_no % 3 = 0 then '9' else cast(device_no % 3 as varchar) end as falsy,
  cast(device_no % 3 as varchar) as kept, cast(device_no % 3 as varchar) as text_stays from {fx_tags}""")
def _(t: Tables) -> DataFrame:
    n = F.col("device_no") % 3
    return t.fx_tags.select("filename", G.tag_default(F.col("manufacturer"), "NoMaker").alias("maker"),
                            G.tag_default(n, 9).alias("falsy"), G.tag_default(n, 9, keep_zero=True).alias("kept"),
                            G.tag_default(n.cast("string"), 9).alias("text_stays"))


@query("imagetype_summary", f"select filename, {SUMMARY} as summary from {{fx_tags}}")
def _(t: Tables) -> DataFrame:
    return t.fx_tags.select("filename", G.imagetype_summary_text(F.col("image_type")).alias("summary"))


@query("fix_imagetype", f"""
select filename, case when {SUMMARY} <> '' then {SUMMARY} when {SECONDARY} then 'DERIVED/SECONDARY' else '' end as image_type_2
from {{fx_tags}}""")
def _(t: Tables) -> DataFrame:
    secondary = G.is_secondary_capture(F.col("sop_class"), F.col("sc_manufacturer"), F.col("sc_model"), F.lit(""))
    fixed = G.fix_imagetype(G.imagetype_summary_text(F.col("image_type")), secondary)
    return t.fx_tags.select("filename", fixed.alias("image_type_2"))


@query("is_secondary_capture", f"select filename, {SECONDARY} as secondary from {{fx_tags}}")
def _(t: Tables) -> DataFrame:
    return t.fx_tags.select("filename", G.is_secondary_capture(
        F.col("sop_class"), F.col("sc_manufacturer"), F.col("sc_model"), F.lit("")).alias("secondary"))


@query("derived_model_name", f"select filename, {MODEL} as model_name from {{fx_tags}}")
def _(t: Tables) -> DataFrame:
    return t.fx_tags.select("filename", src.model_name().alias("model_name"))


@query("selected_metadata", f"""
select filename, modality, cast(to_json({LISTED}) as varchar) as image_type, n_rows, n_cols, {MODEL} as model, burned_in
from {{fx_tags}}""")
def _(t: Tables) -> DataFrame:
    return src.selected_metadata(t.fx_tags)


@query("tag_overview", f"""
select filename, concat(modality, ', BIA=', burned_in, ', ImType=', substr(replace(replace(replace(replace(
  array_to_string({LISTED}, chr(92)), 'ORIGINAL', 'ORIG'), 'PRIMARY', 'PRIM'), 'SECONDARY', 'SEC'), 'DERIVED', 'DER'), 1, 11),
  ', Model=', substr({MODEL}, 1, 16)) as overview from {{fx_tags}}""")
def _(t: Tables) -> DataFrame:
    return src.tag_overview(t.fx_tags)


HELD = {"Modality": "modality", "BurnedInAnnotation": "burned_in", "Manufacturer": "manufacturer",
        "ManufacturerModelName": "model", "SoftwareVersions": "software",
        "SecondaryCaptureDeviceManufacturer": "sc_manufacturer",
        "SecondaryCaptureDeviceManufacturerModelName": "sc_model", "Rows": "n_rows", "Columns": "n_cols",
        "NumberOfFrames": "n_frames", "(6000,0040)-OverlayType": "overlay_type", "SOPClassUID": "sop_class"}


def tag_documents(t: Tables) -> DataFrame:
    """Nested documents as a document store would hold them."""
    columns = [F.struct(F.col("path").alias("DicomFilePath")).alias("header"), F.col("image_type").alias("ImageType")]
    for field in src.DOCUMENT_SCHEMA.fieldNames()[2:]:
        value = F.col(HELD[field]).cast("string") if field in HELD else F.lit(None).cast("string")
        columns.append(value.alias(field))
    return t.fx_tags.select(*columns)


@query("src_tags", f"""
with docs as (
  select *, case when image_no % 11 = 0 then 'MR' when image_no % 10 > 0 then modality end as tag, n_frames - 1 as number,
    case when modality in ('CT', 'MR', 'XA') then modality else 'OTHER' end as collection from {{fx_tags}})
select coalesce(tag, collection) as Modality, path as DicomFilePath, burned_in as BurnedInAnnotation, 'NORVFTAG' as RecognizableVisualFeatures,
  manufacturer as Manufacturer, {MODEL} as ModelName,
  case when {SUMMARY} <> '' then {SUMMARY} when {SECONDARY} then 'DERIVED/SECONDARY' else '' end as ImageType2,
  image_type as ImageType, cast(n_rows as varchar) as Rows_,
  case when number = 0 and image_no % 4 < 2 then '1' else cast(number as varchar) end as NumberOfFrames,
  overlay_type as OverlayType from docs where collection = 'CT' or (collection = 'OTHER' and tag = 'US')""")
def _(t: Tables) -> DataFrame:
    """Documents in folders, one per collection: some without a modality, numbers of frames partly as texts."""
    path = f"{checkpoint_root(t.spark)}/documents-{uuid.uuid4().hex}"
    number, tag = F.col("n_frames") - 1, F.when(F.col("image_no") % 11 == 0, "MR").when(F.col("image_no") % 10 > 0, F.col("modality"))
    held = [F.struct(F.col("path").alias("DicomFilePath")).alias("header"), F.col("image_type").alias("ImageType"), tag.alias("Modality"),
            *(F.col(c).alias(name) for name, c in HELD.items() if name not in ("Modality", "NumberOfFrames"))]

    def document(frames: Column) -> Column:
        return F.to_json(F.struct(*held, frames.alias("NumberOfFrames")))

    lines = F.when(F.col("image_no") % 4 < 2, document(number)).otherwise(document(number.cast("string")))
    collection = F.when(F.col("modality").isin("CT", "MR", "XA"), F.col("modality")).otherwise(src.OTHER)
    t.fx_tags.select(lines.alias("value"), collection.alias("collection")).write.partitionBy("collection").text(path)
    flat = src.flatten_documents(src.src_tags(t.spark, path, ["CT", "US"])).withColumnRenamed("Rows", "Rows_")
    return flat.select("Modality", "DicomFilePath", "BurnedInAnnotation", "RecognizableVisualFeatures", "Manufacturer",
                       "ModelName", "ImageType2", "ImageType", "Rows_", "NumberOfFrames", "OverlayType")


@query("project_overlay_cols", """
select '' as OverlayRows, '' as OverlayColumns, overlay_type as OverlayType, '' as NumberOfFramesInOverlay,
  '' as OverlayDescription from {fx_tags}""")
def _(t: Tables) -> DataFrame:
    return src.project_overlay_cols(src.flatten_documents(tag_documents(t)))


@query("filter_orig_prim", """
select filename, modality, image_type, overlay_type from {fx_tags}
where contains(image_type, 'ORIGINAL') and contains(image_type, 'PRIMARY') and overlay_type = ''""")
def _(t: Tables) -> DataFrame:
    return profile.filter_orig_prim(t.fx_tags).select("filename", "modality", "image_type", "overlay_type")


@query("project_with_groupcols", "select filename, modality, manufacturer, n_frames from {fx_tags}")
def _(t: Tables) -> DataFrame:
    return profile.project_with_groupcols(t.fx_tags, ["modality", "manufacturer"], ["filename", "+", "n_frames"])


@query("normalise_combo_imagetype", r"""
select filename, regexp_extract(image_type, '^((?:ORIGINAL|DERIVED)\\(?:PRIMARY|SECONDARY))', 1) as image_type from {fx_tags}
where regexp_matches(image_type, '^(ORIGINAL|DERIVED)\\(PRIMARY|SECONDARY)')""")
def _(t: Tables) -> DataFrame:
    return profile.normalise_combo_imagetype(t.fx_tags.select("filename", "image_type"))


@query("form_label_rule", """
select filename, regexp_matches(manufacturer, '(?i)maker1|MODEL3') or regexp_matches(model, '(?i)maker1|MODEL3') as is_form
from {fx_tags}""")
def _(t: Tables) -> DataFrame:
    return classify.form_label_rule(t.fx_tags, ["maker1", "MODEL3"]).select("filename", "is_form")


# ---------------------------------------------------------------- profiles

PROFILED = ["modality", "manufacturer", "model", "software", "image_type", "burned_in", "rows_text", "n_frames", "overlay_type"]
LONG = " union all ".join(
    f"select '{c}' as \"column\", cast({c} as varchar) as \"value\" from {{fx_tags}}" for c in PROFILED)


@query("profile_value_counts", f'select "column", "value", count(*) as n from ({LONG}) group by 1, 2')
def _(t: Tables) -> DataFrame:
    return profile.profile_value_counts(t.fx_tags, PROFILED)


@query("profile_distinct_counts", f'select "column", count(distinct "value") as n_distinct from ({LONG}) group by 1')
def _(t: Tables) -> DataFrame:
    return profile.profile_distinct_counts(t.fx_tags, PROFILED)


@query("profile_flat_table", f"""
select 'Manufacturer' as "column", count(distinct manufacturer) as n_distinct from {{fx_tags}}
union all select 'ManufacturerModelName', count(distinct model) from {{fx_tags}}
union all select 'ModelName', count(distinct m) from (select {MODEL} as m from {{fx_tags}})
union all select 'ImageType2', count(distinct case when {SUMMARY} <> '' then {SUMMARY} when {SECONDARY} then 'DERIVED/SECONDARY' else '' end) from {{fx_tags}}
union all select c, count(distinct v) from (select unnest(['BurnedInAnnotation', 'ImageType', 'SoftwareVersions', 'Rows', 'Columns', 'NumberOfFrames', 'OverlayType']) as c,
  unnest([burned_in, image_type, software, n_rows::varchar, n_cols::varchar, n_frames::varchar, overlay_type]) as v from {{fx_tags}}) group by c
union all select unnest(['RecognizableVisualFeatures', 'CodeMeaning', 'CommentsOnRadiationDose', 'ImplementationVersionName', 'SeriesDescription',
  'WindowWidth', 'BitsStored', 'BitsAllocated', 'OverlayRows', 'OverlayColumns', 'NumberOfFramesInOverlay', 'OverlayDescription',
  'OverlayBitsAllocated', 'OverlayBitPosition']), 1""")
def _(t: Tables) -> DataFrame:
    flat = src.flatten_documents(tag_documents(t))
    return profile.profile_distinct_counts(flat, profile.PROFILE_COLUMNS)


@query("count_per_column", f'select "column", count("value") as n from ({LONG}) group by 1')
def _(t: Tables) -> DataFrame:
    return profile.count_per_column(t.fx_tags, PROFILED)


@query("profile_imagetype_short", r"""
select coalesce(nullif(regexp_extract(image_type, '^((?:ORIGINAL|DERIVED)\\(?:PRIMARY|SECONDARY))(?:\\.*)?$', 1), ''), 'BAD')
  as image_type_short, count(*) as n from {fx_tags} group by 1""")
def _(t: Tables) -> DataFrame:
    return profile.profile_imagetype_short(t.fx_tags)


@query("profile_numeric_stats", """
select "column", count(*) filter (where n is null) as n_na, count(n) as n, min(n) as min, max(n) as max, avg(n) as mean,
  cast(coalesce(sum(n), 0) as bigint) as total
from (select "column", try_cast(translate("value", '[]', '') as bigint) as n from (
  select 'rows_text' as "column", rows_text as "value" from {fx_tags}
  union all select 'n_frames', cast(n_frames as varchar) from {fx_tags}
  union all select 'software', software from {fx_tags})) group by 1""")
def _(t: Tables) -> DataFrame:
    return profile.profile_numeric_stats(t.fx_tags, ["rows_text", "n_frames", "software"])


@query("unique_column", "select distinct modality, manufacturer from {fx_tags}")
def _(t: Tables) -> DataFrame:
    return profile.unique_column(t.fx_tags, "manufacturer")


@query("text_free_manufacturers", """
select concat(manufacturer, ' unit ', filename) as manufacturer from {fx_ocr} where box_left <> -1 group by 1 having max(length(ocr_text)) = 0""")
def _(t: Tables) -> DataFrame:
    units = t.fx_ocr.where("box_left <> -1").withColumn("manufacturer", F.concat("manufacturer", F.lit(" unit "), "filename"))
    return profile.text_free_manufacturers(units)


@query("text_length_bands", """
select case when length(ocr_text) < 10 then 'short' when length(ocr_text) > 10 then 'long' else 'exact' end as band,
  count(*) as n, count(*) filter (where is_sensitive = 1) as n_sensitive from {fx_ocr} group by 1""")
def _(t: Tables) -> DataFrame:
    return profile.text_length_bands(t.fx_ocr)


_PLAIN = "overlay = -1 and box_left = -1 and starts_with(image_type, 'ORIG')"


@query("filter_no_text_frames", f"select filename, frame, manufacturer from {{fx_ocr}} where {_PLAIN} and ocr_text = ''")
def _(t: Tables) -> DataFrame:
    return profile.filter_no_text_frames(t.fx_ocr).select("filename", "frame", "manufacturer")


@query("filter_frame_summaries", f"select filename, frame, ocr_text from {{fx_ocr}} where {_PLAIN}")
def _(t: Tables) -> DataFrame:
    return profile.filter_frame_summaries(t.fx_ocr).select("filename", "frame", "ocr_text")


# ---------------------------------------------------------------- samples


@query("combo_counts", f"""
select {COMBINATION} as combination, model_name, image_type_2, burned_in, count(*) as total
from {DERIVED} group by all""")
def _(t: Tables) -> DataFrame:
    return sample.combo_counts(with_derived(t), COMBO)


@query("combo_filter", f"""
select combination, count(*) as total from (select {COMBINATION} as combination from {DERIVED})
where contains(combination, 'Model1') group by 1""")
def _(t: Tables) -> DataFrame:
    return sample.combo_filter(sample.combo_counts(with_derived(t), COMBO), "Model1").select("combination", "total")


_RANKED = f"""(select {COMBINATION} as combination, filename, count(*) over (partition by {COMBINATION}) as total,
  row_number() over (partition by {COMBINATION} order by md5(concat('7|', filename)), filename) as draw_no from {DERIVED})"""


@query("combo_sample_n", f"""
select combination, max(total) as total, {', '.join(f"max(case when draw_no = {i + 1} then filename end) as d{i}" for i in range(20))}
from {_RANKED} group by combination""")
def _(t: Tables) -> DataFrame:
    return sample.combo_sample_n(with_derived(t), COMBO, "filename", k=20, seed=7)


@query("combo_sample_files", f"select combination, draw_no, filename from {_RANKED} where draw_no <= 20")
def _(t: Tables) -> DataFrame:
    return sample.combo_sample_files(with_derived(t), COMBO, "filename", k=20, seed=7)


def _draw_sql(group: str, source: str, n: int, seed: int) -> str:
    picks = " union all ".join(
        f"select {group}, {i + 1} as draw_no, substr(min(concat(substr(md5(concat('{seed}|{i // 4}|', filename)), "
        f"{1 + 8 * (i % 4)}, 8), '|', filename)), 10) as filename from {source} group by all" for i in range(n))
    return f"({picks})"


@query("group_sample_n", f"select modality, burned_in, draw_no, filename from {_draw_sql('modality, burned_in', '{fx_tags}', 6, 3)}")
def _(t: Tables) -> DataFrame:
    return sample.group_sample_n(t.fx_tags, ["modality", "burned_in"], 6, "filename", seed=3, replace=True)


@query("combo_unique_n", f"""
select combination, concat('/archive/', filename) as filename from (select combination, filename,
  row_number() over (partition by combination order by draw_no, filename) as k from (
    select combination, filename, min(draw_no) as draw_no from {_draw_sql(COMBINATION + ' as combination', DERIVED, 8, 5)} group by 1, 2))
where k <= 5""")
def _(t: Tables) -> DataFrame:
    drawn = sample.combo_sample_files(with_derived(t), COMBO, "filename", k=8, seed=5, replace=True)
    return sample.combo_unique_n(drawn, "filename", n=5, prefix="/archive")


@query("fetch_sampled_rows", f"""
select s.combination, s.draw_no, s.filename, d.modality, d.path from (select combination, draw_no, filename from {_RANKED}
  where draw_no <= 20) s join {{fx_tags}} d on s.filename = d.filename""")
def _(t: Tables) -> DataFrame:
    drawn = sample.combo_sample_files(with_derived(t), COMBO, "filename", k=20, seed=7)
    return sample.fetch_sampled_rows(drawn, t.fx_tags.select("filename", "modality", "path"), "filename")


@query("group_head_n", """
select modality, burned_in, filename, draw_no from (select modality, burned_in, filename,
  row_number() over (partition by modality, burned_in order by image_no) as draw_no from {fx_tags}) where draw_no <= 10""")
def _(t: Tables) -> DataFrame:
    rows = t.fx_tags.select("modality", "burned_in", "filename", "image_no")
    return sample.group_head_n(rows, ["modality", "burned_in"], 10, ["image_no"]).drop("image_no")


@query("sample_rows", "select filename, study, series from {fx_tags} order by md5(concat('11|', filename)), filename limit 50")
def _(t: Tables) -> DataFrame:
    return sample.sample_rows(t.fx_tags.select("filename", "study", "series"), 50, "filename", seed=11)


@query("one_per_series", """
select study, series, substr(min(concat(md5(concat('2|', sop)), sop)), 33) as sop from {fx_tags} group by 1, 2""")
def _(t: Tables) -> DataFrame:
    return sample.one_per_series(t.fx_tags.select("study", "series", "sop"), seed=2)


@query("shuffle_order", "select filename, md5(concat('4|', filename)) as shuffle_key from {fx_tags}")
def _(t: Tables) -> DataFrame:
    return sample.shuffle_order(t.fx_tags.select("filename"), "filename", seed=4)


@query("split_80_20_random", """
select filename, case when cast(concat('0x', substr(md5(concat('9|', filename)), 1, 8)) as bigint) % 100 < 80 then 'training'
  else 'validation' end as part from {fx_tags}""")
def _(t: Tables) -> DataFrame:
    return sample.split_80_20_random(t.fx_tags.select("filename"), "filename", seed=9)


# ---------------------------------------------------------------- numbering

_NUMBERED = "(select *, row_number() over (order by filename) as pos, count(*) over () as n from {fx_tags})"


@query("split_halves", f"select filename, case when pos <= n // 2 then 1 else 2 end as half from {_NUMBERED}")
def _(t: Tables) -> DataFrame:
    return numbering.split_halves(t.fx_tags.select("filename"), ["filename"])


@query("batches_of_n", f"select filename, (pos - 1) // 20 as batch from {_NUMBERED}")
def _(t: Tables) -> DataFrame:
    return numbering.batches_of_n(t.fx_tags.select("filename"), 20, ["filename"])


@query("divvy_blocks", f"""
select filename as PK, (pos - 1) % 10 + 1 as block, cast(null as varchar) as Label, cast(null as varchar) as Label_datetime
from {_NUMBERED}""")
def _(t: Tables) -> DataFrame:
    return numbering.divvy_blocks(t.fx_tags.select(F.col("filename").alias("PK")), 10, ["PK"])


@query("split_80_20_ordered",
       f"select filename, case when pos <= n * 8 // 10 then 'training' else 'validation' end as part from {_NUMBERED}")
def _(t: Tables) -> DataFrame:
    return numbering.split_80_20_ordered(t.fx_tags.select("filename"), ["filename"])


@query("with_group_position", """
select filename, modality, row_number() over (partition by modality order by filename) as pos from {fx_tags}""")
def _(t: Tables) -> DataFrame:
    return numbering.with_group_position(t.fx_tags.select("filename", "modality"), ["modality"], ["filename"])


@query("bind_blocks", """
select filename as PK, modality as Label, null as Label_datetime from {fx_tags}
union all select filename, case when mark then 'tagged' else 'done' end, cast(last_modified as varchar) from {fx_review}""")
def _(t: Tables) -> DataFrame:
    first = t.fx_tags.select(F.col("filename").alias("PK"), F.col("modality").alias("Label"))
    second = t.fx_review.select(F.col("filename").alias("PK"), F.when(F.col("mark"), "tagged").otherwise("done").alias("Label"),
                                F.date_format("last_modified", "yyyy-MM-dd HH:mm:ss").alias("Label_datetime"), "mark")
    return numbering.bind_blocks(first, second)


@query("label_union", """
select filename, 0 as class from {fx_tags} where model <> 'Model3' union all select filename, 1 from {fx_tags} where model = 'Model3'""")
def _(t: Tables) -> DataFrame:
    names = t.fx_tags.select("filename", "model")
    return numbering.label_union(names.where("model <> 'Model3'"), names.where("model = 'Model3'")).drop("model")


def with_overlays(t: Tables) -> DataFrame:
    return t.fx_tags.select("filename", "n_frames", F.array(
        (F.col("image_no") % 3).cast("int"), F.lit(0), (F.col("device_no") % 2).cast("int")).alias("overlay_frames"))


_OVERLAY_LIST = """(select filename, n_frames, 0 as overlay, cast(image_no % 3 as int) as k from {fx_tags}
  union all select filename, n_frames, 2, cast(device_no % 2 as int) from {fx_tags})"""


@query("frame_sequence", f"""
select filename, cast(row_number() over (partition by filename order by overlay, frame) - 1 as int) as idx, frame, overlay from (
  select filename, cast(unnest(range(0, n_frames)) as int) as frame, -1 as overlay from {{fx_tags}}
  union all select filename, cast(unnest(range(0, k)) as int), overlay from {_OVERLAY_LIST})""")
def _(t: Tables) -> DataFrame:
    return src.frame_sequence(with_overlays(t))


@query("count_frames", """
select filename, n_frames, (case when image_no % 3 > 0 then 1 else 0 end) + (case when device_no % 2 > 0 then 1 else 0 end) as n_overlays,
  image_no % 3 + device_no % 2 as n_overlay_frames, n_frames + image_no % 3 + device_no % 2 as n_total from {fx_tags}""")
def _(t: Tables) -> DataFrame:
    return src.count_frames(with_overlays(t))


# ---------------------------------------------------------------- files and names


@query("resolve_manifest", """
select concat(case when modality in ('CT', 'MR', 'XA') then '/data/a/' else '/data/b/' end, sop, '.dcm') as path from {fx_tags}""")
def _(t: Tables) -> DataFrame:
    """Every file lies under one of two roots and its manifest entry is tried under both."""
    name = F.concat("sop", F.lit(".dcm"))
    root = F.when(F.col("modality").isin("CT", "MR", "XA"), "/data/a/").otherwise("/data/b/")
    manifest = t.fx_tags.select(name.alias("DicomFilePath"))
    listing = t.fx_tags.select(F.concat(root, name).alias("path"))
    return files.resolve_manifest(manifest, listing, ["/data/a", "/data/b/"])


@query("find_path", """
select path from {fx_tags} where contains(path, '.1') and modality in ('DX', 'CR')
order by case modality when 'DX' then 1 else 2 end, path limit 1""")
def _(t: Tables) -> DataFrame:
    return files.find_path(t.fx_tags, ".1")


@query("series_manifest", """
select distinct concat(study, '/', series, '/') as prefix from {fx_tags} where study in ('1.2.3', '1.2.17', '1.2.44')""")
def _(t: Tables) -> DataFrame:
    return files.series_manifest(t.fx_tags, studies=["1.2.3", "1.2.17", "1.2.44"])


@query("series_lookup", """
select filename, study, series from {fx_tags} where series in (select t.series from {fx_tags} t join {fx_review} r on t.filename = r.filename where r.mark)""")
def _(t: Tables) -> DataFrame:
    wanted = t.fx_tags.join(t.fx_review.where("mark").select("filename"), "filename", "left_semi").select("series")
    return files.series_lookup(t.fx_tags.select("filename", "study", "series"), wanted)


@query("list_series_objects", """
select concat(split_part(key, '/', 1), '/', split_part(key, '/', 2)) as study_series, split_part(key, '/', 3) as sop
from {fx_keys} where contains(key, '/')""")
def _(t: Tables) -> DataFrame:
    return files.list_series_objects(t.fx_keys)


@query("list_objects_capped", "select key from {fx_keys} order by key limit 200")
def _(t: Tables) -> DataFrame:
    return files.list_objects_capped(t.fx_keys, 200)


_URL = "'^s3://([^:]*):([^@]*)@([^/]*)/([^/]*)/(.*)'"


@query("url_parse", f"""
select filename, {', '.join(f"case when regexp_matches(url, {_URL}) then regexp_extract(url, {_URL}, {i + 1}) end as {n}" for i, n in enumerate(X.URL_PARTS))}
from {{fx_urls}}""")
def _(t: Tables) -> DataFrame:
    return t.fx_urls.select("filename", X.url_parse(F.col("url")).alias("u")).select("filename", "u.*")


@query("url_sanitise", f"""
select filename, case when regexp_matches(url, {_URL}) then regexp_replace(url, {_URL}, 's3://\\4/\\5') end as clean from {{fx_urls}}""")
def _(t: Tables) -> DataFrame:
    return t.fx_urls.select("filename", X.url_sanitise(F.col("url")).alias("clean"))


@query("url_compare", f"""
select filename, (case when regexp_matches(url, {_URL}) then regexp_replace(url, {_URL}, 's3://\\4/\\5') end)
  is not distinct from regexp_replace(url2, {_URL}, 's3://\\4/\\5') as same from {{fx_urls}}""")
def _(t: Tables) -> DataFrame:
    return t.fx_urls.select("filename", X.url_compare(F.col("url"), F.col("url2")).alias("same"))


@query("url_build", """
select filename, case when device_no % 2 = 0 then concat('s3://', study, '/', sop)
  else concat('s3://ak:', sop, '@host', device_no, '/', study, '/', sop) end as url from {fx_tags}""")
def _(t: Tables) -> DataFrame:
    access = F.when(F.col("device_no") % 2 == 1, "ak")
    host = F.concat(F.lit("https://host"), "device_no", F.lit("/"))
    return t.fx_tags.select("filename", X.url_build(access, F.col("sop"), host, F.col("study"), F.col("sop")).alias("url"))


@query("output_path", """
select path, replace(path, '.dcm', '.redacted.dcm') as beside, concat('/out/', sop, '.redacted.dcm') as in_folder,
  concat('/out/', substr(path, 7)) as below from {fx_tags}""")
def _(t: Tables) -> DataFrame:
    p = F.col("path")
    return t.fx_tags.select("path", X.output_path(p).alias("beside"), X.output_path(p, "/out").alias("in_folder"),
                            X.output_path(p, "/out", relative="/data").alias("below"))


@query("pseudonymise_uid", "select filename, sha256(concat('salt', sop)) as uid from {fx_tags}")
def _(t: Tables) -> DataFrame:
    return t.fx_tags.select("filename", X.pseudonymise_uid(F.col("sop"), "salt", "sha2").alias("uid"))


def _decimal(text: str) -> str:
    return f"cast(cast(concat('0x', substr(sha256({text}), 1, 30)) as uhugeint) as varchar)"


@query("pseudonymise_ids", f"""
select filename, {_decimal("concat('a longer secret', study)")} as study, {_decimal("concat('a longer secret', series)")} as series,
  {_decimal("concat('a longer secret', sop)")} as sop, concat('/data/', {_decimal("concat('a longer secret', study)")}, '/',
  {_decimal("concat('a longer secret', series)")}, '/', {_decimal("concat('a longer secret', sop)")}, '.dcm') as path
from {{fx_tags}}""")
def _(t: Tables) -> DataFrame:
    return identify.pseudonymise_ids(t.fx_tags.select("filename", "study", "series", "sop", "path"), "a longer secret")


@query("pseudonymise_uid_decimal", f"""select filename, {_decimal("concat('salt', sop)")} as uid from {{fx_tags}}""")
def _(t: Tables) -> DataFrame:
    return t.fx_tags.select("filename", X.pseudonymise_uid(F.col("sop"), "salt").alias("uid"))


@query("drop_repeated_headers", "select key from {fx_keys}")
def _(t: Tables) -> DataFrame:
    headers = t.fx_keys.groupBy(F.substring_index("key", "/", 1).alias("batch")).agg(F.lit("key").alias("key")).select("key")
    return ocr.drop_repeated_headers(t.fx_keys.unionByName(headers), "key")


# ---------------------------------------------------------------- classifier


def _scored(t: Tables) -> DataFrame:
    return t.labels.select("doc_id", F.col("quality").alias("class"), (F.col("toxic") * 0.6 + 0.2).alias("sigmoid"))


@query("classifier_eval", """
select count(*) as total, count(*) filter (where toxic = quality) as correct,
  100 * count(*) filter (where toxic = quality) // count(*) as accuracy from {labels}""")
def _(t: Tables) -> DataFrame:
    return classify.classifier_eval(_scored(t))


@query("form_classifier")
def _(t: Tables) -> DataFrame:
    rows = t.embeddings.select(F.col("vec_id").cast("string").alias("key"), F.col("embedding").alias("features"),
                               (F.col("label") % 2).alias("class"))
    parts = sample.split_80_20_random(rows, "key", seed=1)
    model = classify.form_classifier(parts.where("part = 'training'"))
    scored = classify.score_forms(model, parts.where("part = 'validation'"))
    return classify.classifier_eval(scored)
