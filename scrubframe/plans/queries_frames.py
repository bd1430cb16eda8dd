"""Registered queries over frames: attaching boxes, redaction and pixel expressions.

Results are compared by two sums per frame, one of them weighted by position.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubframe.functions import pixels as P
from scrubframe.operators import redact, rects
from scrubframe.plans.catalog import query
from scrubframe.plans.fixtures import Tables
from scrubframe.plans.queries_boxes import BOX, FRAME, region_rects
from scrubframe.session import checkpoint_root, reliable


def sums(frames: DataFrame) -> DataFrame:
    """Plain and position-weighted pixel sums per frame."""
    weighted = F.transform("pixels", lambda p, i: p.cast("bigint") * (i + 1))
    total = F.aggregate("pixels", F.lit(0).cast("bigint"), lambda a, p: a + p)
    return frames.select("filename", "frame", "overlay", total.alias("total"),
                         F.aggregate(weighted, F.lit(0).cast("bigint"), lambda a, p: a + p).alias("weighted"))


def _sums_sql(pixels: str, source: str) -> str:
    return f"""
select {FRAME}, cast(list_sum(px) as bigint) as total, cast(list_sum(list_transform(px, lambda p, i: cast(p as bigint) * i)) as bigint) as weighted
from (select {FRAME}, {pixels} as px from {source})"""


def _masked_sql(source: str, boxes: str, applies: str, changed: str) -> str:
    """Sums with ``changed`` for pixels inside a box of ``boxes`` that ``applies``."""
    return f"""
with px as (select {FRAME}, i, pixels[i] as p, (i - 1) % 8 as x, (i - 1) // 8 as y from (select *, unnest(range(1, 65)) as i from {source})),
hit as (select distinct px.filename, px.frame, px.overlay, px.i from px join {boxes} b on b.filename = px.filename and {applies}
  and x between box_left and box_right and y between box_top and box_bottom)
select px.filename, px.frame, px.overlay, cast(sum(v) as bigint) as total, cast(sum(v * px.i) as bigint) as weighted from (
  select px.*, case when hit.i is not null then {changed} else p end as v from px left join hit on px.filename = hit.filename
    and px.frame = hit.frame and px.overlay = hit.overlay and px.i = hit.i) px group by 1, 2, 3"""


@query("export_rects_no_pii", f"select replace(filename, 'img/', '') as filename, {BOX}, frame, overlay from {{fx_rects}} where box_left <> -1")
def _(t: Tables) -> DataFrame:
    return redact.export_rects_no_pii(t.fx_rects, strip_prefix="img")


@query("collect_box_sources", f"""
select {FRAME}, {BOX}, 'stored' as source from {{fx_rects}} where box_left <> -1
union all select filename, unnest([0, 1]), -1, {BOX}, 'regions' from {{fx_region_rows}}
union all select {FRAME}, {BOX}, 'given' from {{fx_frame_rects}}""")
def _(t: Tables) -> DataFrame:
    return redact.collect_box_sources(stored=rects.rects_valid(t.fx_rects), regions=region_rects(t), given=t.fx_frame_rects)


@query("rects_to_frames", f"""
select f.filename, f.frame, f.overlay, {BOX} from {{fx_frames}} f join {{fx_frame_rects}} r on r.filename = f.filename
  and ((r.frame in (-1, f.frame) and r.overlay = f.overlay) or (r.frame = -1 and r.overlay = -1))""")
def _(t: Tables) -> DataFrame:
    return redact.rects_to_frames(t.fx_frame_rects, t.fx_frames)


@query("redact_frames", _masked_sql("{fx_frames}", "{fx_frame_rects}", "b.overlay = -1 and (b.frame = -1 or b.frame = px.frame)", "p - p % 256"))
def _(t: Tables) -> DataFrame:
    return sums(redact.redact_frames(t.fx_frames, t.fx_frame_rects))


@query("redact_all", _masked_sql(
    f"(select {FRAME}, pixels from {{fx_frames}} union all select {FRAME}, pixels from {{fx_overlay_frames}})", "{fx_frame_rects}",
    "b.overlay = -1 and b.frame = -1", "case when px.overlay = -1 then p - p % 256 - (p & 512) else 0 end"))
def _(t: Tables) -> DataFrame:
    every = t.fx_frames.unionByName(t.fx_overlay_frames)
    return sums(redact.redact_all(every, t.fx_frame_rects, high_bits=512))


@query("redact_highbit_overlay", _masked_sql("{fx_frames}", "{fx_frame_rects}", "b.overlay = 0", "p - (p & 512)"))
def _(t: Tables) -> DataFrame:
    return sums(redact.redact_highbit_overlay(t.fx_frames, t.fx_frame_rects, overlay=0, bit=9))


@query("redact_overlay_frame", _masked_sql(
    f"(select {FRAME}, pixels from {{fx_frames}} union all select {FRAME}, pixels from {{fx_overlay_frames}})", "{fx_frame_rects}",
    "px.overlay >= 0 and ((b.frame = -1 and b.overlay = -1) or (b.frame in (-1, px.frame) and b.overlay = px.overlay))", "0"))
def _(t: Tables) -> DataFrame:
    every = t.fx_frames.unionByName(t.fx_overlay_frames)
    return sums(redact.redact_overlay_frame(every, t.fx_frame_rects))


@query("redact_frames_bucketed", _masked_sql("{fx_frames}", "{fx_frame_rects}", "b.overlay = -1 and (b.frame = -1 or b.frame = px.frame)", "p - p % 256"))
def _(t: Tables) -> DataFrame:
    """The frames as a bucketed table, of which no pixel moves."""
    name = f"frames_{uuid.uuid4().hex}"
    stored = redact.store_frames(t.fx_frames, name, 8, f"{checkpoint_root(t.spark)}/{name}")
    return sums(redact.redact_frames(stored, t.fx_frame_rects))


_FILE_NO = "cast(substr(px.filename, 4) as int)"


def overlay_positions(t: Tables) -> DataFrame:
    """Overlay 0 of each file: without a position in every third, else in bit 8 or 9; overlay 1 in bit 11."""
    number = F.substring("filename", 4, 20).cast("int")
    files = t.fx_frames.select("filename").distinct()
    zero = files.select("filename", F.lit(0).alias("overlay"), F.when(number % 3 > 0, 8 + number % 2).cast("int").alias("bit_position"))
    return zero.unionByName(files.select("filename", F.lit(1).alias("overlay"), F.lit(11).alias("bit_position")))


@query("redact_highbit_per_file", _masked_sql("{fx_frames}", "{fx_frame_rects}", "b.overlay = 0",
       f"case when {_FILE_NO} % 3 = 0 then p when {_FILE_NO} % 2 = 0 then p - (p & 256) else p - (p & 512) end"))
def _(t: Tables) -> DataFrame:
    return sums(redact.redact_highbit_overlay(t.fx_frames, t.fx_frame_rects, 0, overlay_positions(t)))


@query("redact_all_per_file", _masked_sql(
    f"(select {FRAME}, pixels from {{fx_frames}} union all select {FRAME}, pixels from {{fx_overlay_frames}})", "{fx_frame_rects}",
    "b.overlay = -1 and b.frame = -1",
    f"""case when px.overlay = -1 then p - p % 256 - (p & 2048) - case when {_FILE_NO} % 3 = 0 then 0 when {_FILE_NO} % 2 = 0 then p & 256 else p & 512 end
  else 0 end"""))
def _(t: Tables) -> DataFrame:
    every = t.fx_frames.unionByName(t.fx_overlay_frames)
    return sums(redact.redact_all(every, t.fx_frame_rects, overlay_positions(t)))


@query("redaction_report", """
select f.filename, f.frame, f.overlay, count(*) as n_boxes, count(*) as n_applied, cast(0 as bigint) as n_left from {fx_frames} f join {fx_frame_rects} r
  on r.filename = f.filename and r.overlay = -1 and (r.frame = -1 or r.frame = f.frame) group by 1, 2, 3
union all
select r.filename, r.frame, r.overlay, count(*), 0, 0 from {fx_frame_rects} r where r.overlay = -1 and not exists (
  select 1 from {fx_frames} f where f.filename = r.filename and (r.frame = -1 or r.frame = f.frame)) group by 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    after = reliable(redact.redact_frames(t.fx_frames, t.fx_frame_rects))
    return redact.redaction_report(after, t.fx_frame_rects)


@query("strip_highbits", _sums_sql("list_transform(pixels, lambda p: p & 255)", "{fx_frames}"))
def _(t: Tables) -> DataFrame:
    return sums(redact.strip_highbits(t.fx_frames))


@query("extract_bitplane", _sums_sql("list_transform(pixels, lambda p: p & 512)", "{fx_frames}"))
def _(t: Tables) -> DataFrame:
    return sums(redact.extract_bitplane(t.fx_frames, 9))


@query("contrast_stretch", _sums_sql(
    """case when list_min(pixels) = list_max(pixels) then pixels when frame = 1 then
  list_transform(pixels, lambda p: cast(floor((list_max(pixels) - p) * (cast(255.0 as double) / (list_max(pixels) - list_min(pixels)))) as int)) else
  list_transform(pixels, lambda p: cast(floor((p - list_min(pixels)) * (cast(255.0 as double) / (list_max(pixels) - list_min(pixels)))) as int)) end""",
    "{fx_frames}"))
def _(t: Tables) -> DataFrame:
    return sums(redact.contrast_stretch(t.fx_frames.withColumn("inverted", F.col("frame") == 1), "inverted"))


@query("blank_frames", _sums_sql("list_transform(pixels, lambda p: 0)", "{fx_frames}"))
def _(t: Tables) -> DataFrame:
    return sums(redact.blank_frames(t.fx_frames))


@query("overlay_group", """
select filename, ord, 24576 + 2 * overlay as overlay_group, case when nerpii > 0 then nerpii else 0 end as bit from {fx_rects} where overlay >= 0""")
def _(t: Tables) -> DataFrame:
    rows = t.fx_rects.where("overlay >= 0")
    return rows.select("filename", "ord", P.overlay_group(F.col("overlay")).alias("overlay_group"),
                       P.overlay_bit(F.col("nerpii")).alias("bit"))


@query("redact_frames_pixels", """
with px as (select filename, frame, overlay, i, pixels[i] as p, (i - 1) % 8 as x, (i - 1) // 8 as y
  from (select *, unnest(range(1, 65)) as i from {fx_frames}))
select filename, frame, overlay, string_agg(cast(case when exists (select 1 from {fx_frame_rects} b where b.filename = px.filename
    and b.overlay = -1 and (b.frame = -1 or b.frame = px.frame) and box_right > box_left and box_bottom > box_top
    and x between box_left and box_right and y between box_top and box_bottom)
  then p - p % 256 else p end as varchar), ',' order by i) as pixels from px group by 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    """Whole redacted frames, from the boxes left after dropping those hidden in others."""
    kept = rects.maximal_rects(t.fx_frame_rects)
    done = redact.redact_frames(t.fx_frames, kept)
    return done.select("filename", "frame", "overlay", F.array_join(F.col("pixels").cast("array<string>"), ",").alias("pixels"))
