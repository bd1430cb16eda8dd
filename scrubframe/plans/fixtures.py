"""Image tables derived from the general tables of a data folder.

Each view is one SQL text that both Spark and the checking engine run over whole tables;
the few with array literals have a second text. ``{name}`` refers to a table or view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {}
# Views whose array syntax differs in the checking engine.
OTHER_SYNTAX: dict[str, str] = {}

VIEWS["fx_tags"] = r"""
select concat('img', o_orderkey) as filename, o_orderkey as image_no, o_custkey as device_no,
  case o_orderkey % 6 when 0 then 'CT' when 1 then 'MR' when 2 then 'XA' when 3 then 'US' when 4 then 'DX' else 'CR' end as modality,
  case when o_orderkey % 7 = 0 then '' else concat('Maker', o_custkey % 5) end as manufacturer,
  case when o_orderkey % 4 = 0 then '' when o_custkey % 11 = 0 then 'ZiehmNetPort' else concat('Model', o_custkey % 8) end as model,
  case when o_orderkey % 13 = 0 then concat('ScMaker', o_custkey % 3) else '' end as sc_manufacturer,
  case when o_orderkey % 17 = 0 then concat('ScModel', o_custkey % 2) else '' end as sc_model,
  case when o_orderkey % 5 = 0 then '' else concat('v', o_custkey % 3) end as software,
  case o_orderkey % 5 when 0 then concat('ORIGINAL', chr(92), 'PRIMARY')
    when 1 then concat('DERIVED', chr(92), 'SECONDARY', chr(92), 'POST')
    when 2 then concat('ORIGINAL', chr(92), chr(92), 'PRIMARY') when 3 then '' else 'BAD' end as image_type,
  case o_custkey % 4 when 0 then 'YES' when 1 then 'NO' else 'NOBIATAG' end as burned_in,
  case o_orderkey % 3 when 0 then '512' when 1 then '[1024]' else 'N/A' end as rows_text,
  cast(case o_custkey % 3 when 0 then 512 when 1 then 576 else 1024 end as int) as n_rows,
  cast(case o_custkey % 3 when 0 then 512 when 1 then 576 else 1024 end as int) as n_cols,
  case when o_orderkey % 9 = 0 then 'G' else '' end as overlay_type,
  cast(1 + o_orderkey % 4 as int) as n_frames,
  case when o_custkey % 10 = 0 then '1.2.840.10008.5.1.4.1.1.7.1' else '1.2.840.10008.5.1.4.1.1.2' end as sop_class,
  concat('1.2.', o_custkey % 50) as study, concat('1.2.', o_custkey % 50, '.', o_orderkey % 20) as series,
  concat('1.2.9.', o_orderkey) as sop,
  concat('/data/1.2.', o_custkey % 50, '/1.2.', o_custkey % 50, '.', o_orderkey % 20, '/1.2.9.', o_orderkey, '.dcm') as path,
  o_orderdate as last_modified
from {orders}
"""

VIEWS["fx_rects"] = r"""
select concat('img', l_orderkey) as filename, 
  concat(l_linenumber, '-', lpad(cast(l_partkey as string), 12, '0'), '-', lpad(cast(l_suppkey as string), 12, '0'), '-',
    lpad(cast(cast(l_quantity as int) as string), 3, '0')) as ord,
  cast(l_linenumber % 2 as int) as frame,
  cast(case when l_linenumber % 5 = 0 then l_suppkey % 2 else -1 end as int) as overlay,
  cast(case when l_linenumber = 7 then -1 else l_partkey % 40 end as int) as box_left,
  cast(case when l_linenumber = 7 then -1 else l_suppkey % 40 end as int) as box_top,
  cast(case when l_linenumber = 7 then -1 else l_partkey % 40 + cast(l_quantity as int) * 4 end as int) as box_right,
  cast(case when l_linenumber = 7 then -1 else l_suppkey % 40 + cast(l_quantity as int) * 2 end as int) as box_bottom,
  split_part('AP ERECT|NOT ERECT|R|jane maclean|jane maclan|kV 54 mAs 2|L AP Supine||ankle|WOOD GENERAL HOSPITAL', '|',
    cast(1 + l_partkey % 10 as int)) as ocrtext,
  cast(case when l_suppkey % 2 = 0 then 50 else 10 end as int) as nerengine,
  cast(l_suppkey % 3 - 1 as int) as nerpii,
  cast(l_partkey % 100 as double) / 100 as conf,
  l_shipdate as last_modified
from {lineitem}
"""

VIEWS["fx_review"] = r"""
select filename, (image_no % 6 = 0) as mark, case when image_no % 8 = 0 then 'check' else null end as comment,
  modality, image_type, n_rows, n_cols, model, last_modified
from {fx_tags} where image_no % 2 = 0
"""

VIEWS["fx_review_events"] = r"""
select concat('img', user_id) as filename, event_id as seq,
  case event_type when 'click' then 'toggle' when 'signup' then 'set' when 'error' then 'clear' else 'look' end as action,
  event_type = 'signup' as mark, case when event_id % 7 = 0 then concat('note', event_id) else '' end as comment,
  ts as last_modified
from {events}
"""

VIEWS["fx_ocr"] = r"""
select r.filename, r.frame, r.overlay, r.box_left, r.box_top, r.box_right, r.box_bottom, r.ocrtext as ocr_text,
  r.nerpii as is_sensitive, t.image_type, t.manufacturer, t.modality
from {fx_rects} r join {fx_tags} t on r.filename = t.filename
"""

VIEWS["fx_region_rows"] = r"""
select filename, n_rows, n_cols, 1 as region_no, cast(10 + device_no % 40 as int) as box_left, cast(20 + device_no % 30 as int) as box_top,
  cast(210 + device_no % 40 as int) as box_right, cast(170 + device_no % 30 as int) as box_bottom from {fx_tags} where modality = 'US'
union all
select filename, n_rows, n_cols, 2, cast(230 + image_no % 60 as int), cast(60 + image_no % 23 as int), cast(430 + image_no % 60 as int),
  cast(360 + image_no % 23 as int) from {fx_tags} where modality = 'US'
"""

VIEWS["fx_regions"] = r"""
select filename, n_rows, n_cols, modality, model, case when modality = 'US' then
  array(named_struct('x0', 10 + device_no % 40, 'y0', 20 + device_no % 30, 'x1', 210 + device_no % 40, 'y1', 170 + device_no % 30),
    named_struct('x0', 230 + image_no % 60, 'y0', 60 + image_no % 23, 'x1', 430 + image_no % 60, 'y1', 360 + image_no % 23)) end as regions
from {fx_tags}
"""

VIEWS["fx_frames"] = r"""
select concat('img', cast(floor(vec_id / 2) as bigint)) as filename, cast(vec_id % 2 as int) as frame, -1 as overlay,
  8 as n_rows, 8 as n_cols, 1 as samples, 8 as bits_stored,
  transform(embedding, x -> cast(floor((cast(x as double) + 1) * 512) as int)) as pixels from {embeddings}
"""
OTHER_SYNTAX["fx_frames"] = r"""
select concat('img', cast(floor(vec_id / 2) as bigint)) as filename, cast(vec_id % 2 as int) as frame, -1 as overlay,
  8 as n_rows, 8 as n_cols, 1 as samples, 8 as bits_stored,
  list_transform(embedding, lambda x: cast(floor((cast(x as double) + 1) * 512) as int)) as pixels from {embeddings}
"""

VIEWS["fx_overlay_frames"] = r"""
select filename, frame, 0 as overlay, n_rows, n_cols, samples, bits_stored,
  transform(pixels, p -> p % 2) as pixels from {fx_frames}
"""
OTHER_SYNTAX["fx_overlay_frames"] = r"""
select filename, frame, 0 as overlay, n_rows, n_cols, samples, bits_stored,
  list_transform(pixels, lambda p: p % 2) as pixels from {fx_frames}
"""

VIEWS["fx_frame_rects"] = r"""
select concat('img', l_orderkey) as filename,
  cast(case when l_linenumber % 3 = 0 then -1 else l_linenumber % 2 end as int) as frame,
  cast(case when l_suppkey % 4 = 0 then 0 else -1 end as int) as overlay,
  cast(l_partkey % 8 as int) as box_left, cast(l_suppkey % 8 as int) as box_top,
  cast(l_partkey % 8 + cast(l_quantity as int) % 4 as int) as box_right,
  cast(l_suppkey % 8 + cast(l_quantity as int) % 3 as int) as box_bottom
from {lineitem}
"""

VIEWS["fx_points"] = r"""
select filename, cast(case when image_no % 3 = 0 then -1 else image_no % 2 end as int) as frame, -1 as overlay,
  cast(device_no % 150 as int) as x, cast(device_no % 90 as int) as y from {fx_tags}
"""

VIEWS["fx_keys"] = r"""
select case when l_partkey % 29 = 0 then concat('root', l_partkey) else concat(l_orderkey % 50, '/', l_suppkey % 20, '/', l_partkey) end as key
from {lineitem}
"""

VIEWS["fx_urls"] = r"""
select filename, case when image_no % 5 = 0 then concat('s3://bucket/', image_no) else
  concat('s3://ak', device_no, ':sk', image_no, '@host', device_no % 3, '/bucket', device_no % 4, '/', study, '/', series, '/', sop) end as url,
  concat('s3://other:pw@host', device_no % 3, '/bucket', device_no % 4, '/', study, '/', series, '/', sop) as url2
from {fx_tags}
"""

# Words are picked by key, so the number of different texts is fixed while the rows grow with the data.
VIEWS["fx_texts"] = r"""
select l_orderkey as text_id, case when l_partkey % 3 = 0 then
    split_part('kV 54 mAs 2|DAP 12.34 e(0)|REX 123|kVp: 100 mAs: 12.50|REX 1.22.33.44|kV 54 mAs 2 REX 123|2 of 3|2/3|ext rot|L internal-rotation|int rot R|Red Dot|ankle|ANKLE view|4 of 5|kv 5 mAs 2|DAP 1.2 e(0)|extrot', '|', cast(1 + l_suppkey % 18 as int))
  else concat_ws(' ', nullif(split_part('AP|PA|L|Right|ERECT|MOBILE|in Resus|under trolley||semi-erect|hb|NOT|Lt|portable|wt bearing', '|', cast(1 + l_orderkey % 15 as int)), ''),
    nullif(split_part('ap|erect|l|horizontal beam lateral|sitting||PORT|right|resus|Standing|semi supine|lateral', '|', cast(1 + l_partkey % 12 as int)), ''),
    nullif(split_part('|Pa|left|hb l||Supine|weight-bearing', '|', cast(1 + l_suppkey % 7 as int)), '')) end as ocrtext,
  l_partkey % 2 = 0 as should_match
from {lineitem}
"""

VIEWS["fx_entities"] = r"""
select user_id as text_id, case when event_id % 4 = 0 then 'flair' when event_id % 4 = 1 then 'stanza' else 'spacy' end as engine,
  case event_type when 'click' then 'PERSON' when 'signup' then 'GPE' when 'error' then 'DATE' when 'view' then 'ORG' else 'MONEY' end as label
from {events}
"""

VIEWS["fx_labels"] = r"""
select concat('doc', user_id) as PK, event_id as seq,
  case when event_type = 'view' then '' else substr(event_type, 1, 1) end as Label, ts as checked_at from {events}
"""


VIEWS["fx_glossary_pages"] = r"""
select page_id, case when page_id % 2 = 0 then replace(html, '</a></li>', concat('</a>: <i>(page ', page_id % 7, ')</i></li>'))
  else replace(html, '</a></li>', concat(': page ', page_id % 5, '</a><b>,</b></li>')) end as html
from {pages}
"""


class Tables:
    """Tables and views of one data folder; each is planned once per session object."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            if name in TABLES:
                self._cache[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            elif name in VIEWS:
                needs = {dep: getattr(self, dep) for dep in references(VIEWS[name])}
                self._cache[name] = self.spark.sql(VIEWS[name], **needs)
            else:
                raise AttributeError(name)
        return self._cache[name]


def references(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z]\w*)\}", sql)))


def checking_sql(sql: str) -> str:
    """The query text with every view it needs as a common table expression."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for dep in references(text):
            if dep in VIEWS and dep not in ordered:
                visit(OTHER_SYNTAX.get(dep, VIEWS[dep]))
                ordered.append(dep)

    visit(sql)

    def plain(text: str) -> str:
        return re.sub(r"\{([a-z]\w*)\}", r"\1", text).strip()

    parts = [f"{dep} as ({plain(OTHER_SYNTAX.get(dep, VIEWS[dep]))})" for dep in ordered]
    body = plain(sql)
    own = re.match(r"with( recursive)?\s+", body)
    if own:
        body = body[own.end():]
        prefix = "with recursive " + "".join(p + ",\n" for p in parts)
        return prefix + body
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body
