"""Registered queries over review state, suggestions, labels and incremental work."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubframe.operators import incremental, review, suggest
from scrubframe.plans.catalog import query
from scrubframe.plans.fixtures import Tables
from scrubframe.plans.queries_boxes import BOX, VALID
from scrubframe.session import checkpoint_root
from scrubframe.streaming import new_files


@query("review_rows", "select filename, mark, comment from {fx_review}")
def _(t: Tables) -> DataFrame:
    return review.review_rows(t.fx_review).select("filename", "mark", "comment")


@query("review_files", "select distinct filename from {fx_review_events}")
def _(t: Tables) -> DataFrame:
    return review.review_files(t.fx_review_events)


@query("known_files", "select filename from {fx_rects} union select filename from {fx_review}")
def _(t: Tables) -> DataFrame:
    return review.known_files(t.fx_rects, t.fx_review)


@query("review_state", """
select t.filename, case when mark then 'tagged' when mark is not null then 'done' else 'new' end as state,
  coalesce(mark, false) as mark, comment from {fx_tags} t left join {fx_review} r on t.filename = r.filename""")
def _(t: Tables) -> DataFrame:
    return review.review_state(t.fx_tags.select("filename"), t.fx_review).select("filename", "state", "mark", "comment")


@query("worklist", "select filename from {fx_tags} where filename not in (select filename from {fx_review} where not mark)")
def _(t: Tables) -> DataFrame:
    return review.worklist(t.fx_tags.select("filename"), t.fx_review)


@query("worklist_tagged", "select filename from {fx_tags} where filename in (select filename from {fx_review} where mark)")
def _(t: Tables) -> DataFrame:
    return review.worklist(t.fx_tags.select("filename"), t.fx_review, tagged_only=True)


@query("upsert_review", """
select filename, arg_max(mark, seq) as mark, arg_max(comment, seq) filter (where comment <> '') as comment,
  strftime(arg_max(last_modified, seq), '%Y-%m-%d %H:%M:%S.%f') as changed from {fx_review_events} group by 1""")
def _(t: Tables) -> DataFrame:
    rows = review.upsert_review(t.fx_review_events)
    changed = F.date_format("last_modified", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return rows.select("filename", "mark", "comment", changed.alias("changed"))


@query("toggle_mark", """
with e as (select * from {fx_review_events} where action <> 'look'),
s as (select filename, max(seq) as at, arg_max(action, seq) as action from e where action <> 'toggle' group by 1)
select e.filename, (coalesce(any_value(s.action) = 'set', false)) <> (count(*) filter (where e.action = 'toggle' and e.seq > coalesce(s.at, -1)) % 2 = 1) as mark
from e left join s on e.filename = s.filename group by 1""")
def _(t: Tables) -> DataFrame:
    return review.toggle_mark(t.fx_review_events)


@query("mark_done", """
select distinct filename, false as mark, cast(null as varchar) as comment from {fx_rects}
where filename not in (select filename from {fx_review})""")
def _(t: Tables) -> DataFrame:
    return review.mark_done(t.fx_rects, t.fx_review)


@query("remove_file", """
select 'rects' as kind, filename, count(*) as n from {fx_rects} where filename not in (select filename from {fx_review_events}) group by 2
union all select 'review', filename, count(*) from {fx_review} where filename not in (select filename from {fx_review_events}) group by 2""")
def _(t: Tables) -> DataFrame:
    left, rows = review.remove_file(t.fx_rects, t.fx_review, t.fx_review_events)
    both = left.select(F.lit("rects").alias("kind"), "filename").union(rows.select(F.lit("review"), "filename"))
    return both.groupBy("kind", "filename").agg(F.count(F.lit(1)).alias("n"))


@query("relabel", """
select PK, arg_max(Label, seq) filter (where Label <> '') as Label, strftime(arg_max(checked_at, seq), '%Y-%m-%d %H:%M:%S.%f') as checked from {fx_labels}
group by 1 having arg_min(Label, seq) filter (where Label <> '') in ('c', 's', 'e')""")
def _(t: Tables) -> DataFrame:
    rows = review.relabel(t.fx_labels, ["c", "s", "e"])
    return rows.select("PK", "Label", F.date_format("Check_datetime", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("checked"))


@query("order_by_last_modified", "select filename, last_modified from {fx_review}")
def _(t: Tables) -> DataFrame:
    return review.order_by_last_modified(t.fx_review.select("filename", "last_modified"))


@query("limit_manifest", "select filename, path from {fx_tags} order by path, filename limit 1000")
def _(t: Tables) -> DataFrame:
    return review.limit_manifest(t.fx_tags.select("filename", "path"), 1000, ["path", "filename"])


@query("label_frequency", """
select Label, count(*) as n, cast(round(100.0 * (select count(Label) from (select nullif(Label, '') as Label from {fx_labels}))
  / (select count(*) from {fx_labels})) as int) as progress from (select nullif(Label, '') as Label from {fx_labels}) group by 1""")
def _(t: Tables) -> DataFrame:
    return review.label_frequency(t.fx_labels.select(F.nullif("Label", F.lit("")).alias("Label")))


@query("label_frequency_quality", """
select quality as Label, count(*) as n, 100 as progress from {labels} group by 1""")
def _(t: Tables) -> DataFrame:
    return review.label_frequency(t.labels.withColumnRenamed("quality", "Label"))


# ---------------------------------------------------------------- suggestions

_SHOWN = f"""(select v.modality, v.image_type, v.n_rows, v.n_cols, v.model, {BOX}, case when min(r.filename) = max(r.filename) then min(r.filename) end as only_file
  from {{fx_rects}} r join {{fx_review}} v on r.filename = v.filename where {VALID} group by 1, 2, 3, 4, 5, {BOX})"""


@query("device_suggestions", f"select * from {_SHOWN}")
def _(t: Tables) -> DataFrame:
    return suggest.device_suggestions(t.fx_review, t.fx_rects)


@query("suggest_similar_rects", f"""
select t.filename, count(s.modality) as n_suggested from {{fx_tags}} t left join {_SHOWN} s on t.modality = s.modality
  and t.image_type = s.image_type and t.n_rows = s.n_rows and t.n_cols = s.n_cols and t.model = s.model
  and (only_file is null or only_file <> t.filename) group by 1""")
def _(t: Tables) -> DataFrame:
    return suggest.suggestion_counts(t.fx_tags, t.fx_review, t.fx_rects)


# ---------------------------------------------------------------- incremental


@query("skip_processed", """
select filename, path from {fx_tags} where filename not in (select filename from {fx_rects})
  and path not in (select filename from {fx_rects})""")
def _(t: Tables) -> DataFrame:
    return incremental.skip_processed(t.fx_tags.select("filename", "path"), t.fx_rects, resolved="path").select("filename", "path")


@query("redact_all_known", """
select distinct filename from {fx_rects} where filename not in (select filename from {fx_review} where mark)""")
def _(t: Tables) -> DataFrame:
    return incremental.redact_all_known(t.fx_rects, t.fx_review.where("mark"))


@query("stream_new_files", """
with arrived as (select concat('img', l_orderkey) as filename, l_linenumber as ord, case when l_orderkey % 3 < 2 and l_linenumber % 2 = 0 then 1 else 2 end as run from {lineitem})
select filename, ord, run from arrived a where run = 1 or filename not in (select filename from arrived where run = 1)""")
def _(t: Tables) -> DataFrame:
    """Two runs over a folder of many files, one file a batch; the rows of an image lie in several of them."""
    root = f"{checkpoint_root(t.spark)}/stream-{uuid.uuid4().hex}"
    first = (F.col("l_orderkey") % 3 < 2) & (F.col("l_linenumber") % 2 == 0)
    arrived = t.lineitem.select(F.concat(F.lit("img"), "l_orderkey").alias("filename"), F.col("l_linenumber").alias("ord"),
                                F.when(first, 1).otherwise(2).alias("run"))
    for run in (1, 2):
        arrived.where(F.col("run") == run).repartition(4).write.mode("append").parquet(f"{root}/landing")
        stream = new_files.read_landing(t.spark, arrived.schema, f"{root}/landing", max_files=1)
        new_files.stream_new_files(stream.withColumnRenamed("run", "came"), f"{root}/out", f"{root}/log", run)
    return new_files.read_stored(t.spark, f"{root}/out").withColumnRenamed("came", "run")
