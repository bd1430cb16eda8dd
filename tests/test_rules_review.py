"""Rules, suggestions, review state, sources and the stream."""

from pyspark.sql import functions as F

from scrubframe.operators import incremental, numbering, review, rules, sample, suggest
from scrubframe.plans.queries_boxes import RECIPE, RULE_COLUMNS
from scrubframe.sources import files, ocr
from scrubframe.streaming import new_files

REGION = "array<struct<x0:int,y0:int,x1:int,y1:int>>"
RECT = "filename string, frame int, overlay int, box_left int, box_top int, box_right int, box_bottom int, ocrtext string, ord int"

RECIPE_TEXT = """FORMAT dicom
# a comment
%filter graylist
LABEL First rule
  contains Modality XA
  + contains Creator A_1.0|B C
  + equals Rows 1024
  coordinates 0,0,196,148
  coordinates 706,0,1023,66

LABEL Second
  present Regions   # trailing comment
  keepcoordinates from:Regions
"""


def test_recipe_text(spark, tmp_path):
    path = tmp_path / "recipe.txt"
    path.write_text(RECIPE_TEXT)
    got = files.collect_rules(files.src_rules(spark, str(path)))
    assert got == [
        rules.Rule("First rule", (("contains", "Modality", "XA"), ("contains", "Creator", "A_1.0|B C"), ("equals", "Rows", "1024")),
                   (("redact", "0,0,196,148"), ("redact", "706,0,1023,66"))),
        rules.Rule("Second", (("present", "Regions", ""),), (("keep", "from:Regions"),))]


def test_known_device(spark):
    tags = spark.createDataFrame([("f", "XA", "ZiehmNetPort", 1024, 1024, "", "", None), ("g", "CT", "ZiehmNetPort", 1024, 1024, "", "", None)],
                                 f"filename string, modality string, model string, n_rows int, n_cols int, private_creator string, capture_data string, regions {REGION}")
    assert [(r.filename, r.rule_id) for r in rules.match_rules(tags, RECIPE, RULE_COLUMNS).collect()] == [("f", 4)]
    boxes = rules.keep_redact_combine(rules.rule_boxes(tags, RECIPE, RULE_COLUMNS)).collect()
    assert tuple(boxes[0]) == ("f", -1, -1, 0, 0, 196, 148) and len(boxes) == 3


def test_keep_and_redact(spark):
    boxes = "array<struct<box_left:int,box_top:int,box_right:int,box_bottom:int>>"
    df = spark.createDataFrame([("f", 480, 640, [(32, 24, 335, 415), (336, 24, 639, 415), (32, 40, 63, 103)], [(33, 34, 35, 36), (41, 42, 43, 44)])],
                               f"filename string, n_rows int, n_cols int, keep {boxes}, redact {boxes}")
    got = {tuple(r)[3:] for r in rules.keep_redact_combine(df).collect()}
    assert got == {(0, 0, 639, 24), (0, 24, 32, 415), (335, 24, 336, 415), (0, 415, 639, 479), (33, 34, 35, 36), (41, 42, 43, 44)}


def test_whole_image_redaction_is_ignored(spark):
    rule = rules.Rule("all", (("contains", "Modality", "CT"),), (("redact", "all"), ("redact", "1,1,5,5")))
    tags = spark.createDataFrame([("f", "CT", 10, 10)], "filename string, modality string, n_rows int, n_cols int")
    row = rules.rule_boxes(tags, [rule], RULE_COLUMNS).first()
    assert [tuple(b) for b in row.redact] == [(1, 1, 5, 5)] and row.keep == []


def test_rule_text_round_trip(spark, tmp_path):
    sets = spark.createDataFrame([("CT", 5, 6, "Mk", "Mod", "", "", "v1", 1, 2, 3, 4), ("CT", 5, 6, "Mk", "Mod", "", "", "v1", 5, 6, 7, 8),
                                  ("MR", 5, 6, "", "", "s", "t", "", 1, 2, 3, 4)],
                                 "modality string, n_rows int, n_cols int, manufacturer string, model string, sc_manufacturer string,"
                                 "sc_model string, software string, box_left int, box_top int, box_right int, box_bottom int")
    rules.snk_rules(sets, str(tmp_path / "out"))
    back = files.collect_rules(files.src_rules(spark, str(tmp_path / "out" / "part-*")))
    assert sorted(len(r.boxes) for r in back) == [1, 2]
    two = next(r for r in back if len(r.boxes) == 2)
    assert two.predicates == (("contains", "Modality", "CT"), ("contains", "Manufacturer", "Mk"), ("contains", "ManufacturerModelName", "Mod"),
                              ("contains", "SoftwareVersions", "v1"), ("equals", "Rows", "5"), ("equals", "Columns", "6"))


def test_large_rules_cross_files(spark, tmp_path):
    rows = [("CT", 5, 6, "Mk", "Mod", "", "", "v1", i, 2, 300 + i, 4) for i in range(40)]
    rows += [("MR", 5, 6, "Mk", "", "", "", "", 1, 2, 3, 4)]
    sets = spark.createDataFrame(rows, "modality string, n_rows int, n_cols int, manufacturer string, model string, sc_manufacturer string,"
                                       "sc_model string, software string, box_left int, box_top int, box_right int, box_bottom int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rules.snk_rules(sets, str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "out").glob("part-*"))) > 2
    back = files.src_rules(spark, str(tmp_path / "out")).collect()
    assert sorted(len(r.boxes) for r in back) == [1, 40] and len({r.label for r in back}) == 2
    assert {b.coords for r in back if len(r.boxes) == 40 for b in r.boxes} == {f"{i},2,{300 + i},4" for i in range(40)}


def test_lines_of_rules_across_files_keep_their_rule(spark, tmp_path):
    rows = [("CT", 5, 6, "Mk", "Mod", "", "", "v1", i, 2, 300 + i, 4) for i in range(40)]
    rows += [("MR", 5, 6, "Mk", "", "s", "t", "", 1, 2, 3, 4)]
    sets = spark.createDataFrame(rows, "modality string, n_rows int, n_cols int, manufacturer string, model string, sc_manufacturer string,"
                                       "sc_model string, software string, box_left int, box_top int, box_right int, box_bottom int")
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "200"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        rules.snk_rules(sets, str(tmp_path / "out"))
        lines = files.src_rule_lines(spark, str(tmp_path / "out")).withColumn("part", rules.line_part(F.col("line"))).collect()
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert len(list((tmp_path / "out").glob("part-*"))) > 2
    want = sorted((r.rule_key, r.part, r.line) for r in rules.rule_lines(sets).collect())
    assert sorted((r.label.removeprefix("LABEL device "), r.part, r.line) for r in lines) == want


def suggestion_tables(spark):
    keys = ("CT", "ORIGINAL/PRIMARY", 1024, 1024, "")
    review_rows = spark.createDataFrame([("file3", True, *keys), ("file4", False, *keys), ("file5", False, "MR", *keys[1:])],
                                        "filename string, mark boolean, modality string, image_type string, n_rows int, n_cols int, model string")
    boxes = spark.createDataFrame([("file1", 0, -1, 10, 10, 20, 20, "", 1), ("file2", 0, -1, 10, 10, 30, 30, "10/11/23", 1),
                                   ("file3", 0, -1, 10, 10, 40, 40, "", 1), ("file4", 0, -1, 10, 10, 50, 50, "", 1),
                                   ("file5", 0, -1, 1, 1, 9, 9, "", 1)], RECT)
    targets = spark.createDataFrame([("random", *keys), ("file4", *keys)],
                                    "filename string, modality string, image_type string, n_rows int, n_cols int, model string")
    return targets, review_rows, boxes


def test_suggestions(spark):
    targets, review_rows, boxes = suggestion_tables(spark)
    merged = suggest.suggest_similar_rects(targets, review_rows, boxes).collect()
    assert sorted((r.filename, r.box_right) for r in merged) == [("file4", 40), ("random", 50)]
    done = suggest.suggest_similar_rects(targets, review_rows, boxes, only_done=True).collect()
    assert [(r.filename, r.box_right) for r in done] == [("random", 50)]
    single = suggest.suggest_similar_rects(targets, review_rows, boxes, coalesce=False)
    counts = suggest.suggestion_counts(targets, review_rows, boxes)
    assert {r.filename: r.n_suggested for r in counts.collect()} == {"random": 2, "file4": 1}
    assert {r.filename: r["count"] for r in single.groupBy("filename").count().collect()} == {"random": 2, "file4": 1}
    assert suggest.suggestion_counts(targets, review_rows, boxes, frame=1, overlay=-1).agg(F.sum("n_suggested")).first()[0] == 0


def test_review_log(spark):
    log = spark.createDataFrame([("a", 1, True, "first", 1), ("a", 2, False, "", 2), ("b", 1, True, None, 1)],
                                "filename string, seq int, mark boolean, comment string, last_modified int")
    assert sorted(map(tuple, review.upsert_review(log).collect())) == [("a", False, "first", 2), ("b", True, None, 1)]
    acts = [("a", 1, "toggle"), ("b", 1, "set"), ("b", 2, "toggle"), ("c", 1, "toggle"), ("c", 2, "set"), ("d", 5, "clear"),
            ("d", 70_000, "toggle"), ("d", 140_000, "toggle"), ("d", 200_000, "toggle"), ("e", 1, "look"), ("f", 1, "toggle"), ("f", 2, "toggle")]
    marks = review.toggle_mark(spark.createDataFrame(acts, "filename string, seq int, action string"))
    assert {r.filename: r.mark for r in marks.collect()} == {"a": True, "b": False, "c": True, "d": True, "f": False}
    labels = spark.createDataFrame([("p", 1, "O", 10), ("p", 2, "", 11), ("q", 1, "O", 10), ("q", 2, "P", 12), ("r", 1, "P", 1)],
                                   "PK string, seq int, Label string, checked_at int")
    assert sorted(map(tuple, review.relabel(labels, ["O"]).collect())) == [("p", "O", 11), ("q", "P", 12)]
    assert sorted((r.Label or "", r.n, r.progress) for r in review.label_frequency(
        spark.createDataFrame([("x",), ("x",), (None,)], "Label string")).collect()) == [("", 1, 67), ("x", 2, 67)]


def test_incremental(spark):
    listed = spark.createDataFrame([("a", "/r/a"), ("b", "/r/b"), ("c", "/r/c")], "filename string, real string")
    seen = spark.createDataFrame([("a",), ("/r/b",), ("a",)], "filename string")
    assert [r.filename for r in incremental.skip_processed(listed, seen, "real").collect()] == ["c"]
    assert [r.filename for r in incremental.redact_all_known(seen, seen.where("filename = 'a'")).collect()] == ["/r/b"]


def test_ocr_round_trip(spark, tmp_path):
    rows = [("f", 0, -1, 1, 2, 3, 4, 2, 'say "x", y', 50, 1), ("f", 1, 0, 5, 6, 7, 8, 1, "", 10, 0), ("g", 0, -1, -1, -1, -1, -1, 2, "all", 50, 1)]
    df = spark.createDataFrame(rows, "filename string, frame int, overlay int, box_left int, box_top int, box_right int, box_bottom int,"
                                     "ocrengine int, ocrtext string, nerengine int, nerpii int")
    ocr.snk_ocr_csv(df, str(tmp_path / "csv"))
    back = ocr.src_ocr_csv(spark, str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect())) == sorted(r for r in rows if r[3] >= 0)
    assert ocr.src_ocr_csv(spark, str(tmp_path / "csv"), "f", 1, 0).count() == 1
    ocr.append_rects(df.select("filename", "box_left", "box_top", "box_right", "box_bottom"), str(tmp_path / "store"))
    ocr.append_rects(df, str(tmp_path / "store"))
    stored = spark.read.parquet(str(tmp_path / "store"))
    assert stored.count() == 6 and stored.where("ocrengine = -1 and nerpii = -1 and ocrtext = ''").count() == 3
    boxes, tags = ocr.dump_db_json(stored, spark.createDataFrame([("f", "['A', 'B']", 1)], "filename string, image_type string, last_modified int"))
    assert boxes.count() == 6 and '"image_type":["A","B"]' in tags.first().value


def test_file_lists(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.dcm", "README.md", "notes.txt", "sub/b", "sub/list.csv"):
        (tmp_path / name).write_text("x")
    listing = files.list_files(spark, [str(tmp_path)])
    found = [r.path.rsplit("/", 1)[1] for r in listing.collect()]
    assert sorted(found) == ["a.dcm", "b"]
    paths = listing.select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
    manifest = spark.createDataFrame([("a.dcm",), ("b",), ("nope",), ("s3://b/k",), (str(tmp_path / "a.dcm"),)], "filename string")
    got = files.resolve_manifest(manifest, paths, [str(tmp_path), str(tmp_path / "sub") + "/"]).collect()
    assert sorted(r.path for r in got) == sorted([str(tmp_path / "a.dcm"), str(tmp_path / "sub/b"), str(tmp_path / "a.dcm"), "s3://b/k"])
    csv = spark.createDataFrame([("s1", "r1"), ("s1", "r2"), ("s2", "r3")], "study string, series string")
    prefix = lambda df: sorted(r.prefix for r in df.collect())
    assert prefix(files.series_manifest(csv)) == ["s1/r1/", "s1/r2/", "s2/r3/"]
    assert prefix(files.series_manifest(csv, studies=["s1"])) == ["s1/r1/", "s1/r2/"]
    assert prefix(files.series_manifest(csv, series=["r3"])) == ["s2/r3/"]
    assert prefix(files.series_manifest(csv, ["s9"], ["r9"])) == ["s9/r9"]
    assert prefix(files.series_manifest(None, ["s9", "s8"], spark=spark)) == ["s8/", "s9/"]


def test_stream_skips_known_files(spark, tmp_path):
    landing, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    schema = "filename string, ord int"

    def arrive(run, *batches):
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
        stream = new_files.read_landing(spark, spark.createDataFrame([], schema).schema, landing, max_files=1)
        new_files.stream_new_files(stream, out, log, run)
        return sorted(map(tuple, new_files.read_stored(spark, out).fillna("-").collect()))

    first = [("-", 5), ("a", 1), ("a", 2), ("a", 3)]
    assert arrive(1, [("a", 1), ("a", 2)], [("a", 3), (None, 5)]) == first
    # A run that is repeated under its number changes nothing; rows of known names stay out.
    assert arrive(1) == first
    second = sorted([*first, ("b", 1), ("b", 2)])
    assert arrive(2, [("a", 1), ("b", 1)], [(None, 6)], [("b", 2)]) == second
    assert arrive(3, [("c", 1), ("b", 7)]) == sorted([*second, ("c", 1)])


def test_positions_with_ties_and_hot_groups(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id") % 13).alias("g"), (F.col("id") % 5).alias("k"), "id")
    rows = numbering.with_position(df, ["k"], "pos", "n").collect()
    assert sorted(r.pos for r in rows) == list(range(1, 3001)) and {r.n for r in rows} == {3000}
    by_pos = [r.k for r in sorted(rows, key=lambda r: r.pos)]
    assert by_pos == sorted(by_pos)
    grouped = numbering.with_group_position(df, ["g"], ["id"]).collect()
    for g in {r.g for r in grouped}:
        mine = sorted((r for r in grouped if r.g == g), key=lambda r: r.id)
        assert [r.pos for r in mine] == list(range(1, len(mine) + 1))


def test_splits(spark):
    df = spark.range(11).withColumnRenamed("id", "k")
    halves = numbering.split_halves(df, ["k"]).groupBy("half").count().collect()
    assert {r.half: r["count"] for r in halves} == {1: 5, 2: 6}
    assert [r.batch for r in numbering.batches_of_n(df, 4, ["k"]).orderBy("k").collect()] == [0] * 4 + [1] * 4 + [2] * 3
    assert {r.part: r["count"] for r in numbering.split_80_20_ordered(df, ["k"]).groupBy("part").count().collect()} == {"training": 8, "validation": 3}


def test_samples(spark):
    df = spark.range(200).select((F.col("id") % 3).cast("string").alias("g"), F.col("id").cast("string").alias("k"))
    once = sample.group_sample_n(df, ["g"], 5, "k", seed=1)
    assert once.count() == 15 and once.select("g", "k").distinct().count() == 15
    assert sorted(once.collect()) == sorted(sample.group_sample_n(df.repartition(7), ["g"], 5, "k", seed=1).collect())
    again = sample.group_sample_n(df.where("k < 6"), ["g"], 20, "k", seed=1, replace=True)
    assert again.groupBy("g").count().where("count <> 20").count() == 0 and again.select("g", "k").distinct().count() == 6
    wide = sample.combo_sample_n(df, ["g"], "k", k=4, seed=2).collect()
    assert {r.combination for r in wide} == {"0,", "1,", "2,"} and all(r.d3 is not None for r in wide)
    assert sample.combo_sample_n(df, ["g"], "k", k=4, seed=2, replace=True).count() == 3
    parts = sample.split_80_20_random(df, "k", seed=3).groupBy("part").count().collect()
    assert {r.part for r in parts} == {"training", "validation"}
