"""Tag expressions, names and identifiers."""

import hashlib

import pytest
from pyspark.sql import functions as F

from scrubframe.functions import tags as G
from scrubframe.functions import text as X
from scrubframe.operators import classify, identify, profile
from scrubframe.sources import tags as src


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,want", [
    ("X", "X"), (r"X\Y", "X/Y"), (r"X\\Y", "X/Y"), (r"X\Y\Z", "X/Y"), ("", ""),
    (r"DERIVED\SECONDARY\POST_PROCESSED\RT\\\\150000", "DERIVED/SECONDARY"),
    (r"DERIVED\\SECONDARY\\POST_PROCESSED\\RT\\\\150000", "DERIVED/SECONDARY")])
def test_imagetype_summary_text(spark, text, want):
    assert one(spark, G.imagetype_summary_text(F.lit(text))) == want


@pytest.mark.parametrize("words,want", [(["X"], "X"), (["X", "Y"], "X/Y"), (["X", "Y", "Z"], "X/Y")])
def test_imagetype_summary_list(spark, words, want):
    assert one(spark, G.imagetype_summary(F.array(*(F.lit(w) for w in words)))) == want


@pytest.mark.parametrize("args,want", [
    (("man", "mod", "", "", "1.2"), "mod"), (("man", "", "", "", "1.2"), "man 1.2"),
    (("man", "mod", "scman", "scmod", "1.2"), "mod"), (("man", "", "scman", "scmod", "1.2"), "scmod"),
    (("", "", "scman", "scmod", "1.2"), "scmod"), (("", "", "scman", "", "1.2"), "scman 1.2"),
    (("", "", "", "", ""), "NoModel")])
def test_derived_model_name(spark, args, want):
    assert one(spark, G.derived_model_name(*(F.lit(a) for a in args))) == want


def test_fix_imagetype(spark):
    empty = F.lit("")
    secondary = G.is_secondary_capture(F.lit("1.2.840.10008.5.1.4.1.1.7.1"), empty, empty, empty)
    plain = G.is_secondary_capture(empty, empty, empty, empty)
    assert one(spark, G.fix_imagetype(F.lit("ORIG/PRIM"), plain)) == "ORIG/PRIM"
    assert one(spark, G.fix_imagetype(empty, plain)) == ""
    assert one(spark, G.fix_imagetype(empty, secondary)) == "DERIVED/SECONDARY"
    assert one(spark, G.fix_imagetype(empty, plain, "NoImageType")) == "NoImageType"


def test_tag_default(spark):
    for value in (F.lit(None).cast("string"), F.lit(""), F.lit(0)):
        assert one(spark, G.tag_default(value, "D")) == "D"
    assert one(spark, G.tag_default(F.lit(0), "D", keep_zero=True)) == "0"
    assert one(spark, G.tag_default(F.lit("v"), "D")) == "v" and one(spark, G.tag_default(F.lit("0"), "D")) == "0"
    assert one(spark, G.tag_default(F.lit(-0.0), "D")) == "D" and one(spark, G.tag_default(F.lit(10), "D")) == "10"


def test_flatten_documents(spark, tmp_path):
    path = tmp_path / "docs"
    path.mkdir()
    (path / "a.json").write_text(
        '{"Modality":"CT","header":{"DicomFilePath":"a.dcm"},"ImageType":["ORIGINAL","PRIMARY","AXIAL"],"Rows":512,"Manufacturer":"M","SoftwareVersions":"7"}\n'
        '{"Modality":"CR","header":{"DicomFilePath":"b.dcm"},"ImageType":"DERIVED\\\\SECONDARY\\\\X","NumberOfFrames":0,"(6000,0040)-OverlayType":"G"}\n'
        '{"Modality":"PX","header":{"DicomFilePath":"c.dcm"},"SOPClassUID":"1.2.840.10008.5.1.4.1.1.7"}\n')
    rows = {r.DicomFilePath: r for r in src.flatten_documents(src.src_tags(spark, str(path))).collect()}
    assert len(rows["a.dcm"]) == 31
    assert (rows["a.dcm"].ImageType2, rows["a.dcm"].ModelName, rows["a.dcm"].Rows) == ("ORIGINAL/PRIMARY", "M 7", "512")
    assert (rows["b.dcm"].ImageType2, rows["b.dcm"].NumberOfFrames, rows["b.dcm"].OverlayType) == ("DERIVED/SECONDARY", "1", "G")
    assert (rows["c.dcm"].ImageType2, rows["c.dcm"].BurnedInAnnotation, rows["c.dcm"].ModelName) == ("DERIVED/SECONDARY", "NOBIATAG", "NoModel")
    assert src.src_tags(spark, str(path), ["PX"]).count() == 1


def test_collections_and_types(spark, tmp_path):
    for name, lines in {"CT": ['{"Rows":0}', '{"Modality":"MR","Rows":"0"}', '{"Modality":"","Rows":512}'], "OTHER": ['{"Modality":"US"}', '{"Modality":"PX"}', '{}'],
                        "MR": ['{"Modality":"CT"}']}.items():
        (tmp_path / f"collection={name}").mkdir()
        (tmp_path / f"collection={name}" / "a.json").write_text("\n".join(lines))
    rows = src.flatten_documents(src.src_tags(spark, str(tmp_path), ["CT", "US"])).select("Modality", "Rows").collect()
    assert sorted(map(tuple, rows)) == [("CT", ""), ("CT", "512"), ("MR", "0"), ("US", "")]
    assert src.src_tags(spark, str(tmp_path)).count() == 7
    assert "PartitionFilters: [(" in src.src_tags(spark, str(tmp_path), ["CT"])._jdf.queryExecution().executedPlan().toString()


def test_tag_table_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("x", 1)], "a string, _id int")
    src.dump_tags_json(docs, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).columns == ["a"]
    flat = spark.createDataFrame([("CT", "a,b", "", 'say "x"'), ("MR", "c", "v", "")],
                                 "Modality string, Manufacturer string, SoftwareVersions string, SeriesDescription string")
    src.snk_tags_csv(flat, str(tmp_path / "csv"))
    back = src.src_csv_text(spark, str(tmp_path / "csv")).drop("_part")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, flat.collect()))
    device = flat.withColumn("Rows", F.lit("5")).withColumn("Columns", F.lit("6")).withColumn("DicomFilePath", F.lit("p"))
    src.partition_by_device(device, str(tmp_path / "dev"))
    assert spark.read.parquet(str(tmp_path / "dev")).count() == 2


def test_overview(spark):
    row = spark.createDataFrame([("f", "CT", "M", "Mod", "", "", "", "ORIGINAL\\PRIMARY\\AXIAL", "YES", 5, 6, "")],
                                "filename string, modality string, manufacturer string, model string, sc_manufacturer string,"
                                "sc_model string, software string, image_type string, burned_in string, n_rows int, n_cols int, sop_class string")
    assert src.tag_overview(row).first().overview == "CT, BIA=YES, ImType=ORIG\\PRIM\\A, Model=Mod"


def test_numeric_stats(spark):
    df = spark.createDataFrame([(" ",)] * 3 + [("256",)] * 4 + [("[512]",)] * 6 + [("X",)] * 9, "v string")
    row = profile.profile_numeric_stats(df, ["v"]).first()
    assert (row.n_na, row.n, row.min, row.max, row.total) == (12, 10, 256, 512, 256 * 4 + 512 * 6)
    assert row["mean"] == row.total / 10
    none = profile.profile_numeric_stats(df.where("v = 'X'"), ["v"]).first()
    assert (none.n_na, none.n, none.min, none.max, none.total) == (9, 0, None, None, 0)


@pytest.mark.parametrize("path,kw,want", [
    ("file", {}, "file.redacted.dcm"), ("file.dcm", {}, "file.redacted.dcm"), ("/tmp/file.dcm", {}, "/tmp/file.redacted.dcm"),
    ("/tmp/file.dcm", {"suffix": "_redacted.dcm"}, "/tmp/file_redacted.dcm"), ("/tmp/file", {"suffix": "_redacted.dcm"}, "/tmp/file_redacted.dcm"),
    ("file.dcm", {"target": "newfile.dcm", "target_is_file": True}, "newfile.dcm"), ("file.dcm", {"target": "/tmp"}, "/tmp/file.redacted.dcm"),
    ("/path/to/Study/Series/file.dcm", {"target": ".", "relative": "/path/to"}, "./Study/Series/file.dcm"),
    ("/path/to/Study/Series/file-an", {"target": "/tmp", "relative": "/path/to"}, "/tmp/Study/Series/file-an"),
    ("/tmp/Study/Series/file-an", {"target": "/tmp", "relative": "/tmp", "suffix": "_redacted.dcm"}, "/tmp/Study/Series/file-an"),
    ("/tmp/Study/Series/file-an", {"suffix": None}, "/tmp/Study/Series/file-an"), ("/f.dcm", {}, "/f.redacted.dcm")])
def test_output_path(spark, path, kw, want):
    assert one(spark, X.output_path(F.lit(path), **kw)) == want


def test_urls(spark):
    url = F.lit("s3://acc:se/cr@host:9000/bucket/a/b/c.dcm")
    assert tuple(one(spark, X.url_parse(F.lit("s3://acc:sec@host/bucket/a/b")))) == ("acc", "sec", "host", "bucket", "a/b")
    assert one(spark, X.url_sanitise(url)) == "s3://bucket/a/b/c.dcm"
    assert one(spark, X.url_parse(F.lit("s3://bucket/key"))) is None
    assert one(spark, X.url_compare(F.lit("s3://a:b@h/buck/k"), F.lit("s3://c:d@h/buck/k")))
    assert one(spark, X.url_build(F.lit("a"), F.lit("b"), F.lit("http://h/"), F.lit("k"), F.lit("p/q"))) == "s3://a:b@h/k/p/q"
    assert one(spark, X.url_build(None, None, F.lit("h"), F.lit("k"), F.lit("p/q"))) == "s3://k/p/q"


def test_engine_codes(spark):
    assert one(spark, X.ner_enum_name(F.lit(20))) == "flair" and one(spark, X.ner_enum(F.lit("flair"))) == 20
    assert one(spark, X.ner_enum(F.lit("spacy"))) == 10 and one(spark, X.ner_enum(F.lit("?"))) == -1
    assert one(spark, X.ocr_enum_name(F.lit(2))) == "easyocr" and one(spark, X.ocr_enum(F.lit("easyocr"))) == 2
    assert one(spark, X.ocr_enum_name(F.lit(9))) is None


def test_pseudonyms(spark):
    want = str(int(hashlib.blake2s(b"1.2.3", digest_size=16, salt=b"pepper").hexdigest(), 16))
    assert one(spark, X.pseudonymise_uid(F.lit("1.2.3"), "pepper", "blake2s")) == want
    df = spark.createDataFrame([("1.2", "1.2.3", "1.2.3.4", "/root/1.2/1.2.3/1.2.3.4.dcm")], "study string, series string, sop string, path string")
    row = identify.pseudonymise_ids(df, "pepper", "blake2s").first()
    assert row.path == f"/root/{row.study}/{row.series}/{row.sop}.dcm" and row.series == want
    salt = "a salt of more than eight bytes"
    ids = [*(f"1.2.{k}" for k in range(300)), None]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(ids)], "k int, v string").select("v", X.pseudonymise_uid(F.col("v"), salt).alias("h")).collect()
    assert all(r.h == (None if r.v is None else str(int(hashlib.sha256((salt + r.v).encode()).hexdigest()[:30], 16))) for r in got)
    for digits in ("0" * 30, "f" * 30, "0" * 15 + "de0b6b3a7640000", "0" * 29 + "1", "8" + "0" * 29):
        assert one(spark, X.decimal_digits(F.lit(digits))) == str(int(digits, 16))
    for bad in ((salt, "blake2s"), ("", "decimal")):
        with pytest.raises(ValueError):
            X.pseudonymise_uid(F.lit("1"), *bad)


def test_form_labels(spark):
    df = spark.createDataFrame([("Masterpage Ltd", "m"), ("a", "bv family 3"), ("a", None), ("a", "b")], "manufacturer string, model string")
    assert [r.is_form for r in classify.form_label_rule(df).collect()] == [True, True, True, False]


def test_no_path_gives_no_row(spark):
    from scrubframe.sources import files
    tags = spark.createDataFrame([("DX", "/a/x.dcm")], "modality string, path string")
    assert files.find_path(tags, "nothing").count() == 0
    assert files.find_path(tags, "x.d").first()["path"] == "/a/x.dcm"
