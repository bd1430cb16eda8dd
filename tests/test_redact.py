"""Redaction against plain numpy, and the properties a redaction must keep."""

import random

import numpy as np

from scrubframe.operators import redact, rects

FRAME = "filename string, frame int, overlay int, n_rows int, n_cols int, samples int, bits_stored int, pixels array<int>"
RECT = "filename string, frame int, overlay int, box_left int, box_top int, box_right int, box_bottom int"


def make_frames(spark, samples=1):
    rng = np.random.default_rng(7)
    rows, arrays = [], {}
    for name, n in (("a", 3), ("b", 1), ("quiet", 1)):
        for f in range(n):
            px = rng.integers(1, 1024, size=(12, 20, samples))
            arrays[name, f, -1] = px
            rows.append((name, f, -1, 12, 20, samples, 8, px.ravel().tolist()))
        bits = rng.integers(0, 2, size=(12, 20, samples))
        arrays[name, 0, 0] = bits
        rows.append((name, 0, 0, 12, 20, samples, 1, bits.ravel().tolist()))
    return spark.createDataFrame(rows, FRAME), arrays


def make_rects(spark, seed=1, n=40):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        l, t = rng.randrange(-1, 22), rng.randrange(-1, 14)
        frame, overlay = rng.choice([(0, -1), (1, -1), (2, -1), (-1, -1), (0, 0)])
        rows.append((rng.choice("abc"), frame, overlay, l, t, l + rng.randrange(-1, 4), t + rng.randrange(-1, 3)))
    return spark.createDataFrame(rows, RECT), rows


def covered(rows, name, pick):
    mask = np.zeros((12, 20), dtype=bool)
    for fn, frame, overlay, l, t, r, b in rows:
        if fn == name and pick(frame, overlay) and l >= 0 and t >= 0 and r >= l and b >= t:
            mask[t:b + 1, l:r + 1] = True
    return mask


def check(result, arrays, rows, pick, change):
    got = {(r.filename, r.frame, r.overlay): np.array(r.pixels) for r in result.collect()}
    assert got.keys() == arrays.keys()
    for (name, frame, overlay), px in arrays.items():
        want = px.copy()
        mask = covered(rows, name, lambda f, o: pick(frame, overlay, f, o))
        want[mask] = change(want[mask], overlay)
        assert np.array_equal(got[name, frame, overlay], want.ravel()), (name, frame, overlay)


def test_frames(spark):
    for samples in (1, 3):
        frames, arrays = make_frames(spark, samples)
        boxes, rows = make_rects(spark)
        result = redact.redact_frames(frames, boxes)
        check(result, arrays, rows, lambda F, O, f, o: O == -1 and o == -1 and f in (-1, F), lambda p, o: p & ~255)
        report = redact.redaction_report(result, boxes).collect()
        assert report and all(r.n_left == 0 for r in report)
        untouched = redact.redaction_report(frames, boxes)
        assert untouched.agg({"n_left": "sum"}).first()[0] > 0


def test_everything(spark):
    frames, arrays = make_frames(spark)
    boxes, rows = make_rects(spark, 2)
    check(redact.redact_all(frames, boxes, high_bits=512), arrays, rows, lambda F, O, f, o: (f, o) == (-1, -1),
          lambda p, o: p & ~255 & ~512 if o == -1 else p * 0)


def test_overlays(spark):
    frames, arrays = make_frames(spark)
    boxes, rows = make_rects(spark, 3)
    check(redact.redact_overlay_frame(frames, boxes), arrays, rows,
          lambda F, O, f, o: O >= 0 and ((f, o) == (-1, -1) or (f, o) == (F, O)), lambda p, o: p * 0)
    check(redact.redact_highbit_overlay(frames, boxes, 0, 9), arrays, rows,
          lambda F, O, f, o: O == -1 and o == 0, lambda p, o: p & ~512)


def test_hidden_boxes_change_nothing(spark):
    frames, _ = make_frames(spark)
    boxes, _ = make_rects(spark, 5, 80)
    boxes = boxes.where("box_right > box_left and box_bottom > box_top and box_left >= 0 and box_top >= 0")
    full = redact.redact_frames(frames, boxes).select("filename", "frame", "overlay", "pixels")
    lean = redact.redact_frames(frames, rects.maximal_rects(boxes)).select("filename", "frame", "overlay", "pixels")
    assert sorted(full.collect()) == sorted(lean.collect())


def test_a_third_of_the_boxes_in_one_frame(spark):
    frames, arrays = make_frames(spark)
    boxes, rows = make_rects(spark, 6, 30)
    hot = [("a", 0, -1, i % 19, i % 11, i % 19, i % 11) for i in range(5000)]
    marks = redact.frame_marks(spark.createDataFrame(rows + hot, RECT), frames)
    sizes = {(r.filename, r.frame, r.overlay): len(r.mark_x) for r in marks.collect()}
    assert max(sizes.values()) <= 12 * 20
    result = redact.redact_frames(frames, spark.createDataFrame(rows + hot, RECT))
    check(result, arrays, rows + hot, lambda F, O, f, o: O == -1 and o == -1 and f in (-1, F), lambda p, o: p & ~255)


def test_report_has_no_text(spark):
    boxes = spark.createDataFrame([("/pacs/a/f", 0, -1, 1, 2, 3, 4, "jane"), ("/pacs/g", 0, -1, -1, -1, -1, -1, "jane")], RECT + ", ocrtext string")
    out = redact.export_rects_no_pii(boxes, "/pacs")
    assert out.columns == ["filename", "box_left", "box_top", "box_right", "box_bottom", "frame", "overlay"]
    assert [tuple(r) for r in out.collect()] == [("a/f", 1, 2, 3, 4, 0, -1)]


def test_constant_frame_is_not_stretched(spark):
    df = spark.createDataFrame([("a", [5, 5]), ("b", [-10, 0, 10])], "filename string, pixels array<int>")
    assert {r.filename: r.pixels for r in redact.contrast_stretch(df).collect()} == {"a": [5, 5], "b": [0, 127, 255]}


def test_contrast_stretch_of_a_large_frame_is_quick(spark):
    import time

    from pyspark.sql import functions as F

    from scrubframe.functions import pixels
    frame = spark.range(1).select(F.sequence(F.lit(0), F.lit(512 * 512 - 1)).alias("pixels"))
    start = time.time()
    low, high = frame.select(pixels.contrast_stretch(F.col("pixels")).alias("p")).select(F.array_min("p"), F.array_max("p")).first()
    assert (low, high) == (0, 255) and time.time() - start < 20


def test_no_pixel_moves(spark, tables, tmp_path):
    import re
    stored = redact.store_frames(tables.fx_frames, "frames_of_test", 4, str(tmp_path / "frames"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (redact.redact_frames(stored, tables.fx_frame_rects), redact.redact_all(stored, tables.fx_frame_rects)):
            plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            moved = [b for b in re.split(r"\n\n+", plan) if re.match(r"\(\d+\) Exchange", b)]
            assert moved and not any("pixels" in b for b in moved)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table frames_of_test")


def test_boxes_on_missing_frames_are_reported(spark):
    frames = spark.createDataFrame([("f", 0, -1, 2, 2, 1, 8, [0, 0, 0, 5])], "filename string, frame int, overlay int, n_rows int, n_cols int, samples int, bits_stored int, pixels array<int>")
    box = [(name, frame, -1, 0, 0, 0, 0) for name, frame in (("f", 0), ("f", -1), ("f", 7), ("f", 7), ("g", 0), ("g", -1))]
    rects = spark.createDataFrame(box, "filename string, frame int, overlay int, box_left int, box_top int, box_right int, box_bottom int")
    got = redact.redaction_report(frames, rects).collect()
    assert sorted(map(tuple, got)) == [("f", 0, -1, 2, 2, 0), ("f", 7, -1, 2, 0, 0), ("g", -1, -1, 1, 0, 0), ("g", 0, -1, 1, 0, 0)]
