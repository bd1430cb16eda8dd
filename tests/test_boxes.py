"""Box algebra: expected values, and agreement with plain Python on generated boxes."""

import random

from pyspark.sql import functions as F

from scrubframe.functions import boxes as B
from scrubframe.functions.boxes import Box
from scrubframe.operators import rects

BOX_SCHEMA = "filename string, frame int, overlay int, box_left int, box_top int, box_right int, box_bottom int, ocrtext string, ord int"


def lit(l, t, r, b):
    return Box(*(F.lit(v) for v in (l, t, r, b)))


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def table(spark, rows):
    return spark.createDataFrame(rows, BOX_SCHEMA)


def test_similar_edges(spark):
    one, two, three = lit(30, 10, 40, 20), lit(33, 13, 38, 17), lit(33, 13, 35, 17)
    assert value(spark, B.rect_similar(one, two))
    assert not value(spark, B.rect_similar(one, three))
    assert value(spark, B.rect_similar(two, three))


def test_similar_text(spark):
    names = ["jane maclean", "jane maclan", "jane macla"]
    assert value(spark, B.text_similar(F.lit(names[0]), F.lit(names[1])))
    assert not value(spark, B.text_similar(F.lit(names[0]), F.lit(names[2])))
    assert value(spark, B.text_similar(F.lit(names[1]), F.lit(names[2])))
    # A swap of neighbours is one edit, but two for the plain distance.
    assert B.edit_distance("abcdefghij", "abcdefghji") == 1
    assert value(spark, B.text_similar(F.lit("abcdefghij"), F.lit("abcdefghji")))
    assert value(spark, B.text_similar(F.lit(""), F.lit("")))


def test_mbr_and_validity(spark):
    box = value(spark, B.box_struct(B.rect_mbr(lit(30, 10, 40, 20), lit(33, 12, 44, 22))))
    assert tuple(box) == (30, 10, 44, 22)
    assert value(spark, B.rect_is_valid(lit(2, 1, 12, 11)))
    assert not value(spark, B.rect_is_valid(lit(-1, -1, -1, -1)))
    assert tuple(value(spark, B.rect_ltwh(lit(2, 1, 12, 11)))) == (2, 1, 11, 11)
    assert tuple(value(spark, B.rect_ltrb(lit(2, 1, 12, 11)))) == (2, 1, 12, 11)


def test_overlap_is_symmetric_and_excludes_touching(spark):
    one, two = lit(10, 10, 40, 30), lit(15, 20, 20, 40)
    for a, b in ((one, two), (two, one)):
        assert tuple(value(spark, B.box_struct(B.rect_overlap(a, b)))) == (15, 20, 20, 30)
    assert tuple(value(spark, B.box_struct(B.rect_overlap(one, lit(10, 30, 40, 40))))) == (-1, -1, -1, -1)


def test_containment(spark):
    big, small = lit(4, 3, 44, 33), lit(5, 4, 40, 30)
    assert value(spark, B.rect_contains_rect(big, small))
    assert not value(spark, B.rect_contains_rect(small, big))
    assert value(spark, B.rect_contains_point(big, F.lit(5), F.lit(5)))


def keep_array(boxes):
    return F.array(*(B.box_struct(lit(*b)) for b in boxes))


def test_complement_of_two_areas(spark):
    got = value(spark, B.complement_boxes(keep_array([(42, 452, 943, 732), (238, 37, 786, 348)]), F.lit(1024), F.lit(1024)))
    assert {tuple(b) for b in got} == {
        (0, 0, 1023, 37), (0, 37, 238, 348), (786, 37, 1023, 348), (0, 348, 1023, 452),
        (0, 452, 42, 732), (943, 452, 1023, 732), (0, 732, 1023, 1023)}
    assert value(spark, B.complement_boxes(keep_array([(1, 1, 2, 2)]), F.lit(3), F.lit(3))) != []


def test_complement_of_nothing_is_nothing(spark):
    none = F.array().cast(f"array<{B.BOX_TYPE}>")
    assert value(spark, B.complement_boxes(none, F.lit(10), F.lit(10))) == []


def test_complement_covers_the_rest(spark):
    rng = random.Random(4)
    for exact in (False, True):
        keep = []
        for _ in range(3):
            l, t = rng.randrange(15), rng.randrange(15)
            keep.append((l, t, l + rng.randrange(2, 8), t + rng.randrange(2, 8)))
        got = value(spark, B.complement_boxes(keep_array(keep), F.lit(24), F.lit(24), exact))
        inside = {(x, y) for l, t, r, b in keep for x in range(l, r + 1) for y in range(t, b + 1)}
        cover = {(x, y) for l, t, r, b in got for x in range(l, r + 1) for y in range(t, b + 1)}
        frame = {(x, y) for x in range(24) for y in range(24)}
        assert (cover | inside) >= frame
        if exact:
            assert not cover & inside


def test_region_complement(spark):
    tags = spark.createDataFrame(
        [("a", 1024, 1024, [(10, 20, 30, 40), (50, 60, 70, 80)]), ("b", 1024, 1024, None), ("c", 10, 10, [])],
        "filename string, n_rows int, n_cols int, regions array<struct<x0:int,y0:int,x1:int,y1:int>>")
    got = rects.region_complement(tags).collect()
    assert {tuple(r)[3:7] for r in got} == {
        (0, 0, 1023, 20), (0, 20, 10, 40), (30, 20, 1023, 40), (0, 40, 1023, 60),
        (0, 60, 50, 80), (70, 60, 1023, 80), (0, 80, 1023, 1023)}
    assert {(r.filename, r.frame, r.overlay, r.ocrengine) for r in got} == {("a", 0, -1, 4)}


def test_parse_rect_list(spark):
    def parsed(text):
        return [tuple(r) for r in value(spark, B.parse_rect_list(F.lit(text)))]

    assert parsed("1,2,3,4") == [(1, 2, 3, 4, -1, -1)]
    assert parsed("1,2,+3,+4") == [(1, 2, 4, 6, -1, -1)]
    assert parsed("1,2,+3,+4,5,6") == [(1, 2, 4, 6, 5, 6)]
    assert parsed("1,2,3,4;5,6,7,8") == [(1, 2, 3, 4, -1, -1), (5, 6, 7, 8, -1, -1)]
    assert parsed("(1,2,3,4) ; (5,6,7,8)") == [(1, 2, 3, 4, -1, -1), (5, 6, 7, 8, -1, -1)]


def test_parse_rule_coords(spark):
    def parsed(text, w=None, h=None):
        return tuple(value(spark, B.parse_rule_coords(F.lit(text), F.lit(w).cast("int"), F.lit(h).cast("int"))))

    assert parsed("1,2,3,4") == parsed("(1,2,3,4)") == (1, 2, 3, 4)
    assert parsed("all", 640, 480) == (0, 0, 639, 479)
    try:
        parsed("all")
    except Exception as error:  # noqa: BLE001
        assert "frame size" in str(error)
    else:
        raise AssertionError("a size is required")


FOLD_ROWS = [("f", 1, 2, 30, 10, 40, 20, "jane macleod", 1), ("f", 1, 2, 300, 100, 400, 200, "jane macleod", 2),
             ("f", 1, 2, 28, 8, 42, 19, "jane mcleod", 3)]


def test_fold_merges_similar(spark):
    got = rects.fold_rects(table(spark, FOLD_ROWS), coalesce=True).collect()
    assert {tuple(r)[3:8] for r in got} == {(28, 8, 42, 20, "jane macleod"), (300, 100, 400, 200, "jane macleod")}
    islands = rects.fold_rects(table(spark, FOLD_ROWS), coalesce=True, cell_limit=0).collect()
    assert sorted(islands) == sorted(got)


def test_fold_array(spark):
    folded = value(spark, B.fold_box_array(keep_array([r[3:7] for r in FOLD_ROWS])))
    assert [tuple(b) for b in folded] == [(28, 8, 42, 20), (300, 100, 400, 200)]


def plain_fold(rows, coalesce):
    """Fold boxes of one frame in order, one at a time."""
    out = []
    for l, t, r, b, text in rows:
        if not (t >= 0 and b > t and l >= 0 and r > l):
            continue
        out = [o for o in out if not (l <= o[0] and t <= o[1] and r >= o[2] and b >= o[3])]
        if any(o[0] <= l and o[1] <= t and o[2] >= r and o[3] >= b for o in out):
            continue
        twin = next((o for o in out if coalesce and all(abs(p - q) <= 4 for p, q in zip(o, (l, t, r, b)))
                     and B.texts_similar(o[4], text)), None)
        if twin:
            twin[:4] = [min(twin[0], l), min(twin[1], t), max(twin[2], r), max(twin[3], b)]
        else:
            out.append([l, t, r, b, text])
    return {tuple(o[:4]) for o in out}


def random_boxes(n, seed, span, size, texts=("a", "b")):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        l, t = rng.randrange(span), rng.randrange(span)
        rows.append(("f" if i % 3 else "g", 0, -1, l, t, l + rng.randrange(0, size), t + rng.randrange(0, size),
                     rng.choice(texts), i))
    return rows


def test_fold_agrees_with_plain_fold(spark):
    for seed, span, size in ((1, 60, 12), (2, 400, 30), (3, 900, 60)):
        rows = random_boxes(500, seed, span, size)
        for coalesce in (False, True):
            for limit in (0, 10_000):
                got = rects.fold_rects(table(spark, rows), coalesce=coalesce, cell_limit=limit).collect()
                for name in ("f", "g"):
                    want = plain_fold([r[3:8] for r in rows if r[0] == name], coalesce)
                    assert {tuple(r[c] for c in B.BOX_COLUMNS) for r in got if r.filename == name} == want


def test_fold_with_undecided_texts(spark):
    # Neighbour swaps: the plain distance is twice the one that counts, so the array fold hands these frames on.
    texts = ("jane maclean of skye", "jane macelan of skye", "jnae macelan of skye", "enaj macnael of skye", None)
    rows = random_boxes(400, 4, 60, 30, texts)
    want = {name: plain_fold([(*r[3:7], r[7] or "") for r in rows if r[0] == name], True) for name in ("f", "g")}
    never = {name: plain_fold([(*r[3:7], "") for r in rows if r[0] == name], True) for name in ("f", "g")}
    assert want != never
    for limit in (0, 10_000):
        got = rects.fold_rects(table(spark, rows), coalesce=True, cell_limit=limit).collect()
        assert {n: {tuple(r[c] for c in B.BOX_COLUMNS) for r in got if r.filename == n} for n in want} == want
        got = rects.fold_rects(table(spark, rows), coalesce=True, match_text=False, cell_limit=limit).collect()
        assert {n: {tuple(r[c] for c in B.BOX_COLUMNS) for r in got if r.filename == n} for n in want} == never
    assert rects.fold_rects(table(spark, rows).limit(0), coalesce=True).count() == 0


def test_fold_keeps_the_last_of_equal_boxes(spark):
    rows = [("f", 0, -1, 1, 1, 5, 5, "old", 1), ("f", 0, -1, 1, 1, 5, 5, "new", 2), ("f", 1, -1, 1, 1, 5, 5, "x", 3)]
    for limit in (0, 100):
        got = rects.fold_rects(table(spark, rows), cell_limit=limit).collect()
        assert {(r.frame, r.ocrtext) for r in got} == {(0, "new"), (1, "x")}


def test_maximal_across_levels(spark):
    # Sizes on every cell level, coordinates around the cell borders.
    rows = [("f", 0, -1, 0, 0, 70_000, 70_000, "", 1), ("f", 0, -1, 63, 63, 65, 65, "", 2), ("f", 0, -1, 1023, 5, 2050, 900, "", 3),
            ("g", 0, -1, 60, 60, 70, 70, "", 4), ("g", 0, -1, 0, 0, 1100, 1100, "", 5), ("g", 0, -1, 1090, 1090, 1110, 1110, "", 6),
            ("g", 0, -1, -5, 0, 9, 9, "", 7)]
    for limit in (0, 100):
        got = rects.maximal_rects(table(spark, rows), cell_limit=limit).collect()
        assert {(r.filename, r.box_left, r.box_right) for r in got} == {("f", 0, 70_000), ("g", 0, 1100), ("g", 1090, 1110)}
    across = [("f", 0, -1, 0, 0, 9, 9, "", 1), ("f", 1, -1, 1, 1, 5, 5, "", 2)]
    assert rects.maximal_rects(table(spark, across)).count() == 2
    assert rects.maximal_rects(table(spark, across), across_frames=True).count() == 1


def test_cells_are_asked_only_where_boxes_are(spark, monkeypatch):
    counted, asked = [], []
    split, points = rects.split_hot_groups, rects.with_point_cells
    monkeypatch.setattr(rects, "split_hot_groups", lambda df, keys, limit, **more: counted.append(limit) or split(df, keys, limit, **more))
    monkeypatch.setattr(rects, "with_point_cells", lambda df, x, y, low=None, top=None: asked.append(top) or points(df, x, y, low, top))
    rng = random.Random(5)
    rows = []
    for f, n in (("f", 30), ("hot", 700), (None, 20)):
        for _ in range(n):
            l, t = rng.randrange(300), rng.randrange(300)
            rows.append((f, 0, -1, l, t, l + rng.randrange(1, 90), t + rng.randrange(1, 90), "", 1))
    boxes = {(f, *r) for f, _, _, *r, _, _ in rows}
    want = {a for a in boxes if not any(a[0] == b[0] and a != b and b[1] <= a[1] and b[2] <= a[2] and b[3] >= a[3] and b[4] >= a[4] for b in boxes)}
    got = rects.maximal_rects(table(spark, rows), cell_limit=0).collect()
    assert len(got) == len(want) and {(r.filename, r.box_left, r.box_top, r.box_right, r.box_bottom) for r in got} == want
    # No count of frames of no box, boxes of less than 1024 pixels ask two levels at most.
    assert 0 not in counted and asked == [1]


def test_points_and_pairs_agree_with_brute_force(spark):
    rows = random_boxes(300, 9, 600, 300)
    rng = random.Random(5)
    points = [("f" if i % 2 else "g", -1, -1, rng.randrange(900), rng.randrange(900)) for i in range(200)]
    got = rects.rects_at_point(table(spark, rows), spark.createDataFrame(
        points, "filename string, frame int, overlay int, x int, y int")).select("ord", "x", "y").collect()
    want = sorted((r[8], p[3], p[4]) for r in rows for p in points if r[0] == p[0] and r[5] > r[3] and r[6] > r[4]
                  and r[3] <= p[3] <= r[5] and r[4] <= p[4] <= r[6])
    assert sorted(tuple(g) for g in got) == want
    left, right = table(spark, rows), table(spark, random_boxes(200, 10, 600, 300))
    plain = rects.rect_intersect_pairs(rects.maximal_rects(left), rects.maximal_rects(right)).collect()
    by_cell = rects.rect_intersect_pairs(rects.maximal_rects(left), rects.maximal_rects(right), by_cell=True).collect()
    assert plain and sorted(plain) == sorted(by_cell)
    assert all(p.part_left < p.part_right and p.part_top < p.part_bottom for p in plain)


def test_huge_font(spark):
    rows = [("f", 0, -1, 0, 0, 200, 100, "abc", 1), ("f", 0, -1, 0, 0, 200, 100, "abcdefg", 2),
            ("f", 0, -1, -1, -1, -1, -1, "abc", 3), ("f", 0, -1, 0, 0, 200, 100, "", 4)]
    assert {r.ord for r in rects.drop_huge_font(table(spark, rows)).collect()} == {2, 3, 4}
