"""Filters, containment, overlap and folding of text boxes.

A box table has ``filename, frame, overlay, box_left, box_top, box_right, box_bottom`` and,
for text boxes, ``ocrtext, nerpii``. ``ord`` numbers the boxes of one file in detection order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubframe.functions import boxes as B
from scrubframe.functions.boxes import BOX_COLUMNS, box, rect_contains_point, rect_contains_rect, rect_is_valid
from scrubframe.session import broadcast_if_small, reliable, split_hot_groups

FRAME_KEYS = ["filename", "frame", "overlay"]
SUMMARY = -1

# A group up to this size is compared as one list; larger ones are split into cells.
CELL_LIMIT = 512
# Edge of the cells of each level. A box lives on the first level whose cells are no smaller than it.
CELL_EDGES = (64, 1024, 16384, 1 << 31)


def rects_all(rects: DataFrame) -> DataFrame:
    return rects


def rects_valid(rects: DataFrame) -> DataFrame:
    """Rows with a box."""
    return rects.where(F.col("box_left") != SUMMARY)


def rects_summary(rects: DataFrame) -> DataFrame:
    """Rows without a box: the summaries of whole frames."""
    return rects.where(F.col("box_left") == SUMMARY)


def rect_texts(rects: DataFrame) -> DataFrame:
    return rects_valid(rects).where(F.col("ocrtext") != "").select("ocrtext")


def rect_filenames(rects: DataFrame, contains: str | None = None) -> DataFrame:
    """Distinct filenames, all of them or those containing a text."""
    rows = rects.where(F.col("filename").contains(contains)) if contains is not None else rects
    return rows.select("filename").distinct()


def rects_for_file(rects: DataFrame, filename: str | DataFrame, frame: int = -1, overlay: int = -1,
                   ignore_allowlisted: bool = False, ignore_summaries: bool = False) -> DataFrame:
    """Boxes of one file or of a table of files; frame and overlay filter unless both are -1."""
    if isinstance(filename, str):
        rows = rects.where(F.col("filename") == filename)
    else:
        rows = rects.join(filename.select("filename").distinct(), "filename", "left_semi")
    if not (frame == -1 and overlay == -1):
        rows = rows.where((F.col("frame") == frame) & (F.col("overlay") == overlay))
    if ignore_summaries:
        rows = rows.where(~((F.col("box_left") == -1) & (F.col("box_right") == -1)))
    if ignore_allowlisted:
        rows = rows.where(~((F.col("nerengine") == 50) & (F.col("nerpii") == 0)))
    return rows


def confidence_filter(items: DataFrame, conf: float = 0.4, min_len: int = 2) -> DataFrame:
    """Detected items that are certain and long enough to keep."""
    return items.where((F.col("conf") > conf) & (F.length("ocrtext") >= min_len))


def dedupe_items(items: DataFrame) -> DataFrame:
    """Items found again at another scale count once."""
    return items.select(*FRAME_KEYS, *BOX_COLUMNS, "ocrtext").distinct()


def is_huge_font(max_chars: int | None = 5, px: int = 3000) -> Column:
    """Far more area than the text would need, so most likely not text."""
    size = F.length("ocrtext")
    cond = (F.col("box_left") != SUMMARY) & (size > 0) & (B.rect_area(box()) > px * size)
    return cond & (size <= max_chars) if max_chars else cond


def drop_huge_font(rects: DataFrame, max_chars: int | None = 5, px: int = 3000) -> DataFrame:
    return rects.where(~is_huge_font(max_chars, px))


def huge_boxes_of_tagged(rects: DataFrame, review: DataFrame, px: int = 3000) -> DataFrame:
    """Boxes of reviewed files whose area is far too large for their text, whatever its length."""
    return rects.where(is_huge_font(None, px)).join(review.select("filename"), "filename", "left_semi")


def rects_in_overlays(rects: DataFrame, min_overlay: int = 0) -> DataFrame:
    """Files having a box in an overlay above ``min_overlay``."""
    return rects.where(F.col("overlay") > min_overlay).select("filename").distinct()


def distinct_frame_overlay(rects: DataFrame) -> DataFrame:
    return rects.select(*FRAME_KEYS).distinct()


# ---------------------------------------------------------------- joins by position


def _level_of(size: Column) -> Column:
    level = F.lit(len(CELL_EDGES) - 1)
    for i in reversed(range(len(CELL_EDGES) - 1)):
        level = F.when(size <= CELL_EDGES[i], F.lit(i)).otherwise(level)
    return level


def _edge_of(level: Column) -> Column:
    return F.get(F.array(*(F.lit(e).cast("bigint") for e in CELL_EDGES)), level)


def _box_level(b: B.Box) -> Column:
    return _level_of(F.greatest(b.right - b.left, b.bottom - b.top))


def with_box_cells(df: DataFrame) -> DataFrame:
    """One row per cell a box touches on its own level: at most two cells each way."""
    b = box()
    sized = df.withColumn("_level", _box_level(b)).withColumn("_edge", _edge_of(F.col("_level")))

    def cells(low: Column, high: Column) -> Column:
        return F.sequence(F.floor(low / F.col("_edge")), F.floor(high / F.col("_edge")))

    return (sized.withColumn("_cx", F.explode(cells(b.left, b.right)))
            .withColumn("_cy", F.explode(cells(b.top, b.bottom))).drop("_edge"))


def with_point_cells(df: DataFrame, x: Column, y: Column, from_level: Column | None = None, to_level: int | None = None) -> DataFrame:
    """One row per level: the cell in which a box covering the point must have registered."""
    lowest = from_level if from_level is not None else F.lit(0)
    highest = to_level if to_level is not None else len(CELL_EDGES) - 1
    rows = df.withColumn("_level", F.explode(F.sequence(lowest, F.lit(highest))))
    edge = _edge_of(F.col("_level"))
    return rows.withColumn("_cx", F.floor(x / edge)).withColumn("_cy", F.floor(y / edge))


def _cell_keys(group: list[str]) -> list[str]:
    return [*group, "_level", "_cx", "_cy"]


def _uncovered_by_frame(boxes: DataFrame, group: list[str], carry: list[str]) -> DataFrame:
    """Boxes no other box of their group covers, for groups of bounded size: one shuffle, no self join."""
    listed = boxes.groupBy(*group).agg(F.collect_set(F.struct(*BOX_COLUMNS, *carry)).alias("_all"))

    def hides(o: Column, b: Column) -> Column:
        same = B.rect_equal(B.box_of(o), B.box_of(b))
        if carry:
            later = F.struct(*(o[c].alias(c) for c in carry)) > F.struct(*(b[c].alias(c) for c in carry))
            same = same & ~later
        return rect_contains_rect(B.box_of(o), B.box_of(b)) & ~same

    kept = F.filter("_all", lambda b: ~F.exists("_all", lambda o: hides(o, b)))
    return listed.select(*group, F.inline(kept))


def _covered(keys: list[str]) -> Column:
    """Box ``i`` lies in the different box ``o`` with equal keys."""
    cond = rect_contains_rect(box(alias="o"), box(alias="i")) & ~B.rect_equal(box(alias="o"), box(alias="i"))
    for k in keys:
        cond = cond & (F.col(f"i.{k}") == F.col(f"o.{k}"))
    return cond


def _uncovered_by_cell(boxes: DataFrame, group: list[str], largest: int = 256) -> DataFrame:
    """Distinct boxes no other box of their group covers, for groups of any size.

    In groups of more than ``largest`` boxes the few largest hide most of the others, and comparing
    with them needs no shuffle. What is left is compared cell by cell: a covering box is at least
    as large, so it lies on the same or a higher level, in the cell of the covered box's corner; no
    box asks on levels that hold none. Of the boxes of a cell with equal left, top and right edges
    only the tallest can decide.
    """
    b = box()
    distinct = reliable(boxes)
    left, many = split_hot_groups(distinct, group, largest)
    if many is not None:
        by_size = Window.partitionBy(*group).orderBy(B.rect_area(b).desc(), *BOX_COLUMNS)
        big = many.withColumn("_rank", F.row_number().over(by_size)).where(F.col("_rank") <= largest)
        left = reliable(left.unionByName(many.alias("i").join(
            broadcast_if_small(big.drop("_rank")).alias("o"), _covered(group), "left_anti")))
    top = left.agg(F.max(_box_level(b))).first()[0]
    keys = _cell_keys(group)
    tall = (with_box_cells(left).groupBy(*keys, "box_left", "box_top", "box_right")
            .agg(F.max("box_bottom").alias("box_bottom")))
    probes = with_point_cells(left, b.left, b.top, _box_level(b), top)
    hidden = (probes.alias("i").join(tall.alias("o"), _covered(keys), "left_semi")
              .select(*group, *BOX_COLUMNS).distinct())
    return left.join(hidden, [*group, *BOX_COLUMNS], "left_anti")


def maximal_rects(rects: DataFrame, across_frames: bool = False, order: str | None = None,
                  carry: list[str] | None = None, cell_limit: int = CELL_LIMIT,
                  counted: DataFrame | None = None) -> DataFrame:
    """Valid boxes not hidden inside another box of their frame; equal boxes count once.

    With ``order`` the ``carry`` columns come from the last of several equal boxes. Frames of
    up to ``cell_limit`` boxes are compared as one list. In larger ones equal boxes are merged
    first, so repeats of a hot file never meet in one task, and the rest are compared cell by
    cell. ``counted`` is a table with at least the same boxes that is cheaper to count.
    """
    group = ["filename"] if across_frames else FRAME_KEYS
    valid = rects.where(rect_is_valid(box()))
    keys = [*group, *BOX_COLUMNS]
    extra = [order, *(carry or [])] if order else []
    if cell_limit > 0:
        few, many = split_hot_groups(valid, group, cell_limit, counted=counted)
    else:
        # Every frame is large and needs no count; frames without a full name have no equal and stay one list.
        named = reduce(lambda a, c: a & c, (F.col(k).isNotNull() for k in group))
        few, many = valid.where(~named), valid.where(named)
    out = _uncovered_by_frame(few, group, extra)
    if many is not None:
        left = _uncovered_by_cell(many.select(*keys).distinct(), group)
        if order:
            merged = many.groupBy(*keys).agg(F.max(F.struct(*extra)).alias("_last"))
            left = merged.join(left, keys, "left_semi").select(*keys, *(F.col(f"_last.{c}").alias(c) for c in extra))
        out = out.unionByName(left)
    return out


def rect_intersect_pairs(left: DataFrame, right: DataFrame, by_cell: bool = False) -> DataFrame:
    """Common part of each left box with each right box of the same frame that it overlaps.

    With a few right boxes per frame the frame key is enough. ``by_cell`` splits frames with
    many boxes on both sides: the pair meets in the cell of the common part's corner, so it
    is found once.
    """
    other = right.select(*FRAME_KEYS, *(F.col(c).alias("other_" + c[4:]) for c in BOX_COLUMNS))
    mine, theirs = box(), box("other_")
    common = B.rect_overlap(mine, theirs)
    out = ["box_left", "box_top", "box_right", "box_bottom"]
    parts = ["part_left", "part_top", "part_right", "part_bottom"]
    overlap = ((mine.left < theirs.right) & (theirs.left < mine.right)
               & (mine.top < theirs.bottom) & (theirs.top < mine.bottom))
    if not by_cell:
        rows = left.join(other, FRAME_KEYS).where(overlap)
        return rows.select(*FRAME_KEYS, *out, *other.columns[3:], *(c.alias(n) for c, n in zip(common, parts)))
    edge = 256
    def cells(b: B.Box) -> tuple[Column, Column]:
        return (F.sequence(F.floor(b.left / edge), F.floor(b.right / edge)),
                F.sequence(F.floor(b.top / edge), F.floor(b.bottom / edge)))

    def spread(df: DataFrame, b: B.Box) -> DataFrame:
        xs, ys = cells(b)
        return df.withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys))

    rows = (spread(left.where(rect_is_valid(mine)), mine)
            .join(spread(other.where(rect_is_valid(theirs)), theirs), [*FRAME_KEYS, "_cx", "_cy"])
            .where(overlap & (F.floor(common.left / edge) == F.col("_cx"))
                   & (F.floor(common.top / edge) == F.col("_cy"))))
    return rows.select(*FRAME_KEYS, *out, *other.columns[3:], *(c.alias(n) for c, n in zip(common, parts)))


def rects_at_point(rects: DataFrame, points: DataFrame) -> DataFrame:
    """Boxes containing a point of the same file; a point's frame or overlay of -1 matches any."""
    placed = with_point_cells(points.select("filename", F.col("frame").alias("at_frame"),
                                            F.col("overlay").alias("at_overlay"), "x", "y"),
                              F.col("x"), F.col("y"))
    cells = with_box_cells(rects.where(rect_is_valid(box())))
    joined = cells.join(placed, _cell_keys(["filename"]))
    hit = (rect_contains_point(box(), F.col("x"), F.col("y"))
           & ((F.col("at_frame") == -1) | (F.col("at_frame") == F.col("frame")))
           & ((F.col("at_overlay") == -1) | (F.col("at_overlay") == F.col("overlay"))))
    return joined.where(hit).drop("_level", "_cx", "_cy", "at_frame", "at_overlay")


def drop_inside_regions(rects: DataFrame, regions: DataFrame) -> DataFrame:
    """Remove boxes fully inside a region box of their file; the regions of a file are a handful."""
    inside = ((F.col("r.filename") == F.col("g.filename"))
              & rect_contains_rect(box(alias="g"), box(alias="r")))
    return rects.alias("r").join(regions.select("filename", *BOX_COLUMNS).alias("g"), inside, "left_anti")


# ---------------------------------------------------------------- ordered fold


_STRIP = 8  # twice the similarity limit: boxes further apart than this never influence each other


def _islands(rects: DataFrame, group: list[str], low: str, high: str, name: str) -> DataFrame:
    """Number the runs of boxes that touch along one axis.

    Boxes are reduced to strips of eight pixels first. A frame has at most its width over
    eight strips, however many boxes it holds, so the running count is over a short list.
    """
    a, z = F.floor((F.col(low) - _STRIP) / _STRIP), F.floor((F.col(high) + _STRIP) / _STRIP)
    spans = rects.select(*group, a.alias("_a"), z.alias("_z")).distinct()
    strips = spans.select(*group, F.explode(F.sequence("_a", "_z")).alias("_s")).distinct()
    by_strip = Window.partitionBy(*group).orderBy("_s")
    opens = F.when(F.col("_s") - F.lag("_s").over(by_strip) > 1, 1).otherwise(0)
    numbered = strips.withColumn("_open", opens).withColumn(name, F.sum("_open").over(by_strip)).drop("_open")
    return rects.withColumn("_s", a).join(numbered, [*group, "_s"]).drop("_s")


class _Island:
    """Boxes kept so far while the rows of one island stream by in order."""

    SCAN = 48  # from this many kept boxes on, one array comparison beats a loop

    def __init__(self, coalesce: bool, with_text: bool):
        self.coalesce, self.with_text = coalesce, with_text
        self.kept: list[list] = []
        self.edges: np.ndarray | None = None

    def _matching(self, test) -> list[int]:
        """Positions of kept boxes whose edges pass ``test``, which works on numbers and on arrays."""
        if len(self.kept) < self.SCAN:
            return [i for i, k in enumerate(self.kept) if test(*k[:4])]
        if self.edges is None:
            self.edges = np.array([k[:4] for k in self.kept], dtype=np.int64).T
        return np.flatnonzero(test(*self.edges)).tolist()

    def add(self, new: list) -> None:
        """Add one row ``[l, t, r, b, text, ...]``."""
        l, t, r, b = new[:4]
        inside = self._matching(lambda L, T, R, D: (l <= L) & (t <= T) & (r >= R) & (b >= D))
        if inside:
            gone = set(inside)
            self.kept = [k for i, k in enumerate(self.kept) if i not in gone]
            self.edges = None
        if self._matching(lambda L, T, R, D: (L <= l) & (T <= t) & (R >= r) & (D >= b)):
            return
        near = B.SIMILAR_EDGE
        if self.coalesce:
            for i in self._matching(lambda L, T, R, D: (abs(L - l) <= near) & (abs(T - t) <= near)
                                    & (abs(R - r) <= near) & (abs(D - b) <= near)):
                k = self.kept[i]
                if not self.with_text or B.texts_similar(k[4] or "", new[4] or ""):
                    k[:4] = [min(k[0], l), min(k[1], t), max(k[2], r), max(k[3], b)]
                    self.edges = None
                    return
        self.kept.append(new)
        self.edges = None


def fold_rects(rects: DataFrame, order: str = "ord", coalesce: bool = False, across_frames: bool = False,
               match_text: bool = True, group: list[str] | None = None, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """Boxes of each frame without hidden ones and, with ``coalesce``, with similar ones merged.

    Merging depends on the order, so ``order`` must be unique within a frame. Without merging
    the result is ``maximal_rects``. With it, a frame of up to ``cell_limit`` boxes is folded as
    one array; only a frame in which two texts met that need the swap distance is folded
    by the Python function, within the same pass. Larger frames are first cut into islands that
    cannot influence each other, and each island is folded as a sorted stream that holds only
    the boxes kept so far.
    """
    if not coalesce and group is None:
        return maximal_rects(rects, across_frames, order, ["ocrtext"], cell_limit)
    keys = group or (["filename"] if across_frames else FRAME_KEYS)
    valid = rects.where(rect_is_valid(box())).select(*keys, *BOX_COLUMNS, "ocrtext", order)
    few, many = split_hot_groups(valid, keys, cell_limit)
    out = _folded_lists(few, keys, order, coalesce, match_text)
    if many is not None:
        out = out.unionByName(_folded_islands(many, keys, order, coalesce, match_text))
    return out


def _folded_lists(few: DataFrame, keys: list[str], order: str, coalesce: bool, match_text: bool) -> DataFrame:
    """Fold groups of bounded size, one array each."""
    row = F.struct(F.col(order), *BOX_COLUMNS, "ocrtext")
    listed = few.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_all"))
    if not coalesce:
        hidden = lambda o, b: rect_contains_rect(B.box_of(o), B.box_of(b)) & (
            ~B.rect_equal(B.box_of(o), B.box_of(b)) | (o[order] > b[order]))
        kept = F.filter("_all", lambda b: ~F.exists("_all", lambda o: hidden(o, b)))
    else:
        rows_type = listed.schema["_all"].dataType
        whole = F.struct(F.col("_all").alias("kept"), F.lit(False).alias("undecided"))
        folded = listed.withColumn("_fold", F.when(F.size("_all") == 1, whole).otherwise(
            B.fold_text_boxes(F.col("_all"), rows_type.elementType.simpleString(), match_text)))
        listed = folded.withColumn("_exact", _fold_in_python(rows_type, match_text)(
            F.when(F.col("_fold.undecided"), F.col("_all")).otherwise(F.array().cast(rows_type)))) if match_text else folded
        kept = F.when(F.col("_fold.undecided"), F.col("_exact")).otherwise(F.col("_fold.kept")) if match_text else F.col("_fold.kept")
    return listed.select(*keys, F.inline(kept)).select(*keys, *BOX_COLUMNS, "ocrtext", order)


def _fold_in_python(rows_type: T.ArrayType, match_text: bool):
    """Fold of arrays whose texts need the swap distance; other groups arrive as empty arrays."""
    names = rows_type.elementType.names

    @F.arrow_udf(rows_type)
    def fold(groups: pa.Array) -> pa.Array:
        out = []
        for group in groups.to_pylist():
            boxes = _Island(True, match_text)
            for r in group or []:
                boxes.add([*(r[c] for c in BOX_COLUMNS), r["ocrtext"], r[names[0]]])
            out.append([dict(zip([*BOX_COLUMNS, "ocrtext", names[0]], k)) for k in boxes.kept])
        return pa.array(out, groups.type)

    return fold


def _folded_islands(many: DataFrame, keys: list[str], order: str, coalesce: bool, match_text: bool) -> DataFrame:
    """Fold large groups island by island, each as a sorted stream."""
    columns = _islands(many, keys, "box_left", "box_right", "_ix")
    flat = _islands(columns, [*keys, "_ix"], "box_top", "box_bottom", "_iy")
    islands = [*keys, "_ix", "_iy"]
    ordered = flat.repartition(*islands).sortWithinPartitions(*islands, order)
    fields = [*keys, *BOX_COLUMNS, "ocrtext", order]
    schema = T.StructType([many.schema[f] for f in fields])
    n_keys = len(keys)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, boxes, done = None, _Island(coalesce, match_text), []

        def close() -> None:
            done.extend([*current[:n_keys], *k] for k in boxes.kept)

        for batch in batches:
            rows = batch[[*islands, *BOX_COLUMNS, "ocrtext", order]].itertuples(index=False, name=None)
            for row in rows:
                island = row[:n_keys + 2]
                if island != current:
                    if current is not None:
                        close()
                    current, boxes = island, _Island(coalesce, match_text)
                boxes.add(list(row[n_keys + 2:]))
            if done:
                yield pd.DataFrame(done, columns=fields)
                done = []
        if current is not None:
            close()
        if done:
            yield pd.DataFrame(done, columns=fields)

    return ordered.mapInPandas(fold, schema)


# ---------------------------------------------------------------- complements


def region_complement(tags: DataFrame, exact: bool = False) -> DataFrame:
    """Boxes outside the image regions listed in a tag document: frame 0, no overlay, once per file.

    The regions are one array per document, so nothing is grouped or shuffled.
    """
    keep = F.transform("regions", lambda r: F.struct(
        r["x0"].cast("int").alias("box_left"), r["y0"].cast("int").alias("box_top"),
        r["x1"].cast("int").alias("box_right"), r["y1"].cast("int").alias("box_bottom")))
    pieces = B.complement_boxes(keep, F.col("n_cols"), F.col("n_rows"), exact)
    return (tags.where(F.size("regions") > 0).select("filename", F.explode(pieces).alias("_p"))
            .select("filename", F.lit(0).alias("frame"), F.lit(-1).alias("overlay"), "_p.*",
                    F.lit(4).alias("ocrengine")))


def rect_complement(boxes: DataFrame, exact: bool = False) -> DataFrame:
    """Cover of the frame area outside the boxes in array column ``keep`` (frame size ``n_cols`` x ``n_rows``)."""
    pieces = B.complement_boxes(F.col("keep"), F.col("n_cols"), F.col("n_rows"), exact)
    return boxes.select("filename", F.explode(pieces).alias("_p")).select("filename", "_p.*")


def full_frame_box(tags: DataFrame, forms: DataFrame) -> DataFrame:
    """A box over the whole image for every scanned form."""
    rows = tags.join(forms.select("filename").distinct(), "filename", "left_semi")
    return rows.select("filename", F.lit(0).alias("frame"), F.lit(-1).alias("overlay"),
                       F.lit(0).alias("box_left"), F.lit(0).alias("box_top"),
                       (F.col("n_cols") - 1).alias("box_right"), (F.col("n_rows") - 1).alias("box_bottom"),
                       F.lit("SCANNED_FORM").alias("ocrtext"), F.lit(5).alias("ocrengine"))
